from __future__ import annotations

import hashlib
import random
import re

import pytest

from quadrante.llm.substrings import remove_repeats, rows_of_pieces, substring_spans
from tests.llm.conftest import odd_rows, prose

LETTER = r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"


def pieces(text):
    """``(start, words)`` of each piece, word by word."""
    found = list(re.finditer(rf"{LETTER}|(?:(?!{LETTER})\S)+", text))
    units, at = [], 0
    for m in found:
        gap = text[at : m.start()]
        if not units or "\n" in gap:
            units.append([])
        units[-1].append((m.start(), m[0].lower()))
        at = m.end()
    out = []
    for unit in units:
        cuts = {0}
        if len(unit) >= 15:
            sums = [hashlib.md5(w.encode("utf-8", "replace")).digest()[:8] for _, w in unit]
            cuts |= {1 + min(range(k, k + 15), key=lambda i: (sums[i], -i)) for k in range(len(unit) - 14)}
        cuts = sorted(c for c in cuts if c < len(unit))
        out += [(unit[a][0], [w for _, w in unit[a:b]]) for a, b in zip(cuts, [*cuts[1:], len(unit)])]
    if out:
        out[0] = (0, out[0][1])
    return out


def brute(rows, min_words=8):
    """Plainest form: spell all rows of pieces of the distinct documents in order, remove what was seen."""
    import xxhash

    seen: dict = {}
    out = {}
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode("utf-8", "replace"), 42) + 2**63) % 2**64 - 2**63
    for doc, text in sorted({r for r in rows if r[1]}, key=lambda r: (r[0] is None, r[0] or 0, signed(r[1]))):
        cut = pieces(text)
        ends = [*(s for s, _ in cut[1:]), len(text)]
        found = set()
        for a in range(len(cut)):
            for b in range(a, len(cut)):
                if sum(len(w) for _, w in cut[a : b + 1]) >= min_words:
                    found.add((a, b))
                    break
        for b in range(len(cut)):
            for a in range(b, -1, -1):
                if sum(len(w) for _, w in cut[a : b + 1]) >= min_words:
                    found.add((a, b))
                    break
        gone = set()
        for a, b in sorted(found):
            words = tuple(w for _, ws in cut[a : b + 1] for w in ws)
            if seen.setdefault(words, (doc, text, a)) != (doc, text, a):
                gone.update(range(a, b + 1))
        out[(doc, text)] = "".join(text[s:e] for k, ((s, _), e) in enumerate(zip(cut, ends)) if k not in gone) if cut else text
    return out


def rows():
    passage = prose(30, 55)
    line = "A line that stands in very many of the documents"
    return [
        *((d, t) for d, t in odd_rows() if d is not None and d != 9),
        (30, f"{prose(31, 30, False)} {passage} {prose(32, 30)}"),
        (31, f"{prose(33, 10)}\n{passage}\n{prose(34, 10)}"),
        (32, f"{line}\n{prose(35, 20)}\n{line}"),
        (33, f"{prose(36, 20)}\n{line}\n\n{prose(37, 9)}"),
        (34, "Yes. No. Yes. No."),
        (35, "Yes. No."),
    ]


def test_equals_brute_force(documents):
    want = brute(rows())
    for r in substring_spans(documents(rows())).collect():
        texts = [t for d, t in rows() if d == r["doc_id"]]
        text = texts[0]
        assert r["text"] == (want[(r["doc_id"], text)] if text else text), r["doc_id"]
        if text:
            left = "".join(text[a:b] for a, b in zip([0, *(s["end"] for s in r["removed"])], [*(s["start"] for s in r["removed"]), len(text)]))
            assert left == r["text"] and r["n_removed"] == len(text) - len(left)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_equal_brute_force(documents, seed):
    rng = random.Random(seed)
    words = ["a", "Bee", "c.", "dee!", "\u5929", "\u5730", "Ünter", "über", "x\xa0y", "e"]
    passages = [rng.choices(words, k=rng.randint(3, 60)) for _ in range(6)]
    made = []
    for k in range(40):
        parts = [w for _ in range(rng.randint(0, 4)) for w in (rng.choice(passages) if rng.random() < 0.6 else rng.choices(words, k=rng.randint(1, 30)))]
        made.append((rng.choice([None, k, k, k % 5]), "".join(w + rng.choice([" ", " ", "  ", "\n", " \n\t", "\u2003"]) for w in parts)))
    for min_words in (3, 20):
        want = brute(made, min_words)
        got = substring_spans(documents(made), min_words).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(((d, want[(d, t)] if t else t) for d, t in made), key=str)


def test_rows_of_pieces_do_not_depend_on_the_other_texts():
    texts = [t for _, t in rows() if t]
    together = rows_of_pieces(texts, 8)
    for k, text in enumerate(texts):
        alone = rows_of_pieces([text], 8)
        assert all(x[together[0] == k].tolist() == y.tolist() for x, y in zip(together[1:], alone[1:]))


def test_passages_and_lines_go_but_the_first(documents):
    got = {r["doc_id"]: r["text"] for r in substring_spans(documents(rows())).collect()}
    left = got[31].split()
    assert prose(30, 55) in got[30] and len(left) < 20 + 2 * 14 and left[:10] == prose(33, 10).split() and left[-10:] == prose(34, 10).split()
    assert got[32].count("A line that") == 1 and "A line that" not in got[33]
    assert got[34] == "Yes. No. Yes. No." and got[35] == "Yes. No."


def test_columns_stay_and_emptied_documents_go(documents):
    docs = documents(rows())
    kept = remove_repeats(docs)
    assert kept.schema == docs.schema
    by_id = {r["doc_id"]: r for r in kept.collect()}
    assert 2 not in by_id and {1, 4, 5, 6, 30, 31} <= set(by_id)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["n_words"] == -1 for r in by_id.values())


def test_rows_without_ids_rank_last(documents):
    got = {r["doc_id"]: r["text"] for r in substring_spans(documents([(None, prose(40, 30)), (5, prose(40, 30)), (None, None)])).where("text is not null").collect()}
    assert got == {5: prose(40, 30), None: ""}


def test_no_documents(documents):
    assert substring_spans(documents([])).count() == 0 and remove_repeats(documents([])).count() == 0


def whole(documents, rows):
    return {r["doc_id"]: r["text"] for r in remove_repeats(documents(rows)).collect()}


def test_passages_inside_long_sentences_go(documents):
    passage = prose(50, 60, False).lower()
    texts = [f"{prose(51 + k, 40, False).lower()} {passage} {prose(61 + k, 300, False).lower()}" for k in range(3)]
    greek = "".join(chr(0x3B1 + ord(c) - 97) if c.isalpha() else c for c in passage)
    ideographs = "".join(chr(0x4E00 + 7 * (k * k % 997)) for k in range(80))
    rows = [*enumerate(texts), (5, greek), (6, f"{greek} {''.join(chr(0x3B1 + k) for k in range(9))}")]
    rows += [(7, ideographs), (8, f"天地玄黄{ideographs}宇宙洪荒")]
    got = whole(documents, rows)
    assert got[0] == texts[0] and got[5] == greek and got[7] == ideographs
    for k in (1, 2):
        left = got[k].split()
        assert 340 <= len(left) < 340 + 32 and left[:40] == texts[k].split()[:40] and left[-300:] == texts[k].split()[-300:]
    assert len(got[6].split()) < 1 + 32 and len(got[8]) < 8 + 32


def test_text_that_only_stands_in_scattered_places_stays(documents):
    names = "Anna Bert Carl Dora Emil Fritz Gerd Hans Ida".split()
    together = " ".join(names)
    rows = [*((k, f"{n} {prose(70 + k, 20, False).lower()}") for k, n in enumerate(names)), (20, together), (21, together), (22, f"Zoe\n{together}\nZoe")]
    got = whole(documents, rows)
    assert got[20] == together and 21 not in got and got[22] == "Zoe\nZoe"


def test_tail_of_a_repeated_row_goes(documents):
    line = f"{prose(90, 9, False)}.\nYes it is.\nNo."
    assert whole(documents, [(1, line), (2, f"{line}\nnew words")])[2] == "new words"
