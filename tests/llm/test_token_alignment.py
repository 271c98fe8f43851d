from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest import TESTDATA

from quadrante.llm import token_alignment as alignment

from .conftest import DOCS, odd_rows, prose, row

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = [public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(texts):
    """``n_a .. count_sum, groups`` of each text, token by token with the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_library = Tokenizer.from_file(PATHS[0])
    a_library.encode_special_tokens = True
    b_library = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = {}
    extra = 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            letters[chr(byte)] = byte
        else:
            letters[chr(extra)] = byte
            extra += 1
    results, counts = [], Counter()
    for text in texts:
        a, b = [], []
        if text:
            a = [(i, bytes(letters[c] for c in a_library.id_to_token(i))) for i in a_library.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(b_library.id_to_piece(i)[3:5], 16)]) if b_library.is_byte(i) else b_library.id_to_piece(i).replace("▁", " ").encode()) for i in b_library.encode(text)]
            if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
                a, b = [], []
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, links, low = [], [], 0
        for end in common:
            inside = [[i for (i, _), e in zip(side, own) if low < e <= end] for side, own in zip((a, b), ends)]
            groups.append("|".join(",".join(map(str, x)) for x in inside))
            links.append((inside[0][-1], inside[1][-1]))
            low = end
        counts.update(links)
        results.append((len(a), len(b), groups, links))
    top: dict[int, int] = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for n_a, n_b, groups, links in results:
        text = ";".join(groups)
        sums = (len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links))
        out.append((n_a, n_b, *sums, hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    return out


def check(spark, rows, size):
    df = spark.createDataFrame([row(*r) for r in rows], DOCS)
    got = alignment.align(df, *PATHS, size=size, with_groups=True).collect()
    expected = [(r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows]))]
    key = lambda r: (r[0] is None, *(str(x) for x in r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(expected, key=key)


ODD = [r if r[0] != 10 else (10, prose(5, 1500)) for r in odd_rows()] + [
    (20, "▁ is no blank"), (21, " leading\tand \n\n trailing  "), (22, "日本語テキスト、混在 emoji 🙂🙂 é"), (23, "<s> </s> <unk> <0x41>"), (24, "aaaaaaaaaaaaaaaa" * 40), (25, "x" * 5000),
]


@pytest.mark.parametrize("size", [2, 7, 64, alignment.SIZE])
def test_odd_rows_in_pieces_of_any_size(spark, size):
    check(spark, ODD, size)


def test_no_rows(spark):
    check(spark, [], 8)
    with pytest.raises(ValueError):
        alignment.align(spark.createDataFrame([], DOCS), *PATHS, size=1)


def test_given_documents(spark):
    """The registered query over its whole table."""
    import __spark_entry__ as entry_point

    got = entry_point.queries()["op12_token_alignment"](spark, str(TESTDATA / "sf0.001"))
    assert got.columns == COLUMNS
    docs = spark.read.parquet(str(TESTDATA / "sf0.001" / "documents.parquet")).select("doc_id", "text").collect()
    expected = [(d["doc_id"], *x[:-1]) for d, x in zip(docs, brute([d["text"] for d in docs]))]
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_cuts_are_equal_work_and_part_no_common_end():
    rng = np.random.default_rng(3)
    for _ in range(200):
        total = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, total + 1, rng.integers(0, 40)), total)) for _ in range(2))
        size = int(rng.integers(2, 12))
        cuts = alignment.merge_cuts(a, b, size)
        assert cuts[0] == (0, 0) and cuts[-1] == (len(a), len(b)) and cuts == sorted(cuts)
        for i, j in cuts[1:-1]:
            assert a[:i].max(initial=0) <= b[j:].min(initial=total + 1) and b[:j].max(initial=0) <= a[i:].min(initial=total + 1)
            assert not set(a[:i]) & set(b[j:]) and not set(b[:j]) & set(a[i:])
        assert all(i + j - m - n <= size + 1 for (m, n), (i, j) in zip(cuts, cuts[1:]))


def test_pairs_have_numbers_of_their_own():
    """No more pairs than bytes in both vocabularies, and no number twice."""
    v = alignment.Vocabularies(*PATHS)
    assert v.codes < 3 * (sum(map(len, v.a)) + sum(map(len, v.b)) + len(v.a) + len(v.b))
    of_b: dict[bytes, list[int]] = {}
    for k, token in enumerate(v.b):
        of_b.setdefault(token, []).append(k)
    of_a = {token: k for k, token in enumerate(v.a)}
    pairs = {(a, b) for token, a in of_a.items() for n in range(1, len(token) + 1) for b in of_b.get(token[-n:], [])}
    pairs |= {(of_a[token[-n:]], b) for b, token in enumerate(v.b) for n in range(1, len(token) + 1) if token[-n:] in of_a}
    a, b = np.array(sorted(pairs)).T
    codes = v.code(a, b)
    assert len(np.unique(codes)) == len(pairs) and codes.min() >= 0 and codes.max() < v.codes
