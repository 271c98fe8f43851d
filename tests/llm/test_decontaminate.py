from __future__ import annotations

import hashlib
import re

import pytest

from quadrante.llm.decontaminate import decontaminate, scan
from tests.llm.conftest import odd_rows, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def found_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, n=10):
    own = found_words(text)
    hit, listed = set(), set()
    for item, of in items:
        words = found_words(of)
        size = min(n, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            for p in range(len(own) - size + 1):
                if own[p : p + size] == words[k : k + size]:
                    hit.update(range(p, p + size))
                    if item is not None:
                        listed.add(str(item))
    names = sorted(listed)
    return len(own), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


ITEMS = [(10, prose(20, 25)), (9, prose(21, 12)), (9, prose(21, 12)), (3, "Short ITEM, here"), (4, ""), (5, None), (None, prose(22, 15)), (11, prose(20, 25))]


def rows():
    leak = prose(20, 25)
    return [
        *odd_rows()[:-5], (20, f"{prose(23, 20)} {leak} {prose(24, 20)}"), (21, leak.upper()), (22, "x short item here y"), (23, prose(22, 15)),
        (24, leak[: len(leak) // 3]), (25, f"{prose(21, 12)}, {prose(21, 12)}"),
    ]


@pytest.mark.parametrize("block", [250_000, 7])
def test_scan_equals_brute_force(spark, documents, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = scan(documents(rows()), items, block_grams=block).collect()
    want = sorted((d, *brute(t, ITEMS)) for d, t in rows() if d is not None)
    mine = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got]
    assert sorted(x for x in mine if x[0] is not None) == want
    assert len(got) == len(rows())


@pytest.mark.parametrize("block", [250_000, 7])
def test_removal_leaves_no_window_and_clean_rows_alone(spark, documents, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(rows())
    kept = decontaminate(docs, items, block_grams=block)
    assert kept.schema == docs.schema
    got = kept.collect()
    assert not any(brute(r["text"], ITEMS)[4] for r in got)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    clean = [x for x in rows() if not brute(x[1], ITEMS)[4]]
    assert sorted(map(str, clean)) == sorted(str((r["doc_id"], r["text"])) for r in got if not (r["doc_id"] or 0) >= 20 or brute(dict(rows())[r["doc_id"]], ITEMS)[4] is False)
    assert {20, 22} <= {r["doc_id"] for r in got} and not {21, 23} & {r["doc_id"] for r in got}


def test_spans_are_code_points_of_the_hits(spark, documents):
    text = f"Größe ß, {prose(20, 25)} und Ende"
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    (got,) = scan(documents([(1, text)]), items).collect()
    assert [text[s["start"] : s["end"]] for s in got["spans"]] == [prose(20, 25).rstrip(".")]


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert scan(documents([]), none).count() == 0
    assert not scan(documents(odd_rows()), none).where("contaminated").count()
    assert decontaminate(documents(odd_rows()), none).count() == len(odd_rows())
