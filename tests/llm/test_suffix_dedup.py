from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import TESTDATA

from quadrante.llm import suffix_dedup as dedup

from .conftest import DOCS, odd_rows, row

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if counts[d[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        edges = [k for k in range(len(d) + 1) if (k < len(d) and gone[k]) != (k > 0 and gone[k - 1])]
        spans = list(zip(edges[::2], edges[1::2]))
        out.append((len(d), sum(gone), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept))
    return out


def check(spark, rows, length=200, gram=48, **options):
    df = spark.createDataFrame([row(*r) for r in rows], DOCS)
    got = dedup.remove_repeated_strings(df, length, gram, with_text=True, **options).collect()
    got = [(*r[:5], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got]
    expected = [(r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows], length))]
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_odd_rows(spark):
    rows = odd_rows() + [(20, "é" * 150), (21, "x" * 199), (22, "x" * 200), (23, "ab" * 400), (24, "abc" * 500 + "tail"), (25, "x" * 3000)]
    check(spark, rows)


def test_no_rows(spark):
    check(spark, [])
    with pytest.raises(ValueError):
        dedup.remove_repeated_strings(spark.createDataFrame([], DOCS), 10, 11)


@pytest.mark.parametrize("group", [dedup.GROUP, 2])
@pytest.mark.parametrize("letters, length, gram", [("ab", 12, 4), ("abcd", 9, 3), ("abcdefgh", 5, 2), ("ab", 7, 7)])
def test_random_texts(spark, letters, length, gram, group):
    """Texts full of repeats at all distances; ``group=2``: all grams but few go the way of very frequent ones."""
    rng = random.Random(f"{letters}{length}")
    parts = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 40))) for _ in range(12)]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.5 else rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(40)]
    check(spark, list(enumerate(texts)), length, gram, group=group)


def test_passage_in_many_documents(spark):
    """One passage in all documents, between other words: one gram has hundreds of surroundings."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(260))
    rows = [(k, "".join(rng.choice("klmnopq ") for _ in range(80)) + passage + "".join(rng.choice("rstuv ") for _ in range(90))) for k in range(300)]
    check(spark, rows)
    check(spark, rows, group=100)


def test_long_text_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "_CHUNK", 37)
    data = np.frombuffer(("".join(random.Random(4).choice("ab") for _ in range(3000))).encode(), np.uint8)
    ends = np.array([0, 500, 500, 511, 2000, 3000])
    few = dedup.sampled(data, ends, 30, 8)
    monkeypatch.setattr(dedup, "_CHUNK", 1 << 20)
    for a, b in zip(few, dedup.sampled(data, ends, 30, 8)):
        assert (a == b).all()


@pytest.mark.parametrize("shallow", [0, 1, 3, 100])
def test_order_and_common_prefixes(shallow):
    """Against Python's sort: quicksort alone, the tries alone, and both."""
    rng = random.Random(shallow)
    for _ in range(60):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode() for _ in range(rng.randint(1, 40))]
        order, shared = dedup.deep_shallow(strings, shallow)
        assert [strings[k] for k in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
        assert shared == [0, *(dedup.common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:]))]


def test_nodes_are_those_of_the_tree():
    rng = random.Random(1)
    for _ in range(60):
        strings = sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 8))).encode() for _ in range(rng.randint(2, 20)))
        shared = [0, *(dedup.common_prefix(a, b) for a, b in zip(strings, strings[1:]))]
        found = sorted(dedup.nodes(shared, len(strings)))
        expected = {(depth, low, high) for k in range(1, len(strings)) for depth in [shared[k]] for low, high in [interval(shared, k)]}
        assert found == sorted(expected)


def interval(shared, k):
    low = high = k
    while low - 1 > 0 and shared[low - 1] >= shared[k]:
        low -= 1
    while high + 1 < len(shared) and shared[high + 1] >= shared[k]:
        high += 1
    return low - 1, high


def test_given_documents(spark):
    """The registered query over its whole table."""
    import __spark_entry__ as entry_point

    got = entry_point.queries()["op13_suffix_dedup"](spark, str(TESTDATA / "sf0.001"))
    assert got.columns == COLUMNS
    docs = spark.read.parquet(str(TESTDATA / "sf0.001" / "documents.parquet")).select("doc_id", "text").collect()
    expected = [(d["doc_id"], *x[:4]) for d, x in zip(docs, brute([d["text"] for d in docs], 200))]
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    assert sum(x[2] for x in expected) > 0
