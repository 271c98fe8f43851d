from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest

from quadrante.llm.licenses import DECOYS, TEMPLATES, paragraphs, scan_licenses, train
from quadrante.llm.sharding import assign_shards, write_shards
from tests.llm.conftest import odd_rows, prose


def place(doc, text):
    return int(hashlib.md5(f"{'' if doc is None else doc}|{text or ''}".encode()).hexdigest()[:15], 16)


def brute(rows, limit):
    """Splits bucket by bucket."""
    out, copies = [], Counter()

    def split(bucket, depth):
        if sum(len((t or "").encode()) for _, t in bucket) <= limit or len({place(*r) for r in bucket}) == 1:
            total = sum(len((t or "").encode()) for _, t in bucket)
            for doc, text in bucket:
                size = len((text or "").encode())
                n = copies[(doc, text)]
                copies[(doc, text)] += 1
                out.append((doc, depth, place(doc, text) >> (60 - depth), n // max(1, limit // max(1, size)) if total > limit else 0, size))
            return
        for bit in (0, 1):
            if part := [r for r in bucket if place(*r) >> (59 - depth) & 1 == bit]:
                split(part, depth + 1)

    if rows:
        split(rows, 0)
    return sorted(out, key=str)


@pytest.mark.parametrize(("limit", "step"), [(10**9, 16), (3000, 16), (600, 3), (200, 16)])
def test_shards_equal_recursive_splitting(documents, limit, step):
    rows = [*odd_rows()[:-2], *((100, "same text " * 20) for _ in range(25)), *((200 + k, prose(k, 20)) for k in range(60))]
    got = sorted((tuple(r) for r in assign_shards(documents(rows), limit, step).collect()), key=str)
    assert got == brute(rows, limit)
    sizes: dict = defaultdict(list)
    for _, depth, prefix, overflow, size in got:
        sizes[(depth, prefix, overflow)].append(size)
    assert all(sum(s) <= limit or len(s) == 1 for s in sizes.values())


def test_written_shards_hold_all_rows(spark, documents, tmp_path):
    rows = [(k, prose(k, 30)) for k in range(40)]
    write_shards(documents(rows), str(tmp_path / "shards"), 1500)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == rows
    assert back.groupBy("shard").agg({"n_chars": "sum"}).where("`sum(n_chars)` > 1500").count() == 0
    assert assign_shards(documents([]), 10).count() == 0


@pytest.fixture(scope="module")
def corpus(documents):
    rows = [(k, "\n".join(prose(1000 * k + j, 12) for j in range(4))) for k in range(60)]
    planted = {}
    for k, (family, notices) in enumerate(TEMPLATES.items()):
        for notice in notices:
            doc = 1000 + len(planted)
            planted[doc] = family
            rows.append((doc, f"{prose(doc, 15)}\n{prose(doc + 1, 3) if k % 2 else ''} {notice.upper() if k % 3 == 0 else notice}\n\n{prose(doc + 2, 15)}"))
    rows += [(2000 + k, f"{prose(k, 9)}\n{d}") for k, d in enumerate(DECOYS)]
    rows += [(3000, None), (3001, ""), (3002, "\n\n"), (None, "Released under the MIT License."), (3003, prose(9, 20_000) + " Released under the MIT License.")]
    rows += [(1002, rows[62][1])]
    return documents(rows), planted


def test_licences_are_found_and_nothing_else(corpus):
    docs, planted = corpus
    model = train(docs)
    got = scan_licenses(docs, model).collect()
    assert 0.5 <= model.threshold < 1
    found = {r["doc_id"]: r["family"] for r in got if r["doc_id"] is not None and r["doc_id"] < 2000}
    assert sum(found.get(k) == v for k, v in planted.items()) >= len(planted) - 1
    assert not [r for r in got if r["doc_id"] is not None and (r["doc_id"] < 1000 or 2000 <= r["doc_id"] < 3003)]
    assert [r["family"] for r in got if r["doc_id"] is None] == ["MIT"]
    assert all(r["paragraph_no"] == 1 for r in got if r["doc_id"] in planted)


def test_plan_is_native(corpus):
    docs, _ = corpus
    plan = scan_licenses(docs, train(docs))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def test_no_documents(documents):
    docs = documents([])
    assert scan_licenses(docs, train(docs)).count() == 0 and paragraphs(docs).count() == 0


def test_rows_with_repeated_or_no_ids_are_written_once(spark, documents, tmp_path):
    rows = [*((7, prose(k, 30)) for k in range(20)), *((None, prose(100 + k, 30)) for k in range(20)), *((8, "same text " * 20) for _ in range(25)), (9, None), (None, None), (9, None)]
    write_shards(documents(rows).repartition(5), str(tmp_path / "shards"), 1500)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == sorted(rows, key=str)
    assert back.groupBy("shard").agg({"n_chars": "sum"}).where("`sum(n_chars)` > 1500").count() == 0
    got = back.where("doc_id = 8").groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [4, 7, 7, 7]


def test_wrapped_notices_are_found(documents):
    bsd, mit = TEMPLATES["BSD"][1].split(), TEMPLATES["MIT"][2].split()
    lines = [f"{prose(1, 12)}", "", *(f"# {' '.join(bsd[k : k + 7])}" for k in range(0, len(bsd), 7)), "#", *(" ".join(mit[k : k + 9]) for k in range(0, len(mit), 9)), "", prose(2, 12)]
    rows = [(1, "\n".join(lines)), (2, prose(3, 12)), *((10 + k, "\n".join(prose(100 * k + j, 12) for j in range(6))) for k in range(30))]
    docs = documents(rows)
    got = sorted((r["doc_id"], r["family"], r["paragraph_no"]) for r in scan_licenses(docs, train(docs)).collect())
    assert {(d, f) for d, f, _ in got} == {(1, "BSD"), (1, "MIT")}
    at = {f: {n for _, g, n in got if g == f} for f in ("BSD", "MIT")}
    assert at["BSD"] <= {2, 3} and at["MIT"] <= set(range(2 + -(-len(bsd) // 7) + 1, len(lines)))


def test_many_copies_are_numbered_in_blocks(documents):
    rows = assign_shards(documents([(1, "ab")] * 9000 + [(2, "c")]), 100).collect()
    chain = sorted(r["overflow"] for r in rows if r["doc_id"] == 1)
    assert chain == [k // 50 for k in range(9000)] and len(rows) == 9001
