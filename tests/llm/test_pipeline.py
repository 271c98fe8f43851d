from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from quadrante.llm.queries import llm_oracles, llm_queries
from tests.llm.conftest import prose
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard import brute as components

SF = "/root/testdata/sf0.001"


def test_each_dealt_operator_has_one_query():
    names = list(llm_queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] + ["pipeline"]
    assert [f.__name__ for _, f in corpus_pipeline.STAGES][0] == "quality_stage" and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", llm_oracles())
def test_queries_equal_their_sql(spark, name):
    got = llm_queries()[name](spark, SF).toPandas()
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = connection.execute(llm_oracles()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].convert_dtypes().sort_values(columns).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b)


def test_stages_on_given_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = [tuple(r) for r in kept.select("doc_id", "text").collect()]
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns, name
        kept = corpus_pipeline.stored(after)
        if name == "near_duplicates":
            wanted = {d for d, _, c in components(before) if d == c}
            assert {r["doc_id"] for r in kept.collect()} == wanted
    assert not any(leaks(r["text"], benchmark)[4] for r in kept.collect())
    pieces = corpus_pipeline.STAGES[4][1](spark, kept, SF)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept.collect()}


def test_stages_on_an_empty_table(documents, spark):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0 and prose(1, 3)


def test_one_row_of_each_component_stays_whatever_its_id(documents, spark):
    base, other = prose(80, 60), prose(81, 60)
    rows = [(5, base), (5, other), (5, base), (3, prose(82, 60)), (9, base), (None, other), (None, prose(83, 60)), (None, prose(83, 60)), (4, None), (None, " ")]
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    docs = documents(rows)
    kept = stage(spark, docs, SF)
    assert kept.schema == docs.schema
    wanted = [(5, base), (5, other), (3, prose(82, 60)), (None, prose(83, 60)), (4, None), (None, " ")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(wanted, key=str)
