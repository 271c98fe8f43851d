"""Every registered query of the library against its DuckDB statement; those for training data are tested in ``tests/llm``."""

from __future__ import annotations

import pytest
from conftest import TESTDATA, by_name

import __spark_entry__ as entry_point
from quadrante.verification.oracles import oracle_statements
from quadrante.verification.queries import all_queries

QUERIES = all_queries()
ORACLES = oracle_statements()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck_sources, name):
    df = QUERIES[name](spark, str(TESTDATA / "sf0.001"))
    result = duck_sources.execute(ORACLES[name])
    described = {c[0]: str(c[1]) for c in result.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == described
    expected = by_name(list(described), result.fetchall())
    assert by_name(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_entry(spark):
    assert entry_point.entry(spark).count() == 5 * (25 + 5 + 200)
