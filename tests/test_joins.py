"""Joins keep every match, whatever the key types, and NULL keys never match."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quadrante import operators as ops
from quadrante.operators.joins import left_join_many, lookup_join


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (7, "e")], "k int, v string")


@pytest.mark.parametrize("kind", ["int", "bigint", "double", "string", "decimal(10,2)"])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_lookup_join_equals_a_plain_join(spark, left, kind, how):
    lookup = spark.range(1, 4).select(F.col("id").cast(kind).alias("k"), F.concat(F.lit("x"), "id").alias("w"))
    nulls = spark.createDataFrame([(None, "n")], "k int, w string").select(F.col("k").cast(kind), "w")
    lookup = lookup.unionByName(nulls)
    got = lookup_join(left, lookup, ["k"], how)
    assert rows(got) == rows(left.join(lookup, ["k"], how)) and len(rows(got)) >= 3


def test_collated_keys_match_under_their_collation(spark):
    a = spark.sql("SELECT collate('ABC', 'UTF8_LCASE') AS k, 1 AS v")
    b = spark.sql("SELECT collate('abc', 'UTF8_LCASE') AS k, 2 AS w")
    assert len(rows(lookup_join(a, b, ["k"]))) == 1


def test_left_join_many_equals_a_left_join(spark, left):
    one = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r"), (None, "s")], "k int, n string")
    got = left_join_many(one, left, ["k"]).select("k", "n", "v")
    assert rows(got) == rows(one.join(left, ["k"], "left").select("k", "n", "v"))


def test_tables_with_mixed_id_types(golden):
    from dataclasses import replace

    mixed = replace(
        golden,
        credenciados=golden.credenciados.withColumn("id_municipio", F.col("id_municipio").cast("bigint")),
        populacao=golden.populacao.withColumn("id_municipio", F.col("id_municipio").cast("bigint")),
    )
    assert rows(ops.entity_totals(mixed), "id_municipio", "total_credenciados", "populacao") == rows(
        ops.entity_totals(golden), "id_municipio", "total_credenciados", "populacao"
    )
    assert len(rows(ops.entity_rows(mixed))) == 5
    assert len(rows(ops.latest_fleet(mixed))) == 7
