"""Breaks at every threshold, buckets, legend rows and number texts."""

from __future__ import annotations

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quadrante.functions import format_number_ptbr
from quadrante.model import PALETTE
from quadrante.operators import class_breaks, legend, with_buckets


def expected_breaks(largest: int, fleet: bool) -> list[int]:
    if fleet and largest > 100_000:
        step = math.ceil(largest / 7)
        return [i * step for i in range(8)]
    table = {
        10: [0, 2, 5, 10],
        20: [0, 5, 10, 20],
        50: [0, 10, 20, 50],
        100: [0, 20, 50, 100],
        200: [0, 20, 50, 100, 200],
        500: [0, 50, 100, 200, 350, 500],
        1000: [0, 100, 200, 500, 750, 1000],
    }
    for upper, fixed in table.items():
        if largest <= upper:
            return fixed
    step = math.ceil(largest / 6)
    return [i * step for i in range(7)]


EDGES = [-5, 0, 10, 11, 20, 21, 50, 51, 100, 101, 150, 200, 201, 500, 501, 1000, 1001, 100_000, 100_001, 700_001]


@pytest.mark.parametrize("fleet", [False, True])
def test_breaks_at_every_edge(spark, fleet):
    # One job: the breaks of each edge, side by side.
    got = None
    for edge in EDGES:
        df = spark.createDataFrame([(edge,), (None,), (-9,)], "v bigint")
        one = class_breaks(df, "v", fleet).select(F.lit(edge).alias("edge"), "intervalos")
        got = one if got is None else got.unionByName(one)
    assert {r["edge"]: r["intervalos"] for r in got.collect()} == {
        e: expected_breaks(max(e, 0), fleet) for e in EDGES
    }


def test_breaks_without_rows(spark):
    assert class_breaks(spark.createDataFrame([], "v bigint"), "v").head()[0] == [0, 2, 5, 10]
    assert class_breaks(spark.createDataFrame([(None,)], "v bigint"), "v", True).head()[0] == [0, 2, 5, 10]


def test_buckets_clamp_at_both_ends(spark):
    values = spark.createDataFrame([(-1,), (0,), (3,), (10,), (99,), (None,)], "v bigint")
    breaks = spark.range(1).select(F.array(*[F.lit(b).cast("bigint") for b in (0, 2, 5, 10)]).alias("intervalos"))
    got = {r["v"]: (r["faixa"], r["cor"]) for r in with_buckets(values, "v", breaks).collect()}
    assert {v: b for v, (b, _) in got.items()} == {-1: 0, 0: 0, 3: 1, 10: 3, 99: 3, None: 0}
    assert all(c == PALETTE[b] for b, c in got.values())


def test_legend(spark):
    breaks = class_breaks(spark.createDataFrame([(700_001,)], "v bigint"), "v", fleet=True)
    got = rows(legend(breaks))
    assert len(got) == 8
    assert got[0] == (0, 0, 100_001, PALETTE[0], "0 – 100.001")
    assert got[-1] == (7, 700_007, None, PALETTE[7], "700.007+")


def test_legend_without_breaks(spark):
    none = spark.range(1).select(F.array().cast("array<bigint>").alias("intervalos"))
    assert rows(legend(none)) == []


def test_legend_colour_stops_at_the_palette_end(spark):
    many = spark.range(1).select(F.sequence(F.lit(0), F.lit(9)).cast("array<bigint>").alias("intervalos"))
    assert [r[3] for r in rows(legend(many))][-2:] == [PALETTE[7], PALETTE[7]]


@pytest.mark.parametrize(
    "value, text",
    [(0, "0"), (None, "0"), (999, "999"), (1000, "1.000"), (1234567, "1.234.567"), (-1234, "-1.234"), (1234567.5, "1.234.567,5"), (0.1256, "0,126")],
)
def test_number_text(spark, value, text):
    kind = "double" if isinstance(value, float) else "bigint"
    df = spark.createDataFrame([(value,)], f"v {kind}")
    assert df.select(format_number_ptbr(F.col("v"))).head()[0] == text
