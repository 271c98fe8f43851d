"""Class breaks, colour buckets and legend rows of a choropleth map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrante.functions.numbers import format_number_ptbr
from quadrante.model import PALETTE

# Class breaks by largest metric value (upper bound, breaks).
FIXED_BREAKS = (
    (10, (0, 2, 5, 10)),
    (20, (0, 5, 10, 20)),
    (50, (0, 10, 20, 50)),
    (100, (0, 20, 50, 100)),
    (200, (0, 20, 50, 100, 200)),
    (500, (0, 50, 100, 200, 350, 500)),
    (1000, (0, 100, 200, 500, 750, 1000)),
)
# Classes above the table, and of fleets above the threshold.
PROPORTIONAL_CLASSES = 6
FLEET_CLASSES = 7
FLEET_THRESHOLD = 100_000


def _palette() -> Column:
    return F.expr(f"array({', '.join(repr(c) for c in PALETTE)})")


def _longs(values: tuple[int, ...]) -> str:
    return f"array({', '.join(f'{v}L' for v in values)})"


def _steps(largest: str, classes: int) -> str:
    """Multiples 0..classes of the smallest whole step that reaches the largest value."""
    return f"transform(sequence(0, {classes}), i -> i * (({largest} + {classes - 1}) div {classes}))"


def class_breaks(df: DataFrame, metric: str, fleet: bool = False) -> DataFrame:
    """One row ``(intervalos array<bigint>)`` from the largest value of ``metric``, NULL counting as 0.

    The maximum is a map-side combined aggregate and stays a frame; nothing is collected here. A
    frame without rows behaves as one whose largest value is 0. ``fleet`` switches on the finer
    proportional classes of large fleets.
    """
    zero = F.lit(0).cast("bigint")
    largest = df.agg(
        F.coalesce(F.max(F.coalesce(F.col(metric).cast("bigint"), zero)), zero).alias("_maximo")
    )
    cases = [f"WHEN _maximo <= {upper} THEN {_longs(fixed)}" for upper, fixed in FIXED_BREAKS]
    if fleet:
        cases.insert(0, f"WHEN _maximo > {FLEET_THRESHOLD} THEN {_steps('_maximo', FLEET_CLASSES)}")
    breaks = f"CASE {' '.join(cases)} ELSE {_steps('_maximo', PROPORTIONAL_CLASSES)} END"
    return largest.select(F.expr(breaks).alias("intervalos"))


def bucket(value: Column, breaks: Column) -> Column:
    """Position of the last break that ``value`` reaches, 0 below all of them."""
    reached = F.size(F.filter(breaks, lambda b: b <= value)) - 1
    return F.greatest(reached, F.lit(0))


def colour(bucket_col: Column) -> Column:
    return F.element_at(_palette(), bucket_col + 1)


def with_buckets(df: DataFrame, metric: str, breaks: DataFrame) -> DataFrame:
    """Add ``faixa`` and ``cor``. The one-row ``breaks`` enters as a scalar subquery, not as a join."""
    value = F.coalesce(F.col(metric).cast("bigint"), F.lit(0).cast("bigint"))
    placed = df.withColumn("_intervalos", breaks.scalar())
    placed = placed.withColumn("faixa", bucket(value, F.col("_intervalos")))
    return placed.withColumn("cor", colour(F.col("faixa"))).drop("_intervalos")


def legend(breaks: DataFrame) -> DataFrame:
    """Legend rows ``(ordem, de, ate, cor, texto)``; the last one is open-ended, ``ate`` NULL."""
    entries = breaks.select("intervalos", F.posexplode("intervalos").alias("ordem", "de"))
    upper = F.get("intervalos", F.col("ordem") + 1)
    closed = F.coalesce(upper, F.lit(0)) != 0
    return entries.select(
        "ordem",
        "de",
        upper.alias("ate"),
        colour(F.least(F.col("ordem"), F.lit(len(PALETTE) - 1))).alias("cor"),
        F.concat(
            format_number_ptbr(F.col("de")),
            F.when(closed, F.concat(F.lit(" – "), format_number_ptbr(upper))).otherwise(F.lit("+")),
        ).alias("texto"),
    )
