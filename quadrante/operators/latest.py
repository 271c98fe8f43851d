"""Per-key selection of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrante.operators.joins import lookup_join


def latest_per_key(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """All rows that carry the largest ``order_col`` of their key; ties stay, NULLs never match.

    The maximum combines on the map side and only then meets the rows again, which stay on the left
    of the join: a key that holds a large part of the table (or all of its ties) is never gathered
    into one task, as a window over the key would do.
    """
    keys = list(keys)
    rows = df.where(F.col(order_col).isNotNull())
    latest = rows.groupBy(*keys).agg(F.max(order_col).alias(order_col))
    return lookup_join(rows, latest, [*keys, order_col], "left_semi").select(*df.columns)


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Exactly one row per key: the first in ``order``, which must be a total order to be repeatable.

    Spark turns the ``row_number() = 1`` filter into a group limit below the shuffle, so each map
    task sends at most one row per key.
    """
    ranked = df.withColumn("_posicao", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_posicao") == 1).drop("_posicao")
