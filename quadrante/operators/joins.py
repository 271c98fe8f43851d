"""Joins that stay splittable when one key holds a large share of the rows.

Adaptive execution cuts a skewed partition of a sort-merge join into pieces, but only on a side the
join type allows (the left one, for left and semi joins) and only if both inputs come straight from
a shuffle made for this join. A look-up that was aggregated by the join key is already partitioned
by it and gets no such shuffle, which would leave a hot key of the other side to a single task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPREAD = "_espalhamento"
_HOT, _FOUND = "_quente", "_achado"

#: A key is hot from this part of the rows on; its rows are dealt over as many places.
HOT_KEYS = 32
#: Keys that the sketch of hot keys counts at a time.
TRACKED_KEYS = 4096

# Key types whose equal values have equal hashes (unlike floats or collated strings).
_HASHABLE = {"string", "tinyint", "smallint", "int", "bigint", "date"}


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``rows``, in which keys may be hot, to a ``lookup`` with few rows per key.

    A second join key, a function of the first, makes Spark shuffle the (already reduced) look-up
    for the join, so that hot partitions of ``rows`` can be split. Where Spark finds one side small
    enough to broadcast, neither side is shuffled and the extra key costs nothing. Keys that differ
    in type, or are of a type not safe to hash, are joined plainly.
    """
    left, right = ({c.lower(): t for c, t in df.dtypes} for df in (rows, lookup))
    types = [(left[k.lower()], right[k.lower()]) for k in keys]
    if any(a != b or a not in _HASHABLE for a, b in types):
        return rows.join(lookup, list(keys), how)
    spread = F.xxhash64(*keys)
    joined = rows.withColumn(_SPREAD, spread).join(lookup.withColumn(_SPREAD, spread), [*keys, _SPREAD], how)
    return joined.drop(_SPREAD)


def _null_free(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def hot_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: hashes of the keys that hold more than one part in ``HOT_KEYS`` of ``rows``, from a sketch of fixed size.

    The sketch counts an item too often at most, never misses one of that size, and no item is in it that is not in the rows.
    """
    hashes = rows.where(_null_free(keys)).select(F.xxhash64(*keys).alias("h"))
    found = hashes.agg(F.expr(f"approx_top_k(h, {HOT_KEYS}, {TRACKED_KEYS})").alias("top"), F.count("*").alias("n"))
    large = F.filter("top", lambda x: x["count"] * HOT_KEYS > F.col("n"))
    return found.select(F.coalesce(F.transform(large, lambda x: x["item"]), F.array().cast("array<bigint>")).alias("hot"))


def left_join_many(one: DataFrame, many: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``one LEFT JOIN many`` where ``many`` has the hot keys; each side is read and shuffled once.

    The right side of a left join cannot be split, so the rows of hot keys are dealt over ``HOT_KEYS`` places by a hash of the row, and
    the rows of ``one`` with such keys go to each of these. A place that got none gives no row: a hot key is known to
    have rows in another. Equal rows go to one place; make them distinct before where a key may hold many of them. Keys that differ in
    type, or are of a type not safe to hash, are joined plainly.
    """
    left, right = ({c.lower(): t for c, t in df.dtypes} for df in (one, many))
    types = [(left[k.lower()], right[k.lower()]) for k in keys]
    if any(a != b or a not in _HASHABLE for a, b in types):
        return one.join(many, list(keys), "left")
    hot = hot_keys(many, keys)
    is_hot = F.coalesce(F.array_contains(hot.scalar(), F.xxhash64(*keys)) & _null_free(keys), F.lit(False))
    places = F.when(F.col(_HOT), F.sequence(F.lit(0), F.lit(HOT_KEYS - 1))).otherwise(F.array(F.lit(0)))
    spread = one.withColumn(_HOT, is_hot).withColumn(_SPREAD, F.explode(places))
    place = F.when(is_hot, F.pmod(F.xxhash64(*many.columns), F.lit(HOT_KEYS))).otherwise(F.lit(0)).cast("int")
    dealt = many.withColumn(_SPREAD, place).withColumn(_FOUND, F.lit(True))
    joined = spread.join(dealt, [*keys, _SPREAD], "left")
    return joined.where(F.col(_FOUND).isNotNull() | ~F.col(_HOT)).drop(_SPREAD, _HOT, _FOUND)


def semi_join_within(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key is in ``few``, which Spark reads with the least and the largest of those keys as filters.

    Where the rows are stored in the order of the key, files and row groups outside that range are not read.
    """
    least, largest = few.agg(F.min(key).alias("end")), few.agg(F.max(key).alias("end"))
    # The test has no effect; without it Spark merges both subqueries into one of two fields, and does not push fields to the scan.
    largest = largest.where("end is not null")
    inside = (F.col(key) >= least.scalar()) & (F.col(key) <= largest.scalar())
    return rows.where(inside).join(few, key, "left_semi")
