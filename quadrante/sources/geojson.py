"""GeoJSON feature source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = "features array<struct<properties:struct<id:string,name:string>>>"


FEATURE = "properties struct<id:string,name:string>"


def parse_features(df: DataFrame, column: str) -> DataFrame:
    """``(id, name)`` of every feature of the collections in a text column; malformed text raises."""
    parsed = F.from_json(F.col(column), FEATURES, {"mode": "FAILFAST"})
    return df.select(parsed.alias("_c")).select(F.inline("_c.features")).select("properties.id", "properties.name")


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(id, name)`` from files of one feature per line, which, unlike one collection, can be split."""
    return spark.read.schema(FEATURE).option("mode", "FAILFAST").json(path).select("properties.id", "properties.name")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """``(id, name)`` of every feature. The schema leaves geometry out, so it is never materialised."""
    collection = spark.read.schema(FEATURES).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return collection.select(F.inline("features")).select("properties.id", "properties.name")
