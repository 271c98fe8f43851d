"""JSON row source and column checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Raise ``ValueError`` naming the columns that ``df`` lacks. Looks at the schema only."""
    present = {c.lower() for c in df.columns}
    missing = [n for n in names if n.lower() not in present]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def parse_json_rows(df: DataFrame, column: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """The other columns of ``df`` with those decoded from JSON objects in a text column; malformed text raises."""
    parsed = df.withColumn(column, F.from_json(F.col(column), schema, {"mode": "FAILFAST"}))
    others = [F.col(c) for c in df.columns if c != column]
    return require_columns(parsed.select(*others, f"{column}.*"), required)


_CORRUPT = "_texto_invalido"


def decode_json_rows(df: DataFrame, column: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """Like ``parse_json_rows``, but no row is lost and none raises: the text stays in its column, and ``motivo`` says why it was not
    decoded (NULL where it was): it is missing, it is no JSON object of this schema, or a required column is absent or null.
    """
    fields = StructType.fromDDL(schema)
    require_columns(df.sparkSession.createDataFrame([], fields), required)
    wide = StructType([*fields.fields]).add(_CORRUPT, StringType())
    parsed = df.withColumn("_lido", F.from_json(F.col(column), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}))
    reason = F.when(F.col(column).isNull(), "texto ausente")
    reason = reason.when(F.col("_lido").isNull() | F.col(f"_lido.{_CORRUPT}").isNotNull(), "JSON inválido")
    for name in required:
        reason = reason.when(F.col(f"_lido.{name}").isNull(), f"coluna ausente: {name}")
    return parsed.select(*df.columns, *(F.col(f"_lido.{f.name}").alias(f.name) for f in fields), reason.alias("motivo"))


def accepted_rows(decoded: DataFrame, column: str) -> DataFrame:
    """The rows that ``decode_json_rows`` could read, as ``parse_json_rows`` gives them."""
    return decoded.where(F.col("motivo").isNull()).drop(column, "motivo")


def rejected_rows(decoded: DataFrame, column: str, schema: str) -> DataFrame:
    """The others, with their text and the reason: together with the accepted ones all that went in."""
    return decoded.where(F.col("motivo").isNotNull()).drop(*(f.name for f in StructType.fromDDL(schema)))


def read_json_rows(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    required: Sequence[str] = (),
    one_document: bool = False,
) -> DataFrame:
    """Read rows from JSON: one object per line, or (``one_document``) files holding one array each.

    Malformed input raises when read. Give a schema for large inputs: without one Spark reads the
    data twice. A file that is one array cannot be split, so line form is the one that scales.
    """
    reader = spark.read.option("mode", "FAILFAST").option("multiLine", one_document)
    if schema is not None:
        reader = reader.schema(schema)
    return require_columns(reader.json(path), required)
