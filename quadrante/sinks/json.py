"""JSON result sink and star-schema sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadrante.model import Tables
from quadrante.sources.tables import DESCRIPTION, DESCRIPTION_SCHEMA

#: Columns by which single rows are looked up.
LOOKUP_COLUMNS = {"credenciados": ("cnpj", "razao_social")}
KEEP_NULLS = {"ignoreNullFields": "false"}


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row in column ``json``; NULL fields are kept as ``null``."""
    return df.select(F.to_json(F.struct(*df.columns), KEEP_NULLS).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write one JSON object per line, NULL fields included."""
    df.write.mode(mode).options(**KEEP_NULLS).json(path)


def _laid_out(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows sorted by ``keys`` over all files. A hash of the row comes last, so that a hot key is split over files too."""
    ordered = df.withColumn("_linha", F.xxhash64(*df.columns))
    return ordered.repartitionByRange(*keys, "_linha").sortWithinPartitions(*keys).drop("_linha")


def write_tables(tables: Tables, path: str, mode: str = "errorifexists", row_group_bytes: int = 32 << 20) -> None:
    """Write the tables as parquet, laid out for look-ups, with a description from which ``load_tables`` reads them.

    Tables with a year are partitioned by it. Facts are sorted by identifier within the year and entities over the whole table, so
    that the minima and maxima of files and row groups prune look-ups of an identifier or a range of them; Bloom filters do so
    for the names and identifiers of entities in any order. ``row_group_bytes`` is the most that such a look-up reads at once.
    """
    rows = []
    for name in Tables.names():
        df = getattr(tables, name)
        keys = [c for c in ("ano", "cnpj") if c in df.columns]
        if "cnpj" in keys:
            df = _laid_out(df, keys)
        elif keys:
            df = df.hint("rebalance", "ano")
        writer = df.write.mode(mode).option("parquet.block.size", row_group_bytes)
        for column in LOOKUP_COLUMNS.get(name, ()):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        if "ano" in df.columns:
            writer = writer.partitionBy("ano")
        writer.parquet(f"{path}/{name}")
        # As readers give it: columns of the files first, then that of the folders.
        schema = StructType([f for f in df.schema if f.name != "ano"] + [f for f in df.schema if f.name == "ano"])
        files = len(df.sparkSession.read.schema(schema).parquet(f"{path}/{name}").inputFiles())
        rows.append((name, schema.json(), files))
    described = tables.municipios.sparkSession.createDataFrame(rows, DESCRIPTION_SCHEMA)
    described.coalesce(1).write.mode("overwrite").json(f"{path}/{DESCRIPTION}")
