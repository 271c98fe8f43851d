from __future__ import annotations

import re
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from quadrante.model import SCHEMAS, VEHICLES, Tables  # noqa: E402
from quadrante.sources import conform  # noqa: E402

TESTDATA = Path("/root/testdata")
SOURCE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def fixture_blocks(kind: str) -> dict[str, str]:
    """The SQL blocks ``-- kind:name`` of FIXTURES.md."""
    text = (ROOT / "FIXTURES.md").read_text(encoding="utf8")
    blocks = re.findall(rf"-- {kind}:(\w+)\n(.*?)(?=-- {kind}:|```)", text, re.S)
    return {name: sql.strip() for name, sql in blocks if name != "end"}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


@pytest.fixture(scope="session")
def golden(spark) -> Tables:
    blocks = fixture_blocks("golden")
    frames = {
        name: conform(spark.sql(blocks[name]), name) if name in blocks else empty(spark, name)
        for name in Tables.names()
    }
    return Tables(**frames)


@pytest.fixture(scope="session")
def fixture_views(spark) -> Tables:
    """The proxy views of FIXTURES.md over the sf0.01 tables; three inspection measures, rest 0."""
    for table in ("nation", "supplier", "customer", "orders", "lineitem"):
        spark.read.parquet(str(TESTDATA / "sf0.01" / f"{table}.parquet")).createOrReplaceTempView(table)
    frames = {}
    for name, sql in fixture_blocks("proxy").items():
        df = spark.sql(sql)
        if name == "servicos_ecv":
            measures = [f.name for f in SCHEMAS[name].fields[2:]]
            given = ["vistoria_a", "vistoria_b", "vistoria_c"]
            df = df.select(
                "cnpj",
                "ano",
                *[F.col(g).alias(m) for g, m in zip(given, measures)],
                *[F.lit(0).alias(m) for m in measures[len(given):]],
            )
        frames[name] = conform(df, name)
    return Tables(**frames)


@pytest.fixture(scope="session")
def duck_sources():
    """A DuckDB connection with the source tables at sf0.001 as views."""
    con = duckdb.connect()
    for table in SOURCE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TESTDATA}/sf0.001/{table}.parquet'")
    return con


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)


def by_name(columns: list[str], values: list[tuple]) -> list[str]:
    """Rows with columns in name order, sorted, as text: comparable across engines."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(v[i] for i in order)) for v in values)


VEHICLE_NAMES = list(VEHICLES)
