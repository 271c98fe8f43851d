"""Star-schema source: files by path, or a relational database over JDBC."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadrante.model import OPTIONAL_COLUMNS, SCHEMAS, Tables
from quadrante.sources.rows import require_columns

#: Where ``write_tables`` describes the tables, and how.
DESCRIPTION = "esquema"
DESCRIPTION_SCHEMA = "tabela string, esquema string, arquivos bigint"

FILE_FORMATS = ("parquet", "csv", "json", "orc")

# Table names of the relational source.
DATABASE_TABLES = {
    "municipios": "Municipios",
    "credenciados": "Credenciados",
    "servicos_cfc": "ServicosCFC",
    "servicos_clinicas": "ServicosClinicas",
    "servicos_ecv": "ServicosECV",
    "servicos_epiv": "ServicosEPIV",
    "servicos_patio": "ServicosPatio",
    "populacao": "PopulacaoMunicipios",
    "frotas": "FrotasMunicipios",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project to the columns of the schema, in its types; a missing column raises ``ValueError``.

    Names match ignoring case, as the session resolves them. Optional columns are kept if present.
    """
    fields = list(SCHEMAS[table].fields)
    require_columns(df, [f.name for f in fields])
    present = {c.lower() for c in df.columns}
    fields += [f for f in OPTIONAL_COLUMNS.get(table, []) if f.name in present]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def _lazily(read: Callable[[str], DataFrame]) -> Tables:
    return Tables(**{name: partial(lambda n: conform(read(n), n), name) for name in Tables.names()})


def _described(spark: SparkSession, path: str) -> dict[str, tuple[StructType, int]] | None:
    """Schema and number of files of each table, as ``write_tables`` left them beside the tables; None where it did not."""
    try:
        rows = spark.read.schema(DESCRIPTION_SCHEMA).json(f"{path}/{DESCRIPTION}").collect()  # one row a table
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return {r["tabela"]: (StructType.fromJson(json.loads(r["esquema"])), r["arquivos"]) for r in rows}


def _load_described(spark: SparkSession, path: str, described: Mapping[str, tuple[StructType, int]], allow_empty: Sequence[str]) -> Tables:
    def read(name: str) -> DataFrame:
        if name not in described:
            raise FileNotFoundError(f"{path}/{DESCRIPTION} does not name {name}")
        schema, files = described[name]
        df = spark.read.schema(schema).parquet(f"{path}/{name}")
        found = len(df.inputFiles())
        if found < files and not (found == 0 and name in allow_empty):
            raise FileNotFoundError(f"{path}/{name} has {found} of {files} files")
        return df

    return _lazily(read)


def load_tables(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    optional: Sequence[str] = (),
    allow_empty: Sequence[str] = (),
) -> Tables:
    """Read ``{path}/{table}`` for each table.

    A star that ``write_tables`` wrote carries its schemas: it is read with these, so that no file is opened before a query runs, a
    table is looked at when it is first used, and one without rows is known from one without files, which raises.
    Other self-describing files bring their own schema and are cast; CSV (with header) and JSON are read as text
    columns and cast, so that no inference pass runs. These are looked at at once.

    JSON rows name their columns one by one, so an optional column is read from JSON only if ``optional``
    names it. A table without any file raises, as lost data must not read as zeros; ``allow_empty`` names
    the tables that may have none.
    """
    if fmt not in FILE_FORMATS:
        raise ValueError(f"unknown format {fmt!r}; expected one of {', '.join(FILE_FORMATS)}")
    described = _described(spark, path) if fmt == "parquet" else None
    if described is not None:
        return _load_described(spark, path, described, allow_empty)

    def read(name: str) -> DataFrame:
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.option("header", True)
        if fmt == "json":
            named = [f for f in OPTIONAL_COLUMNS.get(name, []) if f.name in optional]
            fields = [*SCHEMAS[name].fields, *named]
            reader = reader.schema(", ".join(f"{f.name} string" for f in fields))
        try:
            return reader.load(f"{path}/{name}")
        except AnalysisException as error:
            # A partitioned table without rows is a folder without files.
            if name not in allow_empty or error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            extra = [f for f in OPTIONAL_COLUMNS.get(name, []) if f.name in optional]
            return spark.createDataFrame([], StructType([*SCHEMAS[name].fields, *extra]))

    return Tables(**{name: conform(read(name), name) for name in Tables.names()})


def jdbc_url(host: str = "127.0.0.1", port: int = 3306, database: str = "", driver: str = "mysql") -> str:
    """The cursor option makes the driver send rows as they are fetched instead of a whole result at once."""
    return f"jdbc:{driver}://{host}:{port}/{database}?useUnicode=true&characterEncoding=UTF-8&useCursorFetch=true"


@dataclass(frozen=True)
class JdbcRange:
    """Disjoint reads of a table by ranges of an indexed integer column; the outer ranges are open."""

    column: str
    lower: int
    upper: int
    partitions: int

    def options(self) -> dict[str, object]:
        return {"column": self.column, "lowerBound": self.lower, "upperBound": self.upper, "numPartitions": self.partitions}


def key_ranges(column: str, cuts: Sequence[str]) -> list[str]:
    """Predicates that split a table at given values of an indexed text key; NULL keys are in the first."""
    quoted = ["'" + c.replace("'", "''") + "'" for c in cuts]
    if not quoted:
        return ["1 = 1"]
    middle = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(quoted, quoted[1:])]
    return [f"{column} < {quoted[0]} OR {column} IS NULL", *middle, f"{column} >= {quoted[-1]}"]


def equal_cuts(stored: DataFrame, column: str, partitions: int, width: int = 14) -> list[str]:
    """Values of a key of ``width`` digits that cut ``stored`` into so many ranges of about equal depth, for ``key_ranges``.

    The quantiles come from a sketch of fixed size over all rows; keys that are no numbers are left out of it, not out of the ranges. Where
    a single key fills several ranges its cut comes once, so there may be fewer.
    """
    if partitions < 1:
        raise ValueError("one partition at least")
    shares = [k / partitions for k in range(1, partitions)]
    if not shares:
        return []
    number = F.expr(f"try_cast({column} AS decimal({width}, 0))").cast("bigint")
    cuts = stored.select(F.percentile_approx(number, shares, 100 * partitions).alias("cuts")).first()["cuts"]  # at most ``partitions``
    return sorted({str(c).zfill(width) for c in cuts or []})


def load_tables_jdbc(
    spark: SparkSession,
    url: str,
    properties: Mapping[str, str],
    splits: Mapping[str, JdbcRange | Sequence[str]],
    table_names: Mapping[str, str] = DATABASE_TABLES,
    fetch_size: int = 10_000,
) -> Tables:
    """Read the tables from a database.

    ``splits`` gives the ranges (or predicates, see ``key_ranges``) by which a table is read in parallel. Fact
    tables must have one, as a single connection would be a single task; other tables may.
    """
    missing = [n for n in Tables.names() if n.startswith("servicos_") and n not in splits]
    if missing:
        raise ValueError(f"no split given for {', '.join(missing)}")
    options = {"fetchsize": str(fetch_size), **properties}

    def read(name: str) -> DataFrame:
        split = splits.get(name)
        if split is None:
            return spark.read.jdbc(url, table_names[name], properties=options)
        if isinstance(split, JdbcRange):
            return spark.read.jdbc(url, table_names[name], properties=options, **split.options())
        return spark.read.jdbc(url, table_names[name], predicates=list(split), properties=options)

    return _lazily(read)
