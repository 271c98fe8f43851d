"""A maintained reduction of the facts: one row per year, service type and identifier, replaced year by year.

Totals of a year then read these rows instead of its facts. The store is partitioned by year; writing a year replaces its folder and
no other. Each year holds one row without identifier per type, so that a year whose facts are gone is replaced too.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrante.functions.numbers import row_sum
from quadrante.model import SERVICE_TYPES, ServiceType, Tables, service_type
from quadrante.operators.services import active_flag, component_measures

_SUMS = [c.column for st in SERVICE_TYPES.values() for c in st.components]
REDUCTION_SCHEMA = "tipo string, cnpj string, " + ", ".join(f"{c} bigint" for c in _SUMS) + ", ano int"


def _reduced(tables: Tables, st: ServiceType, years: Sequence[int], extended: bool) -> DataFrame:
    facts = tables.services(st.name).where(F.col("ano").isin([int(y) for y in years]) & F.col("cnpj").isNotNull())
    sums = [F.sum(row_sum(component_measures(st, c, extended))).alias(c.column) for c in st.components]
    return facts.groupBy("ano", "cnpj").agg(*sums).withColumn("tipo", F.lit(st.name))


def write_reduction(tables: Tables, path: str, years: Sequence[int], extended: bool = False) -> None:
    """Reduce the facts of these years and put them in the place of what the store holds of the same years."""
    if not years:
        raise ValueError("no year given")
    spark = tables.municipios.sparkSession
    present = spark.createDataFrame([(t, int(y)) for t in SERVICE_TYPES for y in sorted(set(years))], "tipo string, ano int")
    parts = [present, *(_reduced(tables, st, years, extended) for st in SERVICE_TYPES.values())]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = rows.select("tipo", "cnpj", *(F.col(c).cast("bigint").alias(c) for c in _SUMS), "ano")
    ordered = rows.repartitionByRange("ano", "cnpj").sortWithinPartitions("ano", "cnpj")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ano").parquet(path)


def reduced_year(spark: SparkSession, path: str, tipo: str, ano: int) -> DataFrame:
    """One row per identifier with a fact of this type in the year, as ``service_totals`` takes it; a year that was never written raises."""
    st = service_type(tipo)
    stored = spark.read.schema(REDUCTION_SCHEMA).parquet(path).where((F.col("ano") == F.lit(int(ano))) & (F.col("tipo") == st.name))
    if stored.where("cnpj is null").isEmpty():
        raise LookupError(f"{path} has no year {ano}")
    flag = F.lit(1).cast("bigint").alias(active_flag(st))
    return stored.where("cnpj is not null").select("cnpj", flag, *(c.column for c in st.components))
