"""The star schema derived from whole TPC-H-like tables, for checks and timing.

Every table below is a projection or an aggregate of complete source tables:

* areas are all nations, all regions under ids from 1000 (they have no entities: empty areas) and all
  parts under ids from 100000, so that the number of areas grows with the data;
* entities are all suppliers and all customers, in their nation, and the users of all events, in the
  part area numbered as the event. A supplier, a customer and a user with the same key share one
  identifier under several names and areas (many-to-many, fan-out); events beyond the number of parts
  lie in areas that do not exist (orphans);
* facts are all line items keyed by supplier (driving schools), part (inspections) or order (plate
  stamping), and all orders keyed by customer (clinics) or order (yards); keys without an entity
  are orphans, entities without a key have no service, and NULL measures occur throughout;
* population counts all customers of a nation; fleets count all orders of a nation by year and
  status, so a year has several rows (ties), and pending orders have no year.
"""

from __future__ import annotations

from functools import cache, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrante.functions.text import format_cnpj
from quadrante.model import INSPECTION_EXTRA, INSPECTION_MEASURES, Tables
from quadrante.sources import conform

YEAR = 2000
REGION_OFFSET = 1000
PART_OFFSET = 100_000
UNMAPPED_OFFSET = 2000

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _key(name: str) -> Column:
    return F.col(name).cast("string").alias("cnpj")


def _year(name: str) -> Column:
    return F.year(name).alias("ano")


def _percent(name: str) -> Column:
    """Whole percent of a rate, NULL where the rate is 0."""
    return F.nullif(F.round(F.col(name) * 100).cast("bigint"), F.lit(0).cast("bigint"))


def _long(name: str) -> Column:
    return F.col(name).cast("bigint")


def _count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))


class _Registry:
    """The source tables, each opened at most once, and the tables of the star derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.source = cache(lambda table: _read(spark, sf_dir, table))

    def municipios(self) -> DataFrame:
        areas = self.source("nation").select(F.col("n_nationkey").cast("int").alias("id_municipio"), F.col("n_name").alias("nome"))
        regions = self.source("region").select(
            (F.col("r_regionkey") + REGION_OFFSET).cast("int").alias("id_municipio"), F.col("r_name").alias("nome")
        )
        districts = self.source("part").select(
            (F.col("p_partkey") + PART_OFFSET).cast("int").alias("id_municipio"), F.col("p_name").alias("nome")
        )
        return areas.unionByName(regions).unionByName(districts)

    def credenciados(self) -> DataFrame:
        suppliers, customers = (
            self.source(table).select(
                _key(f"{x}_{key}"), F.col(f"{x}_name").alias("razao_social"), F.col(f"{x}_nationkey").cast("int").alias("id_municipio")
            )
            for table, x, key in (("supplier", "s", "suppkey"), ("customer", "c", "custkey"))
        )
        users = self.source("events").select(
            _key("user_id"),
            F.concat(F.lit("User#"), F.col("user_id")).alias("razao_social"),
            (F.col("event_id") + PART_OFFSET).cast("int").alias("id_municipio"),
        )
        return suppliers.unionByName(customers).unionByName(users)

    def servicos_cfc(self) -> DataFrame:
        quantity = _long("l_quantity")
        return self.source("lineitem").select(
            _key("l_suppkey"),
            _year("l_shipdate"),
            F.when(F.col("l_linestatus") == "O", quantity).alias("cursos_teoricos"),
            F.when(F.col("l_linestatus") == "F", quantity).alias("cursos_praticos"),
        )

    def servicos_clinicas(self) -> DataFrame:
        return self.source("orders").select(
            _key("o_custkey"),
            _year("o_orderdate"),
            F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("exames_medicos"),
            F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 5000).cast("bigint")).alias(
                "exames_psicologicos"
            ),
        )

    def servicos_ecv(self) -> DataFrame:
        quantity, zero = _long("l_quantity"), F.lit(0).cast("bigint")
        inspections = [
            quantity,
            _long("l_linenumber"),
            _percent("l_tax"),
            *(F.when(F.col("l_returnflag") == flag, quantity).otherwise(zero) for flag in "ANR"),
            *(F.when(F.col("l_linestatus") == status, _long("l_linenumber")).otherwise(zero) for status in "OF"),
            F.month("l_shipdate").cast("bigint"),
            F.dayofmonth("l_shipdate").cast("bigint"),
            F.floor(F.col("l_extendedprice") / 10000).cast("bigint"),
        ]
        return self.source("lineitem").select(
            _key("l_partkey"),
            _year("l_shipdate"),
            *[c.alias(n) for c, n in zip(inspections, INSPECTION_MEASURES)],
            _percent("l_discount").alias(INSPECTION_EXTRA),
        )

    def servicos_epiv(self) -> DataFrame:
        return self.source("lineitem").select(_key("l_orderkey"), _year("l_shipdate"), _long("l_linenumber").alias("estampagens"))

    def servicos_patio(self) -> DataFrame:
        return self.source("orders").select(
            _key("o_orderkey"),
            _year("o_orderdate"),
            F.when(F.col("o_orderstatus") == "F", F.floor(F.col("o_totalprice") / 10000).cast("bigint"))
            .when(F.col("o_orderstatus") == "O", F.lit(1).cast("bigint"))
            .alias("veiculos_removidos"),
        )

    def populacao(self) -> DataFrame:
        areas = self.source("customer").groupBy(F.col("c_nationkey").cast("int").alias("id_municipio"))
        return areas.agg((F.count(F.lit(1)) * 1000).alias("populacao"))

    def frotas(self) -> DataFrame:
        customers = self.source("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        placed = self.source("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
        year = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate"))
        fleet = placed.groupBy(F.col("c_nationkey").cast("int").alias("id_municipio"), year.alias("ano"), "o_orderstatus")
        return fleet.agg(
            F.nullif(_count_if(F.col("o_orderpriority") == PRIORITIES[0]), F.lit(0).cast("bigint")).alias("automovel"),
            *[
                _count_if(F.col("o_orderpriority") == p).alias(c)
                for p, c in zip(PRIORITIES[1:], ("caminhao", "caminhoneta_caminhonete", "microonibus", "moto"))
            ],
            *[
                _count_if(F.col("c_mktsegment") == s).alias(c)
                for s, c in zip(SEGMENTS, ("motor_casa", "onibus", "reboque_semireboque", "trator", "outros"))
            ],
        ).drop("o_orderstatus")


def registry_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The nine tables, projected to their schemas as a source would be; a query opens only the files of those it uses."""
    registry = _Registry(spark, sf_dir)
    return Tables(**{name: partial(lambda n: conform(getattr(registry, n)(), n), name) for name in Tables.names()})


def formatted_entities(tables: Tables) -> DataFrame:
    """The entities with their identifier stored formatted, as identifier look-ups expect it."""
    return tables.credenciados.withColumn("cnpj", format_cnpj(F.col("cnpj")))


def registry_features(spark: SparkSession, sf_dir: str, tables: Tables | None = None) -> DataFrame:
    """Map features ``(id, name)``: all areas (of ``tables``, if they are at hand), and all regions once more under ids that no area has."""
    areas = (tables or registry_tables(spark, sf_dir)).municipios
    region = _read(spark, sf_dir, "region")
    mapped = areas.select(F.col("id_municipio").cast("string").alias("id"), F.col("nome").alias("name"))
    unmapped = region.select(
        (F.col("r_regionkey") + UNMAPPED_OFFSET).cast("string").alias("id"), F.col("r_name").alias("name")
    )
    return mapped.unionByName(unmapped)
