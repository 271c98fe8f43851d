"""Vehicle fleet: latest snapshot per area, nested and long forms."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrante.functions.numbers import row_sum_zero_filled, zero_if_null
from quadrante.model import VEHICLES, Tables
from quadrante.operators.joins import left_join_many, lookup_join

VEHICLE_COLUMNS = tuple(VEHICLES)


def latest_fleet(tables: Tables) -> DataFrame:
    """Every area with its population, the year of its latest fleet, the vehicle counts and their sum.

    The latest year is taken per area; several rows of that year all stay, and so do several
    population rows. Areas without a fleet have counts 0 and year NULL. Equal area rows stay apart.

    The latest year, one row per area, is attached to the areas first; the fleet rows follow by area and year.
    """
    fleet = tables.frotas.select("id_municipio", F.col("ano").alias("ano_frota"), *VEHICLE_COLUMNS)
    fleet = fleet.where(F.col("id_municipio").isNotNull() & F.col("ano_frota").isNotNull())
    years = fleet.groupBy("id_municipio").agg(F.max("ano_frota").alias("ano_frota"))
    areas = tables.municipios.select("id_municipio", F.col("nome").alias("nome_municipio"))
    population = tables.populacao.select("id_municipio", "populacao")
    settled = left_join_many(areas, population, ["id_municipio"])
    dated = lookup_join(settled, years, ["id_municipio"], "left")
    return left_join_many(dated, fleet, ["id_municipio", "ano_frota"]).select(
        "id_municipio",
        "nome_municipio",
        zero_if_null(F.col("populacao").cast("bigint")).alias("populacao"),
        "ano_frota",
        *[zero_if_null(F.col(v).cast("bigint")).alias(v) for v in VEHICLE_COLUMNS],
        row_sum_zero_filled(VEHICLE_COLUMNS).alias("total_frota"),
    )


def nest_fleet(fleet: DataFrame) -> DataFrame:
    """Replace the vehicle columns by the map ``detalhe_frota`` from label to count."""
    pairs = chain.from_iterable((F.lit(label), F.col(column)) for column, label in VEHICLES.items())
    kept = [c for c in fleet.columns if c not in VEHICLES]
    return fleet.select(*kept, F.create_map(*pairs).alias("detalhe_frota"))


def fleet_rows(fleet: DataFrame) -> DataFrame:
    """One row per area row and vehicle type: ``(id_municipio, ano_frota, ordem, tipo, quantidade)``."""
    lines = F.array(
        *[
            F.struct(F.lit(i).alias("ordem"), F.lit(label).alias("tipo"), F.col(column).alias("quantidade"))
            for i, (column, label) in enumerate(VEHICLES.items(), start=1)
        ]
    )
    return fleet.select("id_municipio", "ano_frota", F.inline(lines))
