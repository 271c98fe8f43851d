"""Overview: entity totals enriched with the fleet, one row per area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrante.functions.numbers import format_number_ptbr
from quadrante.model import Tables, map_view
from quadrante.operators.entities import entity_totals
from quadrante.operators.fleet import VEHICLE_COLUMNS, latest_fleet, nest_fleet
from quadrante.operators.latest import one_per_key

# Captions of the header facts.
HEADER_LABELS = {"populacao": "População", "total_frota": "Frota Total"}


def one_total_per_area(tables: Tables) -> DataFrame:
    """Entity totals keyed by area: of several rows, the one with the largest population, then total."""
    order = [F.desc("populacao"), F.desc("total_credenciados"), F.asc("nome_municipio")]
    return one_per_key(entity_totals(tables), ["id_municipio"], order)


def one_fleet_per_area(tables: Tables) -> DataFrame:
    """Latest fleet keyed by area: of several rows, the one with the largest fleet.

    Equal totals are settled by the vehicle counts, then population and name, so that the choice
    does not depend on row order.
    """
    order = [F.desc("total_frota"), *[F.desc(v) for v in VEHICLE_COLUMNS], F.desc("populacao"),
             F.asc("nome_municipio")]
    return one_per_key(latest_fleet(tables), ["id_municipio"], order)


def overview(tables: Tables) -> DataFrame:
    """Entity totals with ``total_frota`` and ``detalhe_frota``; areas only on the fleet side are not added."""
    fleet = nest_fleet(one_fleet_per_area(tables)).select("id_municipio", "total_frota", "detalhe_frota")
    return one_total_per_area(tables).join(fleet, "id_municipio", "left")


def header_facts(tables: Tables, view: str = "visao_geral") -> DataFrame:
    """Headline rows ``(id_municipio, ordem, rotulo, valor, texto)`` of an area's panel.

    The overview shows population and fleet, the fleet view the fleet only, other views nothing.
    Facts that an area lacks give no row.
    """
    v = map_view(view)
    if v.name == "frota_total":
        source, shown = one_fleet_per_area(tables), ("total_frota",)
    else:
        fleet = one_fleet_per_area(tables).select("id_municipio", "total_frota")
        source = one_total_per_area(tables).join(fleet, "id_municipio", "left")
        shown = ("populacao", "total_frota")
        if v.name != "visao_geral":
            source = source.where(F.lit(False))
    lines = F.array(
        *[
            F.struct(F.lit(i).alias("ordem"), F.lit(HEADER_LABELS[c]).alias("rotulo"), F.col(c).alias("valor"))
            for i, c in enumerate(shown, start=1)
        ]
    )
    rows = source.select("id_municipio", F.inline(lines)).where(F.col("valor").isNotNull())
    return rows.withColumn("texto", format_number_ptbr(F.col("valor")))
