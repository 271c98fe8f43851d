"""Entity list and entity counts.

All joins with facts run on ``cnpj``. Both sides are reduced first - facts to one row per cnpj,
entities to one row per (cnpj, area) - with a map-side combine, so that neither a cnpj with very
many facts nor a heavily repeated entity row travels through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrante.functions.text import order_by_name
from quadrante.model import DEFAULT_YEAR, SERVICE_TYPES, Tables, service_type
from quadrante.operators.areas import distinct_areas, with_area_names
from quadrante.operators.joins import left_join_many, lookup_join, semi_join_within


def entity_rows(tables: Tables) -> DataFrame:
    """Distinct entities with the name of their area, unsorted; entities of unknown areas drop out.

    The distinct comes before the join, as it combines on the map side.
    """
    entities = tables.credenciados.select("id_municipio", "cnpj", "razao_social").distinct()
    areas = distinct_areas(tables).select("id_municipio", F.col("nome").alias("nome_municipio"))
    return lookup_join(entities, areas, ["id_municipio"])


def entity_list(tables: Tables) -> DataFrame:
    """Distinct ``(id_municipio, cnpj, razao_social, nome_municipio)``, by legal name."""
    return order_by_name(entity_rows(tables), "razao_social")


def entity_areas(tables: Tables) -> DataFrame:
    """Distinct ``(id_municipio, cnpj)``."""
    known = tables.credenciados.where(F.col("cnpj").isNotNull() & F.col("id_municipio").isNotNull())
    return known.select("id_municipio", "cnpj").distinct()


def active_entities(
    tables: Tables, tipo: str, ano: int = DEFAULT_YEAR, only: DataFrame | None = None
) -> DataFrame:
    """Distinct cnpj with a fact of this type in the year; among those of ``only``, if given."""
    facts = tables.services(tipo).where((F.col("ano") == F.lit(ano)) & F.col("cnpj").isNotNull())
    if only is not None:
        facts = semi_join_within(facts, only, "cnpj")
    return facts.select("cnpj").distinct()


def entity_totals(tables: Tables) -> DataFrame:
    """Distinct entities per area and population; two populations of one area give two rows."""
    counts = (
        entity_areas(tables)
        .groupBy("id_municipio")
        .agg(F.count(F.lit(1)).alias("total_credenciados"))
    )
    population = tables.populacao.select("id_municipio", "populacao").distinct()
    zero = F.lit(0).cast("bigint")
    # The populations come first: what they multiply is then on the left of the next join, where Spark can split it.
    populated = left_join_many(distinct_areas(tables), population, ["id_municipio"])
    return lookup_join(populated, counts, ["id_municipio"], "left").select(
        "id_municipio",
        F.col("nome").alias("nome_municipio"),
        F.coalesce("total_credenciados", zero).alias("total_credenciados"),
        F.coalesce(F.col("populacao").cast("bigint"), zero).alias("populacao"),
    )


def entities_with_service(tables: Tables, tipo: str, ano: int = DEFAULT_YEAR) -> DataFrame:
    """Per area, how many distinct entities have a fact of this type in the year."""
    st = service_type(tipo)
    active = lookup_join(entity_areas(tables), active_entities(tables, st.name, ano), ["cnpj"], "left_semi")
    counts = active.groupBy("id_municipio").agg(F.count(F.lit(1)).alias(st.count_column))
    return with_area_names(tables, counts, sums=(), counts=(st.count_column,))


def service_entities(
    tables: Tables, tipo: str, ano: int = DEFAULT_YEAR, id_municipio: int | None = None
) -> DataFrame:
    """Distinct ``(id_municipio, cnpj, razao_social)`` with a fact of this type in the year.

    An unknown type gives no rows. Give ``id_municipio`` for one area, sort with
    ``order_by_name(df, "razao_social")``.
    """
    entities = tables.credenciados.select("id_municipio", "cnpj", "razao_social")
    entities = entities.where(F.col("id_municipio").isNotNull())
    only = None
    if id_municipio is not None:
        entities = entities.where(F.col("id_municipio") == F.lit(int(id_municipio)))
        only = entities.select("cnpj")
    if (tipo or "").lower() not in SERVICE_TYPES:
        return entities.where(F.lit(False))
    active = lookup_join(entities.distinct(), active_entities(tables, tipo, ano, only), ["cnpj"], "left_semi")
    return active.select("id_municipio", "cnpj", "razao_social")
