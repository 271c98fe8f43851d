"""Service totals per area.

The reduction order is: facts of the year -> one row per cnpj (all wanted types side by side, one
shuffle) -> joined to one row per (cnpj, area) that knows how often the entity is repeated -> one
row per area. A repeated entity row repeats its services, hence the multiplication by its copies.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrante.functions.numbers import row_sum, zero_if_null
from quadrante.model import (
    DEFAULT_YEAR,
    INSPECTION_EXTRA,
    SERVICE_TYPES,
    Component,
    ServiceType,
    Tables,
    map_view,
    service_type,
)
from quadrante.operators.areas import distinct_areas, with_area_names
from quadrante.operators.joins import lookup_join, semi_join_within

DETAIL_TYPE = "array<struct<tipo:string,quantidade:bigint>>"


def active_flag(st: ServiceType) -> str:
    return f"_{st.name}_ativo"


def component_measures(st: ServiceType, component: Component, extended: bool) -> tuple[str, ...]:
    """The measures of a component; ``extended`` adds the disputed twelfth inspection measure."""
    extra = (INSPECTION_EXTRA,) if extended and st.name == "ecv" else ()
    return component.measures + extra


def _facts_of_year(
    tables: Tables, st: ServiceType, ano: int, extended: bool, only: DataFrame | None
) -> DataFrame:
    facts = tables.services(st.name).where((F.col("ano") == F.lit(ano)) & F.col("cnpj").isNotNull())
    if extended and st.name == "ecv" and INSPECTION_EXTRA not in facts.columns:
        raise ValueError(f"{st.table} has no column {INSPECTION_EXTRA}")
    if only is not None:
        facts = semi_join_within(facts, only, "cnpj")
    return facts.select(
        "cnpj",
        F.lit(1).cast("bigint").alias(active_flag(st)),
        *[row_sum(component_measures(st, c, extended)).alias(c.column) for c in st.components],
    )


def entity_year(
    tables: Tables,
    types: Sequence[ServiceType],
    ano: int = DEFAULT_YEAR,
    extended: bool = False,
    only: DataFrame | None = None,
) -> DataFrame:
    """One row per cnpj: for every type an activity flag (NULL if inactive) and its summed quantities.

    A fact with a NULL measure leaves the sum of its component as a whole. ``only``, a frame of cnpj, keeps
    the facts of these before they are reduced; for the few of one area Spark broadcasts them by size.
    """
    parts = [_facts_of_year(tables, st, ano, extended, only) for st in types]
    facts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    sums = [c.column for st in types for c in st.components]
    return facts.groupBy("cnpj").agg(
        *[F.max(active_flag(st)).alias(active_flag(st)) for st in types],
        *[F.sum(c).alias(c) for c in sums],
    )


def entity_copies(tables: Tables, *extra: str) -> DataFrame:
    """One row per (cnpj, area[, extra columns]) with the number of entity rows behind it."""
    known = tables.credenciados.where(F.col("cnpj").isNotNull() & F.col("id_municipio").isNotNull())
    return known.groupBy("cnpj", "id_municipio", *extra).agg(F.count(F.lit(1)).alias("_repetidas"))


def repeated_sums(types: Sequence[ServiceType]) -> list[Column]:
    """Aggregates that count the quantities of an entity once per copy of its row."""
    return [
        F.sum(F.col(c.column) * F.col("_repetidas")).alias(c.column) for st in types for c in st.components
    ]


def area_sums(
    tables: Tables,
    types: Sequence[ServiceType],
    ano: int = DEFAULT_YEAR,
    extended: bool = False,
    id_municipio: int | None = None,
    yearly: DataFrame | None = None,
) -> DataFrame:
    """One row per area with services: the summed quantities of the given types (may be NULL).

    ``yearly``: a frame of ``reduced_year``, read in place of the facts.
    """
    entities, only = entity_copies(tables), None
    if id_municipio is not None:
        entities = entities.where(F.col("id_municipio") == F.lit(int(id_municipio)))
        only = entities.select("cnpj")
    if yearly is None:
        yearly = entity_year(tables, types, ano, extended, only)
    elif only is not None:
        yearly = semi_join_within(yearly, only, "cnpj")
    joined = lookup_join(entities, yearly, ["cnpj"])
    return joined.groupBy("id_municipio").agg(*repeated_sums(types))


def service_totals(
    tables: Tables, tipo: str, ano: int = DEFAULT_YEAR, extended: bool = False, yearly: DataFrame | None = None
) -> DataFrame:
    """Every area with the totals of one service type, 0 where there are none.

    ``extended`` adds the twelfth inspection measure to type ``ecv``. ``yearly``: a frame of ``reduced_year`` for this type and
    year, read in place of the facts.
    """
    st = service_type(tipo)
    columns = [c.column for c in st.components]
    totals = with_area_names(tables, area_sums(tables, [st], ano, extended, yearly=yearly), sums=columns, counts=())
    if st.total_column in columns:
        return totals
    return totals.withColumn(st.total_column, reduce(lambda a, b: a + b, [F.col(c) for c in columns]))


def service_struct(st: ServiceType) -> Column:
    """``{total, detalhamento: [{tipo, quantidade}]}`` from the quantity columns of one type."""
    quantities = [zero_if_null(F.col(c.column)) for c in st.components]
    detail = F.array(
        *[F.struct(F.lit(c.label).alias("tipo"), q.alias("quantidade"))
          for c, q in zip(st.components, quantities)]
    )
    return F.struct(reduce(lambda a, b: a + b, quantities).alias("total"), detail.alias("detalhamento"))


def _areas(tables: Tables, id_municipio: int | None) -> DataFrame:
    areas = distinct_areas(tables).select("id_municipio").distinct()
    if id_municipio is not None:
        areas = areas.where(F.col("id_municipio") == F.lit(int(id_municipio)))
    return areas


def service_details(
    tables: Tables,
    tipo: str,
    ano: int = DEFAULT_YEAR,
    id_municipio: int | None = None,
    extended: bool = False,
) -> DataFrame:
    """``(id_municipio, total, detalhamento)`` of one service type for every area, or for one.

    An unknown type gives total 0 and no detail rows.
    """
    areas = _areas(tables, id_municipio)
    st = SERVICE_TYPES.get((tipo or "").lower())
    if st is None:
        return areas.select(
            "id_municipio",
            F.lit(0).cast("bigint").alias("total"),
            F.array().cast(DETAIL_TYPE).alias("detalhamento"),
        )
    sums = area_sums(tables, [st], ano, extended, id_municipio)
    return areas.join(sums, "id_municipio", "left").select(
        "id_municipio", service_struct(st).alias("_servico")
    ).select("id_municipio", "_servico.total", "_servico.detalhamento")


def service_rows(
    tables: Tables, view: str = "visao_geral", ano: int = DEFAULT_YEAR, id_municipio: int | None = None
) -> DataFrame:
    """Long service table ``(id_municipio, tipo_servico, ordem, tipo, quantidade)`` of a view.

    Only the types that the view shows are read; a view without sections gives no rows. ``ordem``
    is the position of the row in the area's table.
    """
    types = [SERVICE_TYPES[s] for s in map_view(view).sections]
    areas = _areas(tables, id_municipio)
    if not types:
        return areas.where(F.lit(False)).select(
            "id_municipio",
            F.lit("").alias("tipo_servico"),
            F.lit(0).alias("ordem"),
            F.lit("").alias("tipo"),
            F.lit(0).cast("bigint").alias("quantidade"),
        )
    shown = [(st, c) for st in types for c in st.components]
    lines = F.array(
        *[
            F.struct(
                F.lit(st.name).alias("tipo_servico"),
                F.lit(i).alias("ordem"),
                F.lit(c.label).alias("tipo"),
                zero_if_null(F.col(c.column)).alias("quantidade"),
            )
            for i, (st, c) in enumerate(shown, start=1)
        ]
    )
    sums = area_sums(tables, types, ano, id_municipio=id_municipio)
    return areas.join(sums, "id_municipio", "left").select("id_municipio", F.inline(lines))
