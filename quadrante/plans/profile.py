"""Area profiles: entity lists and service totals of all five types, nested or as rows.

All areas are computed by one job that reads and shuffles the facts of the year once per type,
reduced to one row per cnpj. With ``id_municipio`` the facts are pruned to the entities of that area before they
are reduced. A nested document exists for one area only; all areas come as lines, so no list grows with an area.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrante.functions.numbers import zero_if_null
from quadrante.functions.text import format_cnpj, name_key
from quadrante.model import DEFAULT_YEAR, SERVICE_TYPES, ServiceType, Tables, map_view
from quadrante.operators.areas import distinct_areas
from quadrante.operators.joins import lookup_join
from quadrante.operators.services import (
    active_flag,
    entity_copies,
    entity_year,
    repeated_sums,
    service_struct,
)
from quadrante.sinks.json import to_json_rows

ALL_TYPES = tuple(SERVICE_TYPES.values())


def _size(st: ServiceType) -> str:
    return f"_{st.name}_tamanho"


def entity_activity(
    tables: Tables,
    types: Sequence[ServiceType] = ALL_TYPES,
    ano: int = DEFAULT_YEAR,
    id_municipio: int | None = None,
) -> DataFrame:
    """Distinct entities of each area with any service of the types in the year.

    Columns: ``id_municipio, cnpj, razao_social``, the copies of the row, and per type an activity
    flag and the summed quantities of the entity.
    """
    entities, only = entity_copies(tables, "razao_social"), None
    if id_municipio is not None:
        entities = entities.where(F.col("id_municipio") == F.lit(int(id_municipio)))
        only = entities.select("cnpj")
    return lookup_join(entities, entity_year(tables, types, ano, only=only), ["cnpj"])


def _section_sizes(types: Sequence[ServiceType]) -> list[Column]:
    return [F.count(active_flag(st)).alias(_size(st)) for st in types]


def _area_stats(activity: DataFrame, types: Sequence[ServiceType]) -> DataFrame:
    """One row per area: how many entities each section lists, and the summed quantities."""
    return activity.groupBy("id_municipio").agg(*_section_sizes(types), *repeated_sums(types))


def _areas(tables: Tables, id_municipio: int | None) -> DataFrame:
    areas = distinct_areas(tables).select("id_municipio", "nome")
    if id_municipio is not None:
        areas = areas.where(F.col("id_municipio") == F.lit(int(id_municipio)))
    return areas


def profile_rows(tables: Tables, ano: int = DEFAULT_YEAR, id_municipio: int | None = None) -> DataFrame:
    """Flat profile ``(id_municipio, nome, tipo, n_credenciados, total)``, five rows per area."""
    stats = _area_stats(entity_activity(tables, ALL_TYPES, ano, id_municipio), ALL_TYPES)
    joined = _areas(tables, id_municipio).join(stats, "id_municipio", "left")
    lines = F.array(
        *[
            F.struct(
                F.lit(st.name).alias("tipo"),
                zero_if_null(F.col(_size(st))).alias("n_credenciados"),
                service_struct(st)["total"].alias("total"),
            )
            for st in ALL_TYPES
        ]
    )
    return joined.select("id_municipio", "nome", F.inline(lines))


def _named_list(st: ServiceType) -> Column:
    """The entities of one section, by name. The collated sort key leaves the entries after sorting."""
    entry = F.struct(name_key("razao_social").alias("_ordem"), "razao_social", "cnpj")
    ordered = F.sort_array(F.collect_list(F.when(F.col(active_flag(st)).isNotNull(), entry)))
    return F.transform(
        ordered, lambda e: F.struct(e["cnpj"].alias("cnpj"), e["razao_social"].alias("razao_social"))
    )


def area_profile(tables: Tables, id_municipio: int, ano: int = DEFAULT_YEAR) -> DataFrame:
    """Nested profile of one area ``{id_municipio, nome, credenciados{5 lists}, servicos{5 totals}}``: one row, which
    is the answer asked for; none for an unknown area."""
    activity = entity_activity(tables, ALL_TYPES, ano, id_municipio)
    lists = activity.groupBy("id_municipio").agg(
        *[_named_list(st).alias(f"_{st.name}_lista") for st in ALL_TYPES], *repeated_sums(ALL_TYPES)
    )
    joined = _areas(tables, id_municipio).join(lists, "id_municipio", "left")
    nobody = F.array().cast("array<struct<cnpj:string,razao_social:string>>")
    entities = F.struct(*[F.coalesce(f"_{st.name}_lista", nobody).alias(st.name) for st in ALL_TYPES])
    services = F.struct(*[service_struct(st).alias(st.name) for st in ALL_TYPES])
    return joined.select("id_municipio", "nome", entities.alias("credenciados"), services.alias("servicos"))


def profile_lines(tables: Tables, ano: int = DEFAULT_YEAR) -> DataFrame:
    """Profiles of all areas as JSON lines (``json``): for each area one of kind ``municipio`` with its section sizes and
    service totals, and for each of its entities and their types one of kind ``credenciado``.

    Both kinds need the same fact columns, so Spark shuffles the facts once.
    """
    activity = entity_activity(tables, ALL_TYPES, ano)
    joined = _areas(tables, None).join(_area_stats(activity, ALL_TYPES), "id_municipio", "left")
    sizes = F.struct(*[zero_if_null(F.col(_size(st))).alias(st.name) for st in ALL_TYPES])
    services = F.struct(*[service_struct(st).alias(st.name) for st in ALL_TYPES])
    header = joined.select(
        F.lit("municipio").alias("linha"), "id_municipio", "nome", sizes.alias("tamanhos"), services.alias("servicos")
    )
    shown = [
        F.when(
            F.col(active_flag(st)).isNotNull(),
            F.struct(F.lit(st.name).alias("tipo"), service_struct(st)["total"].alias("total")),
        )
        for st in ALL_TYPES
    ]
    lines = activity.select(
        "id_municipio", "cnpj", "razao_social", F.inline(F.array_compact(F.array(*shown)))
    ).select(F.lit("credenciado").alias("linha"), "id_municipio", "tipo", "cnpj", "razao_social", "total")
    return to_json_rows(header).unionByName(to_json_rows(lines))


def section_entities(
    tables: Tables, view: str = "visao_geral", ano: int = DEFAULT_YEAR, id_municipio: int | None = None
) -> DataFrame:
    """Entity tables of the sections a view shows, as rows with the size of their section.

    Columns ``id_municipio, tipo_servico, titulo, tamanho, vazio, razao_social, cnpj`` with the cnpj
    formatted; an empty section is one row with ``vazio`` true and no entity.
    """
    types = [SERVICE_TYPES[s] for s in map_view(view).sections]
    columns = ["id_municipio", "tipo_servico", "titulo", "tamanho", "vazio", "razao_social", "cnpj"]
    if not types:
        nothing = _areas(tables, id_municipio).where(F.lit(False))
        return nothing.select(
            "id_municipio",
            F.lit("").alias("tipo_servico"),
            F.lit("").alias("titulo"),
            F.lit(0).cast("bigint").alias("tamanho"),
            F.lit(True).alias("vazio"),
            F.lit(None).cast("string").alias("razao_social"),
            F.lit(None).cast("string").alias("cnpj"),
        )

    def section(st: ServiceType) -> Column:
        return F.struct(
            F.lit(st.name).alias("tipo_servico"),
            F.lit(st.title).alias("titulo"),
            zero_if_null(F.col(_size(st))).alias("tamanho"),
        )

    def sections_where(shown: dict[str, Column]) -> Column:
        picked = [F.when(shown[st.name], section(st)) for st in types]
        return F.inline(F.array_compact(F.array(*picked)))

    activity = entity_activity(tables, types, ano, id_municipio)
    areas = _areas(tables, id_municipio).select("id_municipio").distinct()
    counted = activity.groupBy("id_municipio").agg(*_section_sizes(types))
    sizes = areas.join(counted, "id_municipio", "left")
    filled = lookup_join(activity, sizes, ["id_municipio"]).select(
        "id_municipio",
        "razao_social",
        format_cnpj(F.col("cnpj")).alias("cnpj"),
        sections_where({st.name: F.col(active_flag(st)).isNotNull() for st in types}),
    )
    empty = sizes.select(
        "id_municipio",
        sections_where({st.name: zero_if_null(F.col(_size(st))) == 0 for st in types}),
    )
    return (
        filled.withColumn("vazio", F.lit(False))
        .select(*columns)
        .unionByName(
            empty.withColumns(
                {
                    "vazio": F.lit(True),
                    "razao_social": F.lit(None).cast("string"),
                    "cnpj": F.lit(None).cast("string"),
                }
            ).select(*columns)
        )
    )
