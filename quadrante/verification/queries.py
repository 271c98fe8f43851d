"""Every operator as a query ``(spark, sf_dir) -> DataFrame`` over whole source tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrante import operators as ops
from quadrante import plans
from quadrante.functions.numbers import format_number_ptbr
from quadrante.model import TYPE_NAMES, VIEWS, Tables
from quadrante.session import scratch_dir
from quadrante.sinks import to_json_rows, write_tables
from quadrante.sources import accepted_rows, decode_json_rows, load_tables, parse_features, parse_json_rows, rejected_rows
from quadrante.verification.registry import YEAR, formatted_entities, registry_features, registry_tables

Query = Callable[[SparkSession, str], DataFrame]

LOOKUP_ID = 7
FILTER_IDS = ("3", "19", "1", "999")
FILTER_NAME = "Customer#000000010"
FILTER_CNPJ = "00.000.000/0000-01"


def _on_tables(build: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(registry_tables(spark, sf_dir))


def _with_formatted(tables: Tables) -> Tables:
    return tables.with_tables(credenciados=lambda: formatted_entities(tables))


def _exploded_map(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.explode("detalhe_frota").alias("tipo", "quantidade"))


def _choropleth(view: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = registry_tables(spark, sf_dir)
        return plans.choropleth(tables, registry_features(spark, sf_dir, tables), view, YEAR)

    return run


def _highlighted(precedence: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = registry_tables(spark, sf_dir)
        return plans.choropleth(
            _with_formatted(tables),
            registry_features(spark, sf_dir, tables),
            "visao_geral",
            YEAR,
            ids=FILTER_IDS,
            razao_social=FILTER_NAME,
            cnpj=FILTER_CNPJ,
            precedence=precedence,
        )

    return run


def _break_rows(view: str) -> Query:
    return _on_tables(
        lambda t: plans.view_breaks(t, view, YEAR).select(F.posexplode("intervalos").alias("ordem", "intervalo"))
    )


def _bucketed(tables: Tables) -> DataFrame:
    values = plans.view_values(tables, "credenciados_total", YEAR)
    return ops.with_buckets(values, "valor", ops.class_breaks(values, "valor"))


def _detail_rows(tipo: str, id_municipio: int | None = None) -> Query:
    def build(tables: Tables) -> DataFrame:
        details = ops.service_details(tables, tipo, YEAR, id_municipio)
        return details.select("id_municipio", "total", F.inline("detalhamento"))

    return _on_tables(build)


def _feature_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every map feature as a collection of its own, decoded again."""
    features = registry_features(spark, sf_dir)
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("id", "name").alias("properties"))
    text = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")))
    return parse_features(features.select(text.alias("texto")), "texto")


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "props")
    return parse_json_rows(events, "props", "k bigint", required=["event_id", "k"])


EVENT_SCHEMA = "k bigint"


def _damaged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, decoded; the text of some is missing, cut off, or names another column."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n, props = F.col("event_id"), F.col("props")
    damaged = F.when(n % 11 != 0, F.when(n % 5 == 0, F.expr("left(props, length(props) - 1)")).when(n % 7 == 0, F.replace(props, F.lit('"k"'), F.lit('"x"'))).otherwise(props))
    return decode_json_rows(events.select("event_id", "event_type", damaged.alias("props")), "props", EVENT_SCHEMA, ["k"])


def _maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals from a reduced store of which the year was written with other facts first and then replaced."""
    tables, path = registry_tables(spark, sf_dir), f"{scratch_dir(spark)}/reducao"
    before = tables.with_tables(servicos_clinicas=lambda: tables.servicos_clinicas.where("exames_medicos > 100"))
    ops.write_reduction(before, path, [YEAR - 1, YEAR])
    ops.write_reduction(tables, path, [YEAR])
    return ops.service_totals(tables, "clinicas", YEAR, yearly=ops.reduced_year(spark, path, "clinicas", YEAR))


def _stored_star(build: Callable[[Tables], DataFrame]) -> Query:
    """A query over the star schema written by ``write_tables`` and read back by ``load_tables``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{scratch_dir(spark)}/estrela"
        write_tables(registry_tables(spark, sf_dir), path)
        return build(load_tables(spark, path))

    return run


def _dirty_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as entities: the whole text as identifier, each piece between full stops as a name."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = F.explode(F.split("text", r"\.")).alias("razao_social")
    return documents.select(F.col("doc_id").alias("id_municipio"), F.col("text").alias("cnpj"), pieces)


def _dirty_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    entities = documents.select(F.col("doc_id").alias("id_municipio"), F.col("text").alias("cnpj"), F.col("text").alias("razao_social"))
    return ops.clean_entities(entities).select("id_municipio", "cnpj_digits", "cnpj_fmt", "razao_social_trim")


def _formatted_numbers(tables: Tables) -> DataFrame:
    totals = ops.service_totals(tables, "clinicas", YEAR).select("id_municipio", "nome_municipio", "total_exames")
    return totals.withColumn("texto", format_number_ptbr(F.col("total_exames")))


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "municipios": _on_tables(ops.area_list),
        "municipio_by_id": _on_tables(lambda t: ops.area_by_id(t, LOOKUP_ID)),
        "credenciados": _on_tables(ops.entity_list),
        "credenciados_total": _on_tables(ops.entity_totals),
        "servicos_ecv_12": _on_tables(lambda t: ops.service_totals(t, "ecv", YEAR, extended=True)),
        "frotas": _on_tables(ops.latest_fleet),
        "latest_per_key": _on_tables(lambda t: ops.latest_per_key(t.servicos_clinicas, ["cnpj"], "ano")),
        "frota_long": _on_tables(lambda t: ops.fleet_rows(ops.latest_fleet(t))),
        "frota_detalhe": _on_tables(
            lambda t: _exploded_map(ops.nest_fleet(ops.latest_fleet(t)), "id_municipio", "total_frota")
        ),
        "frotas_json": _on_tables(
            lambda t: to_json_rows(
                ops.nest_fleet(ops.latest_fleet(t)).select(
                    "id_municipio", "nome_municipio", "populacao", "ano_frota", "total_frota", "detalhe_frota"
                )
            )
        ),
        "visao_geral": _on_tables(
            lambda t: _exploded_map(
                plans.overview(t), "id_municipio", "nome_municipio", "total_credenciados", "populacao", "total_frota"
            )
        ),
        "cabecalho": _on_tables(plans.header_facts),
        "perfil": _on_tables(lambda t: plans.profile_rows(t, YEAR)),
        "perfil_json": _on_tables(lambda t: plans.profile_lines(t, YEAR)),
        "perfil_um": _on_tables(lambda t: to_json_rows(plans.area_profile(t, LOOKUP_ID, YEAR))),
        "servicos_long_um": _on_tables(lambda t: ops.service_rows(t, "visao_geral", YEAR, LOOKUP_ID)),
        "secao_credenciados_um": _on_tables(lambda t: plans.section_entities(t, "visao_geral", YEAR, LOOKUP_ID)),
        "load_tables": _stored_star(lambda t: plans.profile_rows(t, YEAR)),
        "servicos_long": _on_tables(lambda t: ops.service_rows(t, "visao_geral", YEAR)),
        "secao_credenciados": _on_tables(lambda t: plans.section_entities(t, "visao_geral", YEAR)),
        "clean_entities": _on_tables(lambda t: ops.clean_entities(t.credenciados)),
        "opcoes_razao_social": _on_tables(lambda t: ops.name_options(t.credenciados)),
        "opcoes_cnpj": _on_tables(lambda t: ops.cnpj_options(t.credenciados)),
        "municipios_por_razao_social": _on_tables(lambda t: ops.areas_by_name(ops.entity_rows(t), FILTER_NAME)),
        "municipios_por_cnpj": _on_tables(
            lambda t: ops.areas_by_cnpj(ops.entity_rows(_with_formatted(t)), FILTER_CNPJ)
        ),
        "selecao_municipios": _on_tables(lambda t: ops.select_areas(ops.entity_rows(t), FILTER_IDS)),
        "destaque": _highlighted("last"),
        "destaque_primeiro": _highlighted("first"),
        "resumo_filtros": _on_tables(
            lambda t: ops.filter_summary(t, ids=FILTER_IDS, razao_social=FILTER_NAME, cnpj=FILTER_CNPJ)
        ),
        "numero_formatado": _on_tables(_formatted_numbers),
        "selecao_por_tabela": _on_tables(
            lambda t: ops.select_areas(ops.entity_rows(t), t.populacao.select("id_municipio").where("populacao > 10000"))
        ),
        "feicoes_geojson": _feature_texts,
        "eventos_json": _event_rows,
        "eventos_aceitos": lambda spark, sf_dir: accepted_rows(_damaged_events(spark, sf_dir), "props"),
        "eventos_rejeitados": lambda spark, sf_dir: rejected_rows(_damaged_events(spark, sf_dir), "props", EVENT_SCHEMA),
        "servicos_mantidos": _maintained,
        "perfil_um_gravado": _stored_star(lambda t: to_json_rows(plans.area_profile(t, LOOKUP_ID, YEAR))),
        "municipios_por_cnpj_gravado": _stored_star(
            lambda t: ops.areas_by_cnpj(ops.entity_rows(t), FILTER_CNPJ, normalize_stored=True)
        ),
        "limpeza_documentos": _dirty_cleaned,
        "opcoes_nomes_documentos": lambda spark, sf_dir: ops.name_options(_dirty_entities(spark, sf_dir)),
        "opcoes_cnpj_documentos": lambda spark, sf_dir: ops.cnpj_options(
            spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").alias("cnpj"))
        ),
        "class_breaks": _break_rows("servicos_cfc"),
        "class_breaks_frota": _break_rows("frota_total"),
        "bucketed": _on_tables(_bucketed),
        "legenda": _on_tables(lambda t: plans.view_legend(t, "servicos_clinicas", YEAR)),
    }
    for tipo in TYPE_NAMES:
        out[f"credenciados_{tipo}"] = _on_tables(lambda t, n=tipo: ops.entities_with_service(t, n, YEAR))
        out[f"servicos_{tipo}"] = _on_tables(lambda t, n=tipo: ops.service_totals(t, n, YEAR))
        out[f"detalhe_credenciados_{tipo}"] = _on_tables(lambda t, n=tipo: ops.service_entities(t, n, YEAR))
        out[f"detalhe_servicos_{tipo}"] = _detail_rows(tipo)
        out[f"detalhe_credenciados_um_{tipo}"] = _on_tables(
            lambda t, n=tipo: ops.service_entities(t, n, YEAR, LOOKUP_ID)
        )
        out[f"detalhe_servicos_um_{tipo}"] = _detail_rows(tipo, LOOKUP_ID)
    for view in VIEWS:
        out[f"coropletico_{view}"] = _choropleth(view)
    return out
