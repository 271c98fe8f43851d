"""The hand-made fixture of FIXTURES.md with its stated results."""

from __future__ import annotations

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quadrante import operators as ops
from quadrante import plans
from quadrante.functions import format_cnpj, order_by_name
from quadrante.model import TYPE_NAMES
from quadrante.sinks import to_json_rows


def names(df, column):
    return [r[column] for r in df.collect()]


def test_area_list_order(golden):
    assert names(ops.area_list(golden), "nome") == ["abaíra", "Água Fria", "Barra", "Zabelê"]


def test_area_look_up(golden):
    assert rows(ops.area_by_id(golden, 4)) == [(4, "Barra")]
    assert rows(ops.area_by_id(golden, 77)) == []
    with pytest.raises(LookupError):
        ops.require_row(ops.area_by_id(golden, 77))
    assert ops.require_row(ops.area_by_id(golden, 1)).count() == 1


def test_entity_list(golden):
    got = ops.entity_list(golden)
    assert got.columns == ["id_municipio", "cnpj", "razao_social", "nome_municipio"]
    assert rows(got, "id_municipio", "razao_social") == [
        (1, " Clínica Vida "),
        (1, "Auto Escola Sol"),
        (2, "Auto Escola Sol"),
        (4, ""),
        (4, "Vistoria Já"),
    ]


def test_entity_totals(golden):
    assert rows(ops.entity_totals(golden), "id_municipio", "total_credenciados", "populacao") == [
        (1, 2, 18000),
        (2, 1, 0),
        (3, 0, 0),
        (4, 2, 50000),
        (4, 2, 51000),
    ]


def test_entities_with_service(golden):
    got = ops.entities_with_service(golden, "CFC")
    assert rows(got, "id_municipio", "total_cfc") == [(1, 2), (2, 1), (3, 0), (4, 0)]
    assert rows(ops.entities_with_service(golden, "cfc", 2023), "total_cfc", "id_municipio") == [
        (0, 3), (0, 4), (1, 1), (1, 2)
    ]


def test_service_totals_fan_out(golden):
    got = ops.service_totals(golden, "cfc")
    assert rows(got, "id_municipio", "total_cursos_teoricos", "total_cursos_praticos", "total_cursos") == [
        (1, 12, 10, 22),
        (2, 10, 10, 20),
        (3, 0, 0, 0),
        (4, 0, 0, 0),
    ]


def test_null_measure_drops_the_row(golden):
    assert rows(ops.service_totals(golden, "ecv"), "id_municipio", "total_vistorias") == [
        (1, 0), (2, 0), (3, 0), (4, 22)
    ]
    assert rows(ops.service_totals(golden, "ecv", extended=True), "id_municipio", "total_vistorias") == [
        (1, 0), (2, 0), (3, 0), (4, 16)
    ]


@pytest.mark.parametrize("tipo", ["epiv", "patio", "clinicas"])
def test_types_without_facts_are_zero(golden, tipo):
    got = ops.service_totals(golden, tipo)
    assert [r[-1] for r in rows(got)] == [0, 0, 0, 0]


@pytest.mark.parametrize("bad", ["", None, "outro", "frota"])
def test_unknown_type_is_rejected(golden, bad):
    with pytest.raises(ValueError):
        ops.service_totals(golden, bad)
    with pytest.raises(ValueError):
        ops.entities_with_service(golden, bad)


def test_latest_fleet(golden):
    assert rows(ops.latest_fleet(golden), "id_municipio", "ano_frota", "total_frota") == sorted(
        [(1, 2023, 7), (2, None, 0), (3, None, 0), (4, 2023, 1), (4, 2023, 1), (4, 2023, 2), (4, 2023, 2)],
        key=repr,
    )


def test_latest_per_key_keeps_ties_and_skips_null(golden):
    got = ops.latest_per_key(golden.frotas, ["id_municipio"], "ano")
    assert rows(got, "id_municipio", "ano", "automovel") == [(1, 2023, 5), (4, 2023, 1), (4, 2023, 2)]


def test_fleet_forms_agree(golden):
    fleet = ops.latest_fleet(golden)
    nested, labels = (
        ops.nest_fleet(fleet).where("id_municipio = 1").select("detalhe_frota", F.map_keys("detalhe_frota")).head()
    )
    assert labels == [
        "Automóvel", "Caminhão", "Caminhoneta/Caminhonete", "Micro-ônibus", "Moto", "Motor-casa",
        "Ônibus", "Reboque/Semirreboque", "Trator", "Outros",
    ]
    assert nested["Automóvel"] == 5 and nested["Caminhão"] == 0 and nested["Moto"] == 2
    long = ops.fleet_rows(fleet)
    assert long.count() == 70
    assert long.agg(F.sum("quantidade")).head()[0] == fleet.agg(F.sum("total_frota")).head()[0]


def test_fleet_json_keeps_null_year(golden):
    df = ops.nest_fleet(ops.latest_fleet(golden)).where("id_municipio = 3")
    document = json.loads(to_json_rows(df).head()[0])
    assert document["ano_frota"] is None and document["total_frota"] == 0
    assert list(document["detalhe_frota"])[0] == "Automóvel"


def test_service_entities(golden):
    got = ops.service_entities(golden, "cfc", id_municipio=1)
    assert rows(got, "razao_social") == [(" Clínica Vida ",), ("Auto Escola Sol",)]
    assert names(order_by_name(got, "razao_social"), "razao_social")[0].strip() in ("Clínica Vida", "Auto Escola Sol")
    assert rows(ops.service_entities(golden, "outro", id_municipio=1)) == []
    assert rows(ops.service_entities(golden, "cfc"), "id_municipio") == [(1,), (1,), (2,)]


def test_service_details(golden):
    def detail(area):
        row = ops.service_details(golden, "cfc", id_municipio=area).head()
        return row["total"], [(d["tipo"], d["quantidade"]) for d in row["detalhamento"]]

    assert detail(1) == (22, [("Cursos Teóricos", 12), ("Cursos Práticos", 10)])
    assert detail(3) == (0, [("Cursos Teóricos", 0), ("Cursos Práticos", 0)])
    unknown = ops.service_details(golden, "outro", id_municipio=1).head()
    assert unknown["total"] == 0 and unknown["detalhamento"] == []


def test_profile_document(golden):
    profile = plans.area_profile(golden, id_municipio=1).head().asDict(recursive=True)
    assert profile["nome"] == "Água Fria"
    assert list(profile["credenciados"]) == list(TYPE_NAMES) == list(profile["servicos"])
    assert {e["razao_social"] for e in profile["credenciados"]["cfc"]} == {"Auto Escola Sol", " Clínica Vida "}
    assert profile["credenciados"]["patio"] == []
    assert profile["servicos"]["cfc"] == {
        "total": 22,
        "detalhamento": [
            {"tipo": "Cursos Teóricos", "quantidade": 12},
            {"tipo": "Cursos Práticos", "quantidade": 10},
        ],
    }
    assert profile["servicos"]["ecv"] == {"total": 0, "detalhamento": [{"tipo": "Total Vistorias", "quantidade": 0}]}
    assert rows(plans.area_profile(golden, id_municipio=77)) == []
    lines = [json.loads(r["json"]) for r in plans.profile_lines(golden).collect()]
    assert sum(x["linha"] == "municipio" for x in lines) == 4
    (area,) = (x for x in lines if x["linha"] == "municipio" and x["id_municipio"] == 1)
    assert area["servicos"] == profile["servicos"] and area["tamanhos"]["cfc"] == 2
    listed = [x["razao_social"] for x in lines if x["linha"] == "credenciado" and (x["id_municipio"], x["tipo"]) == (1, "cfc")]
    assert sorted(listed) == [" Clínica Vida ", "Auto Escola Sol"]


def test_profile_lists_follow_name_order(spark, golden):
    from dataclasses import replace

    listed = ["Zeta", "álamo", "Beta", "Alamo 2", "éden"]
    tables = replace(
        golden,
        credenciados=spark.createDataFrame(
            [(str(i), n, 1) for i, n in enumerate(listed)], "cnpj string, razao_social string, id_municipio int"
        ),
        servicos_epiv=spark.createDataFrame(
            [(str(i), 2024, 1) for i in range(len(listed))], "cnpj string, ano int, estampagens bigint"
        ),
    )
    profile = plans.area_profile(tables, id_municipio=1).head()
    assert [e["razao_social"] for e in profile["credenciados"]["epiv"]] == ["álamo", "Alamo 2", "Beta", "éden", "Zeta"]


def test_service_rows_by_view(golden):
    overview = ops.service_rows(golden, "visao_geral", id_municipio=1)
    assert overview.count() == 7
    assert [r["tipo"] for r in overview.orderBy("ordem").collect()][:3] == [
        "Cursos Teóricos", "Cursos Práticos", "Exames Médicos"
    ]
    assert rows(ops.service_rows(golden, "servicos_cfc", id_municipio=1), "tipo", "quantidade") == [
        ("Cursos Práticos", 10), ("Cursos Teóricos", 12)
    ]
    assert ops.service_rows(golden, "credenciados_epiv").count() == 4
    for view in ("frota_total", "credenciados_total", "qualquer"):
        assert ops.service_rows(golden, view).count() == 0


def test_section_entities(golden):
    got = plans.section_entities(golden, "credenciados_cfc")
    assert rows(got, "id_municipio", "titulo", "tamanho", "vazio", "cnpj") == sorted(
        [
            (1, "CFCs", 2, False, "00.000.000/0123-45"),
            (1, "CFCs", 2, False, "12.345.678/0001-99"),
            (2, "CFCs", 1, False, "12.345.678/0001-99"),
            (3, "CFCs", 0, True, None),
            (4, "CFCs", 0, True, None),
        ],
        key=repr,
    )
    assert rows(plans.section_entities(golden, "visao_geral", id_municipio=3), "titulo", "vazio") == sorted(
        (t, True) for t in ("CFCs", "Clínicas", "ECVs", "EPIVs", "Pátios")
    )
    assert rows(plans.section_entities(golden, "frota_total")) == []


def test_overview_has_one_row_per_area(golden):
    got = plans.overview(golden)
    assert rows(got, "id_municipio", "total_credenciados", "populacao", "total_frota") == [
        (1, 2, 18000, 7), (2, 1, 0, 0), (3, 0, 0, 0), (4, 2, 51000, 2)
    ]


def test_header_facts(golden):
    assert rows(plans.header_facts(golden, "visao_geral").where("id_municipio = 1"), "rotulo", "texto") == [
        ("Frota Total", "7"), ("População", "18.000")
    ]
    assert rows(plans.header_facts(golden, "frota_total").where("id_municipio = 4"), "rotulo", "valor") == [
        ("Frota Total", 2)
    ]
    assert rows(plans.header_facts(golden, "servicos_cfc")) == []


@pytest.mark.parametrize(
    "given, expected",
    [
        ("12.345", "00.000.000/0123-45"),
        ("", "00.000.000/0000-00"),
        ("123456789012345", "123456789012345"),
        ("12345678000199", "12.345.678/0001-99"),
        ("12.345.678/0001-99", "12.345.678/0001-99"),
        ("CNPJ 1", "00.000.000/0000-01"),
    ],
)
def test_format_cnpj(spark, given, expected):
    assert spark.range(1).select(format_cnpj(F.lit(given))).head()[0] == expected


def test_areas_by_cnpj(golden):
    entities = ops.entity_rows(golden)
    assert rows(ops.areas_by_cnpj(entities, "12345678000199")) == [(1,), (2,)]
    assert rows(ops.areas_by_cnpj(entities, "22222222000122")) == []
    assert rows(ops.areas_by_cnpj(entities, "22222222000122", normalize_stored=True)) == [(4,)]
    assert rows(ops.areas_by_cnpj(entities, "99999999000199")) == []


def test_areas_by_name(golden):
    entities = ops.entity_rows(golden)
    assert rows(ops.areas_by_name(entities, "Clínica Vida")) == []
    assert rows(ops.areas_by_name(entities, "Clínica Vida", trim_stored=True)) == [(1,)]
    assert rows(ops.areas_by_name(entities, "Auto Escola Sol")) == [(1,), (2,)]


def test_options(golden):
    entities = ops.entity_rows(golden)
    assert names(ops.name_options(entities), "razao_social") == ["Auto Escola Sol", "Clínica Vida", "Vistoria Já"]
    assert [tuple(r) for r in ops.cnpj_options(entities).collect()] == [
        ("00000000012345", "00.000.000/0123-45"),
        ("11111111000111", "11.111.111/0001-11"),
        ("12345678000199", "12.345.678/0001-99"),
        ("22222222000122", "22.222.222/0001-22"),
    ]


def test_blank_name_becomes_one_empty_option(spark):
    nbsp = chr(0xA0)
    data = [("1", f"{nbsp} \t", 1), ("2", "  ", 1), ("3", "", 1), ("4", None, 1), ("5", f"{nbsp}Ana{chr(0xFEFF)}", 1)]
    df = spark.createDataFrame(data, "cnpj string, razao_social string, id_municipio int")
    assert names(ops.name_options(df), "razao_social") == ["", "Ana"]


def test_clean_entities(golden):
    got = ops.clean_entities(golden.credenciados).where("id_municipio = 1").dropDuplicates(["cnpj"])
    assert rows(got, "cnpj_digits", "cnpj_fmt", "razao_social_trim") == [
        ("00000000012345", "00.000.000/0123-45", "Clínica Vida"),
        ("12345678000199", "12.345.678/0001-99", "Auto Escola Sol"),
    ]


def test_select_areas(spark, golden):
    entities = ops.entity_rows(golden)
    assert rows(ops.select_areas(entities, [2, "4"]).select("id_municipio").distinct()) == [(2,), (4,)]
    ids = spark.createDataFrame([(2,), (2,), (9,)], "id int")
    assert rows(ops.select_areas(entities, ids), "id_municipio") == [(2,)]
    assert rows(ops.select_areas(entities, [])) == []


@pytest.mark.parametrize(
    "precedence, expected",
    [
        ("last", {1: "cnpj", 2: "cnpj", 3: None, 4: "municipio"}),
        ("first", {1: "municipio", 2: "razao_social", 3: None, 4: "municipio"}),
    ],
)
def test_highlight_precedence(golden, precedence, expected):
    got = ops.highlight(
        golden.municipios,
        ops.entity_rows(golden),
        ids=["1", "4"],
        razao_social="Auto Escola Sol",
        cnpj="12345678000199",
        precedence=precedence,
    )
    assert {r["id_municipio"]: r["destaque"] for r in got.collect()} == expected
    colours = {r["destaque"]: r["cor_destaque"] for r in got.collect()}
    assert colours[None] is None and colours["municipio"] == "#3388ff"


def test_highlight_without_filters(golden):
    got = ops.highlight(golden.municipios, ops.entity_rows(golden), razao_social="", cnpj=None)
    assert {r["destaque"] for r in got.collect()} == {None}
    with pytest.raises(ValueError):
        ops.highlight(golden.municipios, ops.entity_rows(golden), precedence="middle")


def test_filter_summary(golden):
    assert rows(ops.filter_summary(golden), "texto") == [("Nenhum filtro aplicado",)]
    got = ops.filter_summary(golden, ids=["4", "77", "1"], razao_social="Sol", cnpj="1")
    assert {r["filtro"]: r["texto"] for r in got.collect()} == {
        "municipio": "Municípios: Barra, 77, Água Fria",
        "razao_social": "Razão Social: Sol",
        "cnpj": "CNPJ: 00.000.000/0000-01",
    }


def test_choropleth(spark, golden):
    features = spark.createDataFrame(
        [("1", "Água Fria"), ("2", "Zabelê"), ("3", "abaíra"), ("4", "Barra"), ("99", "Ilha")], "id string, name string"
    )
    got = plans.choropleth(golden, features, "servicos_cfc", cnpj="12345678000199")
    assert rows(got, "id", "valor", "faixa", "cor", "texto", "destaque") == sorted(
        [
            ("1", 22, 2, "#FEB24C", "Total de Cursos: 22", "cnpj"),
            ("2", 20, 2, "#FEB24C", "Total de Cursos: 20", "cnpj"),
            ("3", 0, 0, "#FFEDA0", "Total de Cursos: 0", None),
            ("4", 0, 0, "#FFEDA0", "Total de Cursos: 0", None),
            ("99", 0, 0, "#FFEDA0", "Sem dados disponíveis", None),
        ],
        key=repr,
    )
    population = plans.choropleth(golden, features, "visao_geral")
    assert {r["id"]: r["valor"] for r in population.collect()}["4"] == 51000
    fallback = plans.choropleth(golden, features, "qualquer")
    assert {r["id"]: r["texto"] for r in fallback.collect()}["1"] == "Total de Credenciados: 2"


def test_metric_falls_back_to_quantity(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "id_municipio int, quantidade bigint")
    got = df.select(plans.metric_value(df, "servicos_ecv").alias("v"))
    assert rows(got) == [(0,), (5,)]
    assert rows(df.select(plans.metric_value(df, "frota_total").alias("v"))) == [(0,), (0,)]
