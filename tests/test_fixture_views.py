"""The figures that FIXTURES.md states for its proxy views at sf0.01, year 2000."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quadrante import operators as ops
from quadrante import plans

YEAR = 2000
COUNTS = {"cfc": (4, 58), "clinicas": (3, 68), "ecv": (3, 72), "epiv": (16, 13), "patio": (15, 15)}
TOTALS = {"cfc": ("total_cursos", 4, 43457), "ecv": ("total_vistorias", 3, 44845),
          "epiv": ("total_estampagens", 16, 4460), "patio": ("total_veiculos_removidos", 15, 16856)}


def summary(df, column):
    return tuple(df.agg(F.count("*"), F.count_if(F.col(column) == 0), F.sum(column)).head())


def test_entity_list(fixture_views):
    assert ops.entity_rows(fixture_views).count() == 90


@pytest.mark.parametrize("tipo", COUNTS)
def test_entity_counts(fixture_views, tipo):
    zero, total = COUNTS[tipo]
    assert summary(ops.entities_with_service(fixture_views, tipo, YEAR), f"total_{tipo}") == (25, zero, total)
    assert ops.service_entities(fixture_views, tipo, YEAR).count() == total


@pytest.mark.parametrize("tipo", TOTALS)
def test_service_totals(fixture_views, tipo):
    column, zero, total = TOTALS[tipo]
    assert summary(ops.service_totals(fixture_views, tipo, YEAR), column) == (25, zero, total)


def test_fleet(fixture_views):
    fleet = ops.latest_fleet(fixture_views)
    assert summary(fleet, "total_frota") == (25, 3, 2590)
    assert rows(fleet.select("ano_frota").distinct()) == [(2000,), (2001,), (None,)]


def test_parts_agree(fixture_views):
    profile = {(r["id_municipio"], r["tipo"]): r for r in plans.profile_rows(fixture_views, YEAR).collect()}
    assert len(profile) == 125
    for tipo, (column, _, _) in TOTALS.items():
        for r in ops.service_totals(fixture_views, tipo, YEAR).collect():
            assert profile[r["id_municipio"], tipo]["total"] == r[column]
        details = ops.service_details(fixture_views, tipo, YEAR).collect()
        for r in details:
            assert r["total"] == sum(d["quantidade"] for d in r["detalhamento"])
            assert profile[r["id_municipio"], tipo]["total"] == r["total"]
        for r in ops.entities_with_service(fixture_views, tipo, YEAR).collect():
            assert profile[r["id_municipio"], tipo]["n_credenciados"] == r[f"total_{tipo}"]
    nested = ops.nest_fleet(ops.latest_fleet(fixture_views)).collect()
    assert all(sum(r["detalhe_frota"].values()) == r["total_frota"] for r in nested)


def test_buckets_stay_inside_the_breaks(fixture_views):
    features = fixture_views.municipios.select(F.col("id_municipio").cast("string").alias("id"), F.col("nome").alias("name"))
    for view in ("visao_geral", "servicos_cfc"):
        size = len(plans.view_breaks(fixture_views, view, YEAR).head()[0])
        drawn = plans.choropleth(fixture_views, features, view, YEAR).collect()
        assert len(drawn) == 25 and all(0 <= r["faixa"] < size for r in drawn)
