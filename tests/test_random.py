"""Random small tables with NULLs and duplicates: reduced-first plans against join-first SQL."""

from __future__ import annotations

import json
import random

import duckdb
import pandas as pd
import pytest
from conftest import VEHICLE_NAMES, by_name
from pyspark.sql import functions as F

from quadrante import operators as ops
from quadrante import plans
from quadrante.model import INSPECTION_EXTRA, SCHEMAS, SERVICE_TYPES, TYPE_NAMES, VIEWS, Tables
from quadrante.verification.oracles import oracle_statements, without_schema
from quadrante.verification.registry import YEAR

STATEMENTS = {k: without_schema(s) for k, s in oracle_statements().items()}


def maybe(rng, value, share=0.15):
    return None if rng.random() < share else value


def random_rows(seed: int, repeated_areas: bool) -> dict[str, list[tuple]]:
    rng = random.Random(seed)
    areas = [(i, f"Area {i}") for i in range(8)]
    if repeated_areas:
        areas += [areas[1], areas[1], (2, "Outra")]
    cnpjs = [str(n) for n in range(12)]
    entities = []
    for _ in range(60):
        # A third of all rows shares one identifier, another third one area.
        cnpj = "3" if rng.random() < 0.33 else maybe(rng, rng.choice(cnpjs), 0.05)
        area = 5 if rng.random() < 0.33 else rng.randrange(10)
        entities.append((cnpj, rng.choice(["Ana", "Bia", "Caio", "Dora"]), area))
    out = {
        "municipios": areas,
        "credenciados": entities,
        "populacao": [(rng.randrange(9), maybe(rng, rng.choice([1000, 2000]))) for _ in range(8)],
        "frotas": [
            (rng.randrange(9), maybe(rng, rng.choice([1999, 2000, 2001])), *[maybe(rng, rng.randrange(9)) for _ in VEHICLE_NAMES])
            for _ in range(25)
        ],
    }
    for st in SERVICE_TYPES.values():
        width = len(st.measures) + (st.name == "ecv")
        out[st.table] = [
            (
                "3" if rng.random() < 0.33 else maybe(rng, str(rng.randrange(14)), 0.05),
                maybe(rng, rng.choice([1999, 2000, 2000]), 0.1),
                *[maybe(rng, rng.randrange(50), 0.05) for _ in range(width)],
            )
            for _ in range(80)
        ]
    return out


def schema_of(table: str):
    from pyspark.sql import types as T

    schema = SCHEMAS[table]
    if table == "servicos_ecv":
        schema = T.StructType([*schema.fields, T.StructField(INSPECTION_EXTRA, T.LongType())])
    return schema


def build(spark, seed: int, repeated_areas: bool = False):
    data = random_rows(seed, repeated_areas)
    tables = Tables(**{n: spark.createDataFrame(data[n], schema_of(n)) for n in Tables.names()})
    con = duckdb.connect()
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR"}
    for name in Tables.names():
        fields = schema_of(name).fields
        columns = ", ".join(f"{f.name} {kinds[f.dataType.simpleString()]}" for f in fields)
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(fields))})", data[name])
    con.execute("CREATE TABLE geo AS SELECT CAST(i AS VARCHAR) AS id, 'Feature ' || i AS name FROM range(0, 10) t(i)")
    return tables, con


def same(df, con, statement):
    result = con.execute(STATEMENTS[statement])
    columns = [c[0] for c in result.description]
    assert by_name(df.columns, [tuple(r) for r in df.collect()]) == by_name(columns, result.fetchall()), statement


@pytest.mark.parametrize("seed", range(2))
def test_totals_with_repeated_areas(spark, seed):
    tables, con = build(spark, seed, repeated_areas=True)
    same(ops.entity_rows(tables), con, "credenciados")
    same(ops.entity_totals(tables), con, "credenciados_total")
    same(ops.latest_fleet(tables), con, "frotas")
    same(ops.service_totals(tables, "ecv", YEAR, extended=True), con, "servicos_ecv_12")
    for tipo in TYPE_NAMES:
        same(ops.entities_with_service(tables, tipo, YEAR), con, f"credenciados_{tipo}")
        same(ops.service_totals(tables, tipo, YEAR), con, f"servicos_{tipo}")


@pytest.mark.parametrize("seed", range(10, 12))
def test_details_and_profiles(spark, seed):
    tables, con = build(spark, seed)
    known = tables.credenciados.where(F.col("cnpj").isNotNull())
    same(plans.profile_rows(tables, YEAR), con, "perfil")
    same(ops.service_rows(tables, "visao_geral", YEAR), con, "servicos_long")
    same(plans.section_entities(tables, "visao_geral", YEAR), con, "secao_credenciados")
    same(plans.header_facts(tables), con, "cabecalho")
    same(ops.latest_per_key(tables.servicos_clinicas.where("cnpj is not null"), ["cnpj"], "ano"), con, "latest_per_key")
    for tipo in TYPE_NAMES:
        same(ops.service_entities(tables, tipo, YEAR), con, f"detalhe_credenciados_{tipo}")
    assert known.count() > 0
    single = ops.service_details(tables, "cfc", YEAR, id_municipio=5).collect()
    assert single == ops.service_details(tables, "cfc", YEAR).where("id_municipio = 5").collect()


def test_lines_hold_what_the_documents_hold(spark):
    tables, con = build(spark, 21)
    same(plans.profile_lines(tables, YEAR), con, "perfil_json")
    lines = [json.loads(r["json"]) for r in plans.profile_lines(tables, YEAR).collect()]
    for area in (1, 5):
        document = plans.area_profile(tables, area, YEAR).head()
        for tipo in TYPE_NAMES:
            listed = [(x["cnpj"], x["razao_social"]) for x in lines if x.get("tipo") == tipo and x["id_municipio"] == area]
            assert sorted(map(tuple, document["credenciados"][tipo])) == sorted(listed)


@pytest.mark.parametrize("view", ["visao_geral", "credenciados_total", "frota_total", "servicos_clinicas", "credenciados_ecv"])
def test_choropleth(spark, view):
    assert view in VIEWS
    tables, con = build(spark, 31)
    features = spark.createDataFrame(pd.DataFrame({"id": [str(i) for i in range(10)], "name": [f"Feature {i}" for i in range(10)]}))
    same(plans.choropleth(tables, features, view, YEAR), con, f"coropletico_{view}")
