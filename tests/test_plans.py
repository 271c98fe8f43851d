"""Physical plans: pushdown, pruning, single fact passes, no cross joins, splittable hot keys."""

from __future__ import annotations

import re
from contextlib import contextmanager
from dataclasses import replace

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from quadrante import operators as ops
from quadrante import plans
from quadrante.sinks import write_tables
from quadrante.sources import load_tables
from quadrante.verification.registry import YEAR, registry_tables

SF = str(TESTDATA / "sf0.001")
QUERIES = entry_point.queries()


def executed_plan(df) -> str:
    """The plan as run: subqueries included, abandoned initial plans left out."""
    df.collect()
    kept, skip = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(re.match(r"[ :]*", line).group())
        if "== Initial Plan ==" in line:
            skip = depth if skip is None else min(skip, depth)
            continue
        if skip is not None and depth > skip:
            continue
        skip = None
        kept.append(line)
    return "\n".join(kept)


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


NO_BROADCAST = {"spark__sql__autoBroadcastJoinThreshold": "-1"}
TINY_SKEW = {
    **NO_BROADCAST,
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "2k",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "1k",
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
}


@pytest.mark.parametrize("name", ["servicos_cfc", "credenciados_ecv", "perfil", "secao_credenciados", "coropletico_servicos_ecv", "frotas", "destaque"])
def test_no_python_and_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("Cartesian", "NestedLoop", "Python", "ArrowEval", "MapInPandas"):
        assert word not in plan


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize(
    "name, scans",
    [
        ("servicos_cfc", {"lineitem": 1}),
        ("coropletico_servicos_cfc", {"lineitem": 1}),
        ("perfil", {"lineitem": 3, "orders": 2}),
        ("perfil_json", {"lineitem": 3, "orders": 2}),
        ("secao_credenciados", {"lineitem": 3, "orders": 2}),
    ],
)
def test_facts_are_read_once_per_type(spark, name, scans, broadcast):
    with settings(spark, **({} if broadcast else NO_BROADCAST)):
        plan = executed_plan(QUERIES[name](spark, SF))
    for table, n in scans.items():
        assert len(re.findall(rf"FileScan.*/{table}\.parquet", plan)) == n


def test_facts_are_reduced_before_they_are_shuffled(spark):
    plan = executed_plan(ops.service_totals(registry_tables(spark, SF), "ecv", YEAR))
    facts = plan[plan.index("Exchange hashpartitioning(cnpj"):] if "Exchange hashpartitioning(cnpj#" in plan else plan
    shuffles = re.findall(r"Exchange hashpartitioning\([^\n]*\n[ :+\-]*\*?\(?\d*\)?\s*(\w+)", plan)
    assert shuffles and set(shuffles) == {"HashAggregate"}
    assert "partial_sum" in facts


def test_year_prunes_partitions_and_columns(spark, golden, tmp_path):
    write_tables(golden, str(tmp_path / "star"))
    stored = load_tables(spark, str(tmp_path / "star"))
    plan = executed_plan(ops.service_totals(stored, "cfc"))
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "cursos_teoricos" in line)
    assert re.search(r"PartitionFilters: \[[^\]]*ano#\d+ = 2024", scan)
    full = stored.services("ecv")
    narrow = ops.active_entities(replace(stored, servicos_ecv=full), "ecv")
    read = re.search(r"ReadSchema: struct<([^>]*)>", executed_plan(narrow)).group(1)
    assert read == "cnpj:string"


def test_area_id_reaches_the_scan(spark, golden, tmp_path):
    golden.credenciados.write.parquet(str(tmp_path / "credenciados"))
    tables = replace(golden, credenciados=spark.read.parquet(str(tmp_path / "credenciados")))
    for df in (ops.service_entities(tables, "cfc", id_municipio=1), plans.profile_rows(tables, id_municipio=1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(id_municipio,1)" in plan


def test_one_area_prunes_the_facts_before_they_are_reduced(spark, golden):
    for df in (ops.service_details(golden, "cfc", id_municipio=1), plans.area_profile(golden, 1), ops.service_entities(golden, "cfc", id_municipio=1)):
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert any("LeftSemi" in line for line in lines)
        for k, line in enumerate(lines):
            if "Aggregate [cnpj" in line and "razao_social" not in line and "id_municipio" not in line:
                assert any("LeftSemi" in below for below in lines[k + 1 :])
    assert "collect_list" not in plans.profile_lines(golden)._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark):
    """One identifier and one area hold more than a third of all rows; every count is known."""
    n = 12_000
    names = "concat('Nome ', id % 97)"
    entities = spark.range(n).selectExpr(
        "if(id % 3 = 0, 'quente', cast(id as string)) cnpj", f"{names} razao_social",
        "cast(if(id % 2 = 0, 7, id % 1000) as int) id_municipio",
    )
    facts = spark.range(n).selectExpr(
        "if(id % 3 = 0, 'quente', cast(id as string)) cnpj", "if(id % 5 = 0, 2023, 2024) ano", "1L estampagens"
    )
    areas = spark.range(1000).selectExpr("cast(id as int) id_municipio", "concat('Area ', id) nome")
    population = spark.range(3_000).selectExpr("cast(if(id % 2 = 0, 7, id % 1000) as int) id_municipio", "id populacao")
    fleet = spark.range(3_000).selectExpr(
        "cast(if(id % 2 = 0, 7, id % 1000) as int) id_municipio", "2024 ano",
        *[f"id % {i + 2} {v}" for i, v in enumerate(ops.fleet.VEHICLE_COLUMNS)],
    )
    return replace(
        registry_tables(spark, SF),
        municipios=areas, credenciados=entities, servicos_epiv=facts, populacao=population, frotas=fleet,
    )


HOT_QUERIES = {
    "entity_rows": lambda t: ops.entity_rows(t),
    "service_entities": lambda t: ops.service_entities(t, "epiv"),
    "latest_per_key": lambda t: ops.latest_per_key(t.servicos_epiv, ["cnpj"], "ano"),
    "section_entities": lambda t: plans.section_entities(t, "servicos_epiv"),
    "entity_totals": lambda t: ops.entity_totals(t),
    "latest_fleet": lambda t: ops.latest_fleet(t),
}


@pytest.mark.parametrize("name", HOT_QUERIES)
def test_hot_keys_are_split(spark, hot, name):
    query = HOT_QUERIES[name]
    plain = query(hot)
    digest = [F.count("*"), F.sum(F.xxhash64(*plain.columns).cast("decimal(38,0)"))]
    expected = tuple(plain.agg(*digest).head())
    with settings(spark, **TINY_SKEW):
        split = query(hot)
        plan = executed_plan(split)
        assert "SortMergeJoin(skew=true)" in plan, plan
        assert tuple(query(hot).agg(*digest).head()) == expected


def test_hot_key_never_reaches_the_shuffle_whole(spark, hot):
    """A third of all facts has one identifier; after the map side it is one row per task."""
    totals = ops.service_totals(hot, "epiv").where("id_municipio = 7").head()
    entities = hot.credenciados.where("id_municipio = 7").groupBy("cnpj").count()
    facts = hot.servicos_epiv.where("ano = 2024").groupBy("cnpj").agg(F.sum("estampagens").alias("q"))
    expected = entities.join(facts, "cnpj").agg(F.sum(F.col("count") * F.col("q"))).head()[0]
    assert totals["total_estampagens"] == expected


def test_one_per_key_limits_groups_below_the_shuffle(spark, hot):
    plan = executed_plan(ops.one_per_key(hot.servicos_epiv, ["cnpj"], [F.desc("ano"), F.desc("estampagens")]))
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_selection_reaches_the_scan(spark, golden, tmp_path):
    golden.municipios.write.parquet(str(tmp_path / "municipios"))
    areas = spark.read.parquet(str(tmp_path / "municipios"))
    chosen = ops.select_areas(areas, ["1", "01", "x", 2, str(2**40)])
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(id_municipio, \[1,2\]\)", plan)
    assert sorted(r["id_municipio"] for r in chosen.collect()) == [1, 2]
    frame = spark.createDataFrame([("1",), ("01",), ("x",), (None,), ("99999999999999999999",)], "id string")
    assert [r["id_municipio"] for r in ops.select_areas(areas, frame).collect()] == [1]


def test_choropleth_needs_no_window(spark, golden):
    features = spark.createDataFrame([("1", "A")], "id string, name string")
    assert "Window" not in plans.choropleth(golden, features)._jdf.queryExecution().optimizedPlan().toString()
