"""Stored stars: schemas without footers, lost files, layout that prunes look-ups, the maintained reduction."""

from __future__ import annotations

import shutil
from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quadrante import operators as ops
from quadrante import plans
from quadrante.model import Tables
from quadrante.operators.joins import HOT_KEYS, hot_keys, left_join_many
from quadrante.sinks import write_tables
from quadrante.sources import accepted_rows, decode_json_rows, equal_cuts, key_ranges, load_tables, rejected_rows


def scans(plan) -> list:
    """The scans of an executed plan, those of finished stages too."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return scans(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return scans(plan.plan())
    children = plan.children()
    found = [plan] if name == "FileSourceScanExec" else []
    return found + [s for k in range(children.size()) for s in scans(children.apply(k))]


def rows_read(df, column: str) -> int:
    """Rows that the scans with this column gave to the query."""
    df.collect()
    read = [s for s in scans(df._jdf.queryExecution().executedPlan()) if f"{column}#" in s.output().mkString(",")]
    assert read
    return sum(s.metrics().apply("numOutputRows").value() for s in read)


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """100 areas of 400 entities with neighbouring identifiers, one fact each and many of one; small row groups."""
    n = 40_000
    cnpj = "lpad(cast(id as string), 14, '0')"
    shuffled = spark.range(n).orderBy(F.xxhash64("id"))
    facts = spark.range(n).selectExpr("id", "id v").union(spark.range(20_000).selectExpr("77 as id", "id v")).orderBy(F.xxhash64("v"))
    small = dict(zip(("servicos_cfc", "servicos_clinicas", "servicos_ecv", "servicos_patio"), ((2, "cursos_teoricos", "cursos_praticos"), (2, "exames_medicos", "exames_psicologicos"), None, (1, "veiculos_removidos"))))
    from quadrante.model import INSPECTION_MEASURES, VEHICLES

    small["servicos_ecv"] = (0, *INSPECTION_MEASURES)
    tables = Tables(
        municipios=spark.range(100).selectExpr("cast(id as int) id_municipio", "concat('Area ', id) nome"),
        credenciados=shuffled.selectExpr(f"{cnpj} cnpj", "concat('Nome ', sha2(cast(id as string), 256)) razao_social", "cast(id div 400 as int) id_municipio"),
        servicos_epiv=facts.selectExpr(f"{cnpj} cnpj", "if(id % 3 = 0, 2023, 2024) ano", "v estampagens"),
        populacao=spark.range(100).selectExpr("cast(id as int) id_municipio", "id populacao"),
        frotas=spark.range(0).selectExpr("cast(id as int) id_municipio", "2024 ano", *[f"id {v}" for v in VEHICLES]),
        **{t: spark.range(0).selectExpr(f"{cnpj} cnpj", "2024 ano", *[f"id {m}" for m in measures]) for t, (_, *measures) in small.items()},
    )
    path = str(tmp_path_factory.mktemp("estrela") / "star")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_tables(tables, path, row_group_bytes=1 << 16)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return tables, path


def test_round_trip_with_empty_partitioned_tables(spark, star):
    tables, path = star
    stored = load_tables(spark, path)
    for name in Tables.names():
        a, b = getattr(tables, name), getattr(stored, name)
        assert a.columns == b.columns and dict(a.dtypes).keys() == dict(b.dtypes).keys()
        assert a.count() == b.count() and a.exceptAll(b.select(*a.columns)).isEmpty()


def test_tables_are_resolved_on_first_use(spark, star):
    used = []

    def table(name):
        return lambda: used.append(name) or getattr(star[0], name)

    tables = Tables(**{n: table(n) for n in Tables.names()})
    ops.area_list(tables)
    assert used == ["municipios"]
    other = tables.with_tables(populacao=star[0].populacao)
    assert used == ["municipios"] and other.municipios is tables.municipios
    ops.service_totals(other, "epiv")
    assert used == ["municipios", "credenciados", "servicos_epiv"] or sorted(used) == ["credenciados", "municipios", "servicos_epiv"]


def test_schemas_come_from_the_description(spark, star, tmp_path):
    """No footer is opened: files that are no parquet are found out only when they are read."""
    broken = shutil.copytree(star[1], tmp_path / "star")
    for file in (broken / "credenciados").glob("*.parquet"):
        file.write_bytes(b"no parquet")
    for file in (broken / "credenciados").glob(".*.crc"):
        file.unlink()
    stored = load_tables(spark, str(broken))
    assert stored.credenciados.columns == ["cnpj", "razao_social", "id_municipio"]
    with pytest.raises(Exception):
        stored.credenciados.count()


def test_lost_files_raise(spark, star, tmp_path):
    lost = shutil.copytree(star[1], tmp_path / "star")
    files = sorted((lost / "servicos_epiv").rglob("*.parquet"))
    files[0].unlink()
    stored = load_tables(spark, str(lost))
    assert stored.municipios.count() == 100
    with pytest.raises(FileNotFoundError, match="servicos_epiv"):
        stored.servicos_epiv
    shutil.rmtree(lost / "populacao")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_tables(spark, str(lost)).populacao


def test_look_ups_skip_row_groups(spark, star):
    """An identifier by the order of the rows, a name by Bloom filters: its row group only."""
    stored = load_tables(spark, star[1])
    every = stored.credenciados.count()
    one = stored.credenciados.where("razao_social is not null").head()
    by_cnpj = stored.credenciados.where(F.col("cnpj") == one["cnpj"])
    by_name = ops.areas_by_name(stored.credenciados, one["razao_social"])
    assert by_cnpj.count() == 1 and by_name.count() == 1
    assert 0 < rows_read(by_cnpj, "cnpj") <= every / 10
    assert 0 < rows_read(by_name, "razao_social") <= every / 10


def test_one_area_reads_its_part_of_the_facts(spark, star):
    tables, path = star
    stored = load_tables(spark, path)
    facts = stored.servicos_epiv.where("ano = 2024").count()
    one = ops.service_details(stored, "epiv", id_municipio=60)
    assert rows_read(one, "estampagens") <= facts / 10
    assert rows(one.select("id_municipio", "total")) == rows(ops.service_details(tables, "epiv", id_municipio=60).select("id_municipio", "total"))
    assert rows(plans.profile_rows(stored, id_municipio=60)) == rows(plans.profile_rows(tables, id_municipio=60))


def test_a_hot_identifier_lies_in_several_files(spark, star):
    hot = load_tables(spark, star[1]).servicos_epiv.where("cnpj = '00000000000077'").groupBy(F.input_file_name().alias("f")).count()
    assert hot.count() > 1


def test_maintained_reduction(spark, golden, tmp_path):
    path = str(tmp_path / "reducao")
    with pytest.raises(ValueError):
        ops.write_reduction(golden, path, [])
    gone = golden.with_tables(servicos_epiv=golden.servicos_epiv.limit(0))
    ops.write_reduction(golden, path, [2023, 2024])
    for tipo in ("cfc", "clinicas", "ecv", "epiv", "patio"):
        for year in (2023, 2024):
            totals = ops.service_totals(golden, tipo, year, yearly=ops.reduced_year(spark, path, tipo, year))
            assert rows(totals) == rows(ops.service_totals(golden, tipo, year))
    ops.write_reduction(gone, path, [2024])  # a year whose facts are gone is replaced too, the other stays
    for year, tables in ((2024, gone), (2023, golden)):
        totals = ops.service_totals(golden, "epiv", year, yearly=ops.reduced_year(spark, path, "epiv", year))
        assert rows(totals) == rows(ops.service_totals(tables, "epiv", year))
    with pytest.raises(LookupError):
        ops.reduced_year(spark, path, "cfc", 1999)


def test_rejected_rows(spark):
    texts = ['{"k": 1}', '{"k": "x"}', "{", None, '{"j": 2}', '{"k": null}', "[1]", "", "7", '{"k": 3, "z": {}}']
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    decoded = decode_json_rows(df, "t", "k bigint", ["k"])
    good, bad = accepted_rows(decoded, "t"), rejected_rows(decoded, "t", "k bigint")
    assert good.columns == ["n", "k"] and bad.columns == ["n", "t", "motivo"]
    assert rows(good) == [(0, 1), (9, 3)]
    assert {r["n"]: r["motivo"] for r in bad.collect()} == {
        1: "JSON inválido", 2: "JSON inválido", 3: "texto ausente", 4: "coluna ausente: k", 5: "coluna ausente: k",
        6: "JSON inválido", 7: "JSON inválido", 8: "JSON inválido",
    }
    with pytest.raises(ValueError, match="q"):
        decode_json_rows(df, "t", "k bigint", ["q"])


def test_cuts_of_equal_depth(spark):
    stored = spark.range(10_000).selectExpr("lpad(cast(id * id as string), 14, '0') cnpj").union(spark.sql("select 'sem numero' union all select null"))
    cuts = equal_cuts(stored, "cnpj", 8)
    assert len(cuts) == 7 and all(len(c) == 14 for c in cuts)
    sizes = [stored.where(p).count() for p in key_ranges("cnpj", cuts)]
    assert sum(sizes) == 10_002 and max(sizes) <= 1300
    assert equal_cuts(stored, "cnpj", 1) == [] and equal_cuts(stored.limit(0), "cnpj", 4) == []
    assert equal_cuts(spark.range(100).selectExpr("'00000000000005' cnpj"), "cnpj", 4) == ["00000000000005"]


def test_left_join_deals_hot_keys(spark):
    """Half of the right rows have one key; no place gets more than a few of them, and every row of a left join is there once."""
    one = spark.range(-5, 200).selectExpr("if(id < 0, null, id) k", "concat('n', id) n")
    one = one.unionByName(one.where("k = 7"))
    many = spark.range(4000).selectExpr("if(id % 2 = 0, 7, if(id % 5 = 0, null, id % 90)) k", "id v")
    assert len(hot_keys(many, ["k"]).first()["hot"]) == 1 and hot_keys(many.limit(0), ["k"]).first()["hot"] == []
    got, plain = left_join_many(one, many, ["k"]).select("k", "n", "v"), one.join(many, ["k"], "left").select("k", "n", "v")
    assert got.count() == plain.count() and got.exceptAll(plain).isEmpty()
    places = many.where("k = 7").groupBy(F.pmod(F.xxhash64("k", "v"), F.lit(HOT_KEYS))).count()
    assert places.count() > HOT_KEYS / 2 and places.agg(F.max("count")).first()[0] < 2000 / 8
    empty = left_join_many(one, many.limit(0), ["k"])
    assert empty.count() == one.count()


def test_latest_fleet_reads_each_side_once(spark, golden, tmp_path):
    """Two scans of the fleet (the years and the rows) and one for the sketch, one of the areas; no part is joined twice."""
    write_tables(golden, str(tmp_path / "star"))
    stored = load_tables(spark, str(tmp_path / "star"))
    plan = ops.latest_fleet(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 3 and "Join LeftAnti" not in plan and "Union" not in plan


def test_replace_keeps_working(golden):
    assert replace(golden, populacao=golden.populacao.limit(0)).populacao.count() == 0
