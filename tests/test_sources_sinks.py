"""Files in and out: formats, GeoJSON, JSON rows, column checks and JDBC options."""

from __future__ import annotations

import json
import shutil

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quadrante import operators as ops
from quadrante.functions import trim_blanks
from quadrante.model import INSPECTION_EXTRA, SCHEMAS, Tables
from quadrante.sinks import to_json_rows, write_json, write_tables
from quadrante.sources import (
    JdbcRange,
    conform,
    jdbc_url,
    key_ranges,
    load_tables,
    load_tables_jdbc,
    read_feature_lines,
    read_features,
    read_json_rows,
    require_columns,
)


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_formats_give_the_same_totals(spark, golden, tmp_path, fmt):
    for name in Tables.names():
        writer = getattr(golden, name).write.format(fmt)
        if fmt == "csv":
            # Quoted, so that the blanks around a name survive and an empty name is not NULL.
            writer = writer.options(header=True, quoteAll=True, emptyValue="")
        writer.save(str(tmp_path / name))
    stored = load_tables(spark, str(tmp_path), fmt, optional=[INSPECTION_EXTRA])
    assert stored.servicos_ecv.dtypes[1:3] == [("ano", "int"), ("vistoria_lacrada_veic_combinado", "bigint")]
    for query in (ops.entity_totals, ops.latest_fleet, lambda t: ops.service_totals(t, "ecv", extended=True)):
        assert rows(query(stored)) == rows(query(golden))


def test_partitioned_star_schema_round_trip(spark, golden, tmp_path):
    write_tables(golden, str(tmp_path / "star"))
    empty = [n for n in Tables.names() if not getattr(golden, n).count()]
    stored = load_tables(spark, str(tmp_path / "star"), allow_empty=empty)
    for name in Tables.names():
        assert rows(getattr(stored, name)) == rows(getattr(golden, name))


def test_unknown_format_and_missing_column(spark, golden, tmp_path):
    with pytest.raises(ValueError):
        load_tables(spark, str(tmp_path), "xlsx")
    with pytest.raises(ValueError, match="razao_social"):
        conform(golden.credenciados.drop("razao_social"), "credenciados")
    assert require_columns(golden.municipios, ["ID_MUNICIPIO"]) is golden.municipios


def test_column_names_ignore_case(spark):
    df = spark.createDataFrame([(1, "Barra")], "id_municipio int, Nome string")
    assert conform(df, "municipios").columns == ["id_municipio", "nome"]


def test_extended_total_needs_its_column(golden):
    from dataclasses import replace

    short = replace(golden, servicos_ecv=golden.servicos_ecv.drop("vistoria_veicular_combinacoes_extra"))
    assert ops.service_totals(short, "ecv").count() == 4
    with pytest.raises(ValueError, match="extra"):
        ops.service_totals(short, "ecv", extended=True)


def test_geojson(spark, tmp_path):
    def feature(i, name, kind, coordinates):
        return {"type": "Feature", "properties": {"id": i, "name": name, "x": 1},
                "geometry": {"type": kind, "coordinates": coordinates}}

    ring = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    collection = {"type": "FeatureCollection", "features": [
        feature("2900108", "Abaíra", "Polygon", ring), feature(2900207, "Abaré", "MultiPolygon", [ring])]}
    (tmp_path / "geo.json").write_text(json.dumps(collection), encoding="utf8")
    features = read_features(spark, str(tmp_path / "geo.json"))
    assert features.dtypes == [("id", "string"), ("name", "string")]
    assert rows(features) == [("2900108", "Abaíra"), ("2900207", "Abaré")]


def test_json_rows(spark, golden, tmp_path):
    fleet = ops.nest_fleet(ops.latest_fleet(golden)).where("id_municipio in (2, 3)")
    write_json(fleet, str(tmp_path / "frotas"))
    lines = [json.loads(x) for p in (tmp_path / "frotas").glob("*.json") for x in p.read_text(encoding="utf8").splitlines()]
    assert len(lines) == 2 and all("ano_frota" in x and x["ano_frota"] is None for x in lines)
    back = read_json_rows(spark, str(tmp_path / "frotas"), fleet.schema, required=["id_municipio"])
    assert rows(back.select("id_municipio", "total_frota")) == [(2, 0), (3, 0)]
    with pytest.raises(ValueError, match="cnpj"):
        read_json_rows(spark, str(tmp_path / "frotas"), fleet.schema, required=["cnpj"])


def test_json_document_and_malformed_input(spark, tmp_path):
    (tmp_path / "lista.json").write_text('[{"id": 1, "nome": "Á"},\n {"id": 2, "nome": null}]', encoding="utf8")
    listed = read_json_rows(spark, str(tmp_path / "lista.json"), "id int, nome string", ["id"], one_document=True)
    assert rows(listed) == [(1, "Á"), (2, None)]
    (tmp_path / "erro.json").write_text("<html>500</html>", encoding="utf8")
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        read_json_rows(spark, str(tmp_path / "erro.json"), "id int").collect()


def test_json_text_keeps_nulls_and_order(spark):
    df = spark.range(1).select(F.lit(None).cast("int").alias("b"), F.lit("x").alias("a"))
    assert to_json_rows(df).head()[0] == '{"b":null,"a":"x"}'


def test_an_optional_column_is_read_from_json_only_if_named(spark, golden, tmp_path):
    for name in Tables.names():
        getattr(golden, name).drop(INSPECTION_EXTRA).write.json(str(tmp_path / name))
    with pytest.raises(ValueError, match=INSPECTION_EXTRA):
        ops.service_totals(load_tables(spark, str(tmp_path), "json"), "ecv", extended=True)


def test_a_table_without_files_raises(spark, golden, tmp_path):
    for name in Tables.names():
        getattr(golden, name).write.parquet(str(tmp_path / "star" / name))
    lost = shutil.copytree(tmp_path / "star", tmp_path / "lost", ignore=lambda d, names: names if d.endswith("servicos_ecv") else [])
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        load_tables(spark, str(lost))
    stored = load_tables(spark, str(lost), allow_empty=["servicos_ecv"], optional=[INSPECTION_EXTRA])
    assert stored.servicos_ecv.count() == 0 and INSPECTION_EXTRA in stored.servicos_ecv.columns


def test_feature_lines(spark, tmp_path):
    features = [{"type": "Feature", "properties": {"id": str(k), "name": f"N{k}"}, "geometry": {"x": [k]}} for k in range(3)]
    (tmp_path / "f.jsonl").write_text("\n".join(map(json.dumps, features)))
    assert rows(read_feature_lines(spark, str(tmp_path / "f.jsonl"))) == [(str(k), f"N{k}") for k in range(3)]


def test_jdbc_options(spark):
    url = jdbc_url("db", 3307, "registro")
    assert url.startswith("jdbc:mysql://db:3307/registro?") and "useCursorFetch=true" in url
    assert JdbcRange("id", 0, 90, 9).options() == {"column": "id", "lowerBound": 0, "upperBound": 90, "numPartitions": 9}
    first, *rest = key_ranges("cnpj", ["1", "5'"])
    assert "IS NULL" in first and rest == ["cnpj >= '1' AND cnpj < '5\'\''", "cnpj >= '5\'\''"]
    with pytest.raises(ValueError, match="servicos_ecv"):
        load_tables_jdbc(spark, url, {}, {"servicos_cfc": JdbcRange("id", 0, 9, 2)})


def test_schemas_name_every_table():
    assert set(SCHEMAS) == set(Tables.names())


@pytest.mark.parametrize("blank", [9, 11, 12, 13, 32, 0xA0, 0x1680, 0x2003, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
def test_trim_removes_every_blank(spark, blank):
    b = chr(blank)
    df = spark.createDataFrame([(f"{b}{b}a{b}b{b}",)], "s string")
    assert df.select(trim_blanks(F.col("s"))).head()[0] == f"a{b}b"
