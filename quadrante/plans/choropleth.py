"""The table behind a choropleth map: features with value, class, colour, label and highlight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrante.model import DEFAULT_YEAR, Tables, map_view
from quadrante.operators.classes import class_breaks, legend, with_buckets
from quadrante.operators.entities import entity_rows
from quadrante.operators.filters import highlight
from quadrante.plans.views import metric_value, popup_text, view_rows


def view_values(tables: Tables, view: str, ano: int = DEFAULT_YEAR) -> DataFrame:
    """``(id_municipio, valor)`` for every row of a view."""
    rows = view_rows(tables, view, ano)
    return rows.select("id_municipio", metric_value(rows, view).alias("valor"))


def view_breaks(tables: Tables, view: str, ano: int = DEFAULT_YEAR) -> DataFrame:
    """The class breaks of a view, one row."""
    return class_breaks(view_values(tables, view, ano), "valor", fleet=map_view(view).source == "fleet")


def view_legend(tables: Tables, view: str, ano: int = DEFAULT_YEAR) -> DataFrame:
    return legend(view_breaks(tables, view, ano))


def join_features(features: DataFrame, values: DataFrame) -> DataFrame:
    """Attach ``valor`` to every feature by id as text; a feature without data has value 0.

    ``com_dados`` tells the two cases apart. ``values`` has at most one row per area.
    """
    keyed = values.select(
        F.col("id_municipio").cast("string").alias("_chave"), "valor", F.lit(True).alias("_achado")
    )
    joined = features.join(keyed, F.col("id").cast("string") == F.col("_chave"), "left")
    return joined.select(
        *features.columns,
        F.coalesce("valor", F.lit(0).cast("bigint")).alias("valor"),
        F.coalesce("_achado", F.lit(False)).alias("com_dados"),
    )


def choropleth(
    tables: Tables,
    features: DataFrame,
    view: str = "visao_geral",
    ano: int = DEFAULT_YEAR,
    *,
    ids: Sequence[int | str] = (),
    razao_social: str | None = None,
    cnpj: str | None = None,
    precedence: str = "last",
) -> DataFrame:
    """One row per feature: ``id, name, valor, com_dados, faixa, cor, texto, destaque, cor_destaque``.

    ``features`` has the columns ``id`` and ``name``. Of several rows of an area the one with the
    largest value is shown, so that breaks and values agree. The breaks are a scalar subquery over
    the same rows; Spark reuses the shuffles below them.
    """
    values = view_values(tables, view, ano)
    breaks = class_breaks(values, "valor", fleet=map_view(view).source == "fleet")
    largest = values.groupBy(F.col("id_municipio").cast("string").alias("id_municipio")).agg(F.max("valor").alias("valor"))
    shown = join_features(features.select("id", "name"), largest)
    painted = with_buckets(shown, "valor", breaks).withColumn(
        "texto", popup_text(view, F.col("com_dados"), F.col("valor"))
    )
    return highlight(
        painted,
        entity_rows(tables),
        ids=ids,
        razao_social=razao_social,
        cnpj=cnpj,
        precedence=precedence,
        id_col="id",
    )
