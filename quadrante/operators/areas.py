"""Area list and look-up."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrante.functions.text import order_by_name
from quadrante.model import Tables


def area_list(tables: Tables) -> DataFrame:
    """``(id, nome)`` of every area, by name."""
    listed = tables.municipios.select(F.col("id_municipio").alias("id"), "nome")
    return order_by_name(listed, "nome")


def area_by_id(tables: Tables, id_municipio: int) -> DataFrame:
    """The area with this id; an unknown id gives no row."""
    wanted = F.lit(int(id_municipio))
    return tables.municipios.where(F.col("id_municipio") == wanted).select("id_municipio", "nome")


def require_row(df: DataFrame) -> DataFrame:
    """Raise ``LookupError`` if ``df`` has no row. This runs a one-row job."""
    if df.isEmpty():
        raise LookupError("area not found")
    return df


def distinct_areas(tables: Tables) -> DataFrame:
    """One row per ``(id_municipio, nome)``; ``_copias`` says how often the table repeats it."""
    return tables.municipios.groupBy("id_municipio", "nome").agg(F.count(F.lit(1)).alias("_copias"))


def with_area_names(tables: Tables, per_area: DataFrame, sums: Iterable[str], counts: Iterable[str]) -> DataFrame:
    """Left join per-area figures (unique ``id_municipio``) to every area, missing ones as 0.

    A repeated area row repeats what is summed but not what is counted distinctly.
    """
    joined = distinct_areas(tables).join(per_area, "id_municipio", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "id_municipio",
        F.col("nome").alias("nome_municipio"),
        *[F.coalesce(F.col(c) * F.col("_copias"), zero).alias(c) for c in sums],
        *[F.coalesce(F.col(c), zero).alias(c) for c in counts],
    )
