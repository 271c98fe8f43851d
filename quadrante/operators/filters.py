"""Filter options, look-ups by name or identifier, highlight classes and the filter summary."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quadrante.functions.text import (
    LOCALE_COLLATION,
    digits_only,
    format_cnpj,
    name_key,
    order_by_name,
    trim_blanks,
)
from quadrante.model import HIGHLIGHT_COLOURS, NO_FILTER_TEXT, Tables

# Heading of each filter in the summary.
SUMMARY_LABELS = {"municipio": "Municípios", "razao_social": "Razão Social", "cnpj": "CNPJ"}


_CANONICAL = r"^(0|-?[1-9][0-9]*)$"
_BYTES = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}


def clean_entities(entities: DataFrame) -> DataFrame:
    """Add ``cnpj_digits``, ``cnpj_fmt`` and ``razao_social_trim``."""
    return entities.withColumns(
        {
            "cnpj_digits": digits_only(F.col("cnpj")),
            "cnpj_fmt": format_cnpj(F.col("cnpj")),
            "razao_social_trim": trim_blanks(F.col("razao_social")),
        }
    )


def name_options(entities: DataFrame) -> DataFrame:
    """Distinct trimmed legal names in locale order; a name of blanks only becomes an empty option."""
    named = entities.where(F.col("razao_social") != "")
    options = named.select(trim_blanks(F.col("razao_social")).alias("razao_social")).distinct()
    return order_by_name(options, "razao_social", LOCALE_COLLATION)


def cnpj_options(entities: DataFrame) -> DataFrame:
    """Distinct identifiers ``(valor, rotulo)`` = (digits, formatted), by formatted text."""
    options = entities.select(digits_only(F.col("cnpj")).alias("valor")).where(F.length("valor") > 0)
    labelled = options.distinct().select("valor", format_cnpj(F.col("valor")).alias("rotulo"))
    return order_by_name(labelled, "rotulo", LOCALE_COLLATION)


def areas_by_name(entities: DataFrame, razao_social: str, trim_stored: bool = False) -> DataFrame:
    """Distinct areas of the entities with exactly this legal name.

    Options are trimmed while stored names may not be; ``trim_stored`` lets such names match.
    """
    stored = F.col("razao_social")
    stored = trim_blanks(stored) if trim_stored else stored
    return entities.where(stored == F.lit(razao_social)).select("id_municipio").distinct()


def areas_by_cnpj(entities: DataFrame, cnpj: str, normalize_stored: bool = False) -> DataFrame:
    """Distinct areas of the entity with this identifier, given in any format.

    The formatted filter meets the stored value as it is; ``normalize_stored`` formats that too.
    """
    stored = F.col("cnpj")
    stored = format_cnpj(stored) if normalize_stored else stored
    return entities.where(stored == format_cnpj(F.lit(cnpj))).select("id_municipio").distinct()


def select_areas(df: DataFrame, ids: Sequence[int | str] | DataFrame, id_col: str = "id_municipio") -> DataFrame:
    """Keep the rows whose area is selected, ids compared as text. ``ids``: values, or a one-column frame.

    Where the column is an integer, texts that are no canonical integer match nothing and the others are compared
    as integers, so that the selection reaches the scan.
    """
    whole = isinstance(df.schema[id_col].dataType, IntegralType)
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).cast("string").alias("_id"))
        if not whole:
            return df.join(wanted, F.col(id_col).cast("string") == F.col("_id"), "left_semi")
        wanted = wanted.where(F.col("_id").rlike(_CANONICAL)).select(F.expr("try_cast(_id AS BIGINT)").alias("_id"))
        return df.join(wanted, F.col(id_col).cast("bigint") == F.col("_id"), "left_semi")
    texts = [str(i) for i in ids]
    if not whole:
        return df.where(F.col(id_col).cast("string").isin(texts))
    largest = 2 ** (8 * _BYTES[df.schema[id_col].dataType.simpleString()] - 1)
    numbers = [int(t) for t in texts if re.match(_CANONICAL, t) and -largest <= int(t) < largest]
    return df.where(F.col(id_col).isin(numbers)) if numbers else df.where(F.lit(False))


def highlight(
    df: DataFrame,
    entities: DataFrame,
    *,
    ids: Sequence[int | str] = (),
    razao_social: str | None = None,
    cnpj: str | None = None,
    precedence: str = "last",
    id_col: str = "id_municipio",
    trim_stored: bool = False,
    normalize_stored: bool = False,
) -> DataFrame:
    """Add ``destaque`` (``municipio`` / ``razao_social`` / ``cnpj`` / NULL) and its colour.

    Filters rank area, name, identifier. With ``precedence="last"`` the last matching one wins, as
    in a redraw; with ``"first"`` the first one does, as when a style is restored.
    """
    if precedence not in ("last", "first"):
        raise ValueError("precedence is 'last' or 'first'")
    classes: list[tuple[str, Column]] = []
    out = df
    if ids:
        classes.append(("municipio", F.col(id_col).cast("string").isin([str(i) for i in ids])))
    # Both look-ups are flags of one pass over the entities.
    flags: dict[str, Column] = {}
    if razao_social:
        name = trim_blanks(F.col("razao_social")) if trim_stored else F.col("razao_social")
        flags["_por_nome"] = F.coalesce(name == F.lit(razao_social), F.lit(False))
        classes.append(("razao_social", F.col("_por_nome")))
    if cnpj:
        identifier = format_cnpj(F.col("cnpj")) if normalize_stored else F.col("cnpj")
        flags["_por_cnpj"] = F.coalesce(identifier == format_cnpj(F.lit(cnpj)), F.lit(False))
        classes.append(("cnpj", F.col("_por_cnpj")))
    if flags:
        found = entities.where(reduce(lambda a, b: a | b, flags.values()))
        found = found.groupBy(F.col("id_municipio").cast("string").alias("_id")).agg(*[F.max(c).alias(n) for n, c in flags.items()])
        out = out.join(found, F.col(id_col).cast("string") == F.col("_id"), "left").drop("_id")
    if precedence == "last":
        classes.reverse()
    name = F.lit(None).cast("string")
    colour = F.lit(None).cast("string")
    for label, hit in reversed(classes):
        name = F.when(hit, F.lit(label)).otherwise(name)
        colour = F.when(hit, F.lit(HIGHLIGHT_COLOURS[label])).otherwise(colour)
    return out.withColumns({"destaque": name, "cor_destaque": colour}).drop("_por_nome", "_por_cnpj")


def _selected_names(tables: Tables, ids: Sequence[int | str]) -> DataFrame:
    """One row: the names of the selected areas in selection order, the id where none is known.

    The number of rows gathered is the length of ``ids``, an argument of the call.
    """
    chosen = F.array(
        *[F.struct(F.lit(i).alias("_pos"), F.lit(str(v)).alias("_id")) for i, v in enumerate(ids)]
    )
    spark = tables.municipios.sparkSession
    selection = spark.range(1).select(F.inline(chosen))
    known = (
        select_areas(tables.municipios, ids)
        .groupBy(F.col("id_municipio").cast("string").alias("_id"))
        .agg(F.min_by("nome", name_key("nome")).alias("nome"))
    )
    named = selection.join(known, "_id", "left")
    entry = F.struct("_pos", F.coalesce("nome", "_id").alias("_rotulo"))
    in_order = F.sort_array(F.collect_list(entry))
    return named.agg(F.array_join(F.transform(in_order, lambda e: e["_rotulo"]), ", ").alias("_nomes"))


def filter_summary(
    tables: Tables,
    *,
    ids: Sequence[int | str] = (),
    razao_social: str | None = None,
    cnpj: str | None = None,
) -> DataFrame:
    """One row ``(filtro, texto, cor)`` per active filter, or one row saying that there is none."""
    spark = tables.municipios.sparkSession
    one = spark.range(1)

    def line(source: DataFrame, kind: str, value: Column) -> DataFrame:
        return source.select(
            F.lit(kind).alias("filtro"),
            F.concat(F.lit(f"{SUMMARY_LABELS[kind]}: "), value).alias("texto"),
            F.lit(HIGHLIGHT_COLOURS[kind]).alias("cor"),
        )

    lines = []
    if ids:
        lines.append(line(_selected_names(tables, ids), "municipio", F.col("_nomes")))
    if razao_social:
        lines.append(line(one, "razao_social", F.lit(razao_social)))
    if cnpj:
        lines.append(line(one, "cnpj", format_cnpj(F.lit(cnpj))))
    if not lines:
        return one.select(
            F.lit(None).cast("string").alias("filtro"),
            F.lit(NO_FILTER_TEXT).alias("texto"),
            F.lit(None).cast("string").alias("cor"),
        )
    out = lines[0]
    for more in lines[1:]:
        out = out.unionByName(more)
    return out
