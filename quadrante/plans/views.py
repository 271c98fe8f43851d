"""Map views: which rows a view shows, which column it colours, how it labels a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrante.functions.numbers import format_number_ptbr
from quadrante.model import DEFAULT_YEAR, NO_DATA_TEXT, Tables, View, map_view
from quadrante.operators.entities import entities_with_service, entity_totals
from quadrante.operators.fleet import latest_fleet
from quadrante.operators.services import service_totals


def view_rows(tables: Tables, view: str = "visao_geral", ano: int = DEFAULT_YEAR) -> DataFrame:
    """The data set behind a view, one row per area (unsorted). Unknown views show entity totals."""
    v = map_view(view)
    if v.source == "entities_by_type":
        return entities_with_service(tables, v.tipo, ano)
    if v.source == "services":
        return service_totals(tables, v.tipo, ano)
    if v.source == "fleet":
        return latest_fleet(tables)
    return entity_totals(tables)


def metric_value(df: DataFrame, view: str) -> Column:
    """The coloured value of a row, NULL as 0. A service view without its total uses ``quantidade``."""
    v: View = map_view(view)
    name = v.metric
    if v.source == "services" and name not in df.columns:
        name = "quantidade"
    if name not in df.columns:
        return F.lit(0).cast("bigint")
    return F.coalesce(F.col(name).cast("bigint"), F.lit(0).cast("bigint"))


def popup_text(view: str, matched: Column, value: Column) -> Column:
    """``label: value`` for an area with data, else the no-data message."""
    text = F.concat(F.lit(f"{map_view(view).label}: "), format_number_ptbr(value))
    return F.when(matched, text).otherwise(F.lit(NO_DATA_TEXT))
