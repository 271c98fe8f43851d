"""Column expressions for numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_if_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(0).cast("bigint"))


def row_sum(names: tuple[str, ...]) -> Column:
    """Sum columns of one row; a single NULL makes the whole sum NULL."""
    return F.expr(" + ".join(f"CAST({n} AS BIGINT)" for n in names))


def row_sum_zero_filled(names: tuple[str, ...]) -> Column:
    """Sum columns of one row, counting NULL as 0."""
    return F.expr(" + ".join(f"COALESCE(CAST({n} AS BIGINT), 0L)" for n in names))


def format_number_ptbr(col: Column) -> Column:
    """Grouped thousands with at most three decimals, Brazilian separators; NULL and NaN read ``0``, as does what rounds to it."""
    filled = F.coalesce(F.when(~F.isnan(col), col), F.lit(0))
    text = F.call_function("format_number", filled, F.lit("#,##0.###"))
    return F.translate(F.when(text == "-0", "0").otherwise(text), ",.", ".,")
