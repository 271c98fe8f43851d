"""Column expressions for names and business identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CNPJ_DIGITS = 14

# Code points of the white space and line ends that an ECMAScript trim removes.
BLANKS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
)

# Name order that ignores case and accents, and name order that only ranks them last.
LOOSE_COLLATION = "UNICODE_CI_AI"
LOCALE_COLLATION = "UNICODE"


def trim_blanks(col: Column) -> Column:
    """Strip every kind of Unicode blank from both ends (SQL ``trim`` only strips spaces)."""
    return F.btrim(col, F.lit("".join(map(chr, BLANKS))))


def digits_only(col: Column) -> Column:
    return F.regexp_replace(col, r"[^0-9]", "")


def format_cnpj(col: Column) -> Column:
    """``XX.XXX.XXX/XXXX-XX``; short values are zero-padded, longer ones come back as bare digits."""
    digits = digits_only(col)
    # The mask of the national identifier.
    padded = F.when(F.length(digits) < CNPJ_DIGITS, F.lpad(digits, CNPJ_DIGITS, "0")).otherwise(digits)
    return F.regexp_replace(padded, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")


def name_key(col: Column | str, collation: str = LOOSE_COLLATION) -> Column:
    """Sort key for names. Use it in ``orderBy`` only, so that column types stay plain strings."""
    return F.collate(col, collation)


def order_by_name(df: DataFrame, name: str, collation: str = LOOSE_COLLATION) -> DataFrame:
    """Sort by name; equal names fall back to the remaining columns, so that the order is total."""
    ties = [c for c, t in df.dtypes if not t.startswith("map")]
    return df.orderBy(name_key(name, collation), *ties)
