"""Small column expressions shared by the operators (all built-in functions, no UDFs)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The words that count as "yes" in each place.
FEATURE_DISCOUNT_WORDS = ("yes", "1", "true", "y", "promo")
FEATURE_HOLIDAY_WORDS = ("yes", "1", "true", "y", "holiday", "1.0")
ANALYSIS_DISCOUNT_WORDS = ("yes", "1", "true", "y", "promo", "discount")
ANALYSIS_HOLIDAY_WORDS = ("yes", "1", "true", "y", "holiday", "1.0")
TEST_HOLIDAY_WORDS = ("yes", "1", "true", "y", "holiday")

# Texts a CSV reader takes for "missing".
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Date layouts tried in this order when a text column is not ISO.
DATE_FORMATS = ("M/d/yyyy", "M-d-yyyy", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy")

EPS = 1e-5


def normalize_name(name: str) -> str:
    """Column name reduced to lower-case letters and digits."""
    return re.sub("[^a-z0-9]+", "", name.lower())


def normalize_text(col: Column) -> Column:
    """The same reduction for values."""
    return F.regexp_replace(F.lower(F.trim(col)), "[^a-z0-9]", "")


def is_truthy(col: Column, words: Iterable[str]) -> Column:
    """Text flag: trimmed lower-case value is one of ``words``; null counts as no."""
    return F.coalesce(F.lower(F.trim(col.cast("string"))).isin(*words), F.lit(False))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN and null mean the same here: missing."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(quoted(c)), quoted(c)) for c in floats})


def is_number(text: Column) -> Column:
    """Text that is a plain number: no type suffixes such as ``12D`` or ``7f``, which a cast would accept."""
    return F.rlike(F.trim(text), F.lit(r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?inf(inity)?$"))


def number(col: Column, dtype: T.DataType) -> Column:
    """Double, or null where the value is no number."""
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return F.when(is_number(col), F.trim(col).try_cast("double"))
    return col.try_cast("double")


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def quoted(name: str) -> Column:
    """Column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def parse_timestamp(col: Column, dtype: T.DataType, fmt: str | None = None) -> Column:
    """Timestamp or null.  Text without ``fmt`` is read as ISO, whole numbers as yyyyMMdd."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col.cast("timestamp")
    if isinstance(dtype, T.NumericType):
        return F.try_to_timestamp(col.cast("bigint").cast("string"), F.lit("yyyyMMdd"))
    text = F.trim(col)
    return F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)


def parse_date(col: Column, dtype: T.DataType, fmt: str | None = None) -> Column:
    """Calendar date or null."""
    if isinstance(dtype, T.DateType):
        return col
    return parse_timestamp(col, dtype, fmt).cast("date")


def round_to(col: Column | str, digits: int) -> Column:
    """Round half away from zero.  Binary noise is dropped first, so a value that is a tie on paper rounds as one."""
    return F.round(F.round(col, 10), digits)


def ratio_pct(part: Column, base: Column, floor: float = EPS) -> Column:
    """``part / max(base, floor) * 100``."""
    return part / F.greatest(base, F.lit(floor)) * 100.0


def currency_text(col: Column, symbol: str = "$") -> Column:
    """Compact money text: $1.32B, $45.5M, $12K, $950.00."""
    size = F.abs(col)
    sign = F.when(col < 0, "-").otherwise("")
    body = (
        F.when(col.isNull(), F.lit("0.00"))
        .when(size >= 1e9, F.format_string("%.2fB", size / 1e9))
        .when(size >= 1e6, F.format_string("%.1fM", size / 1e6))
        .when(size >= 1e3, F.format_string("%.0fK", size / 1e3))
        .otherwise(F.format_number(size, 2))
    )
    return F.concat(F.coalesce(sign, F.lit("")), F.lit(symbol), body)


def readable_date(col: Column) -> Column:
    """Dec 23, 2012; N/A for a missing date."""
    return F.coalesce(F.date_format(col, "MMM dd, yyyy"), F.lit("N/A"))
