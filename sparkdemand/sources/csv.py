"""CSV in with dialect detection, tables out."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdemand.functions.columns import MISSING_TOKENS, is_number, quoted, string_columns, trim_headers

# Encodings and separators in the order they are tried.
ENCODINGS = ("UTF-8", "ISO-8859-1")
SEPARATORS = (",", ";", "\t", "|")


@dataclass(frozen=True)
class Dialect:
    encoding: str
    sep: str | None  # None: no separator splits the header
    multiline: bool  # some quoted value holds a line break


def sniff_dialect(spark: SparkSession, path: str) -> Dialect:
    """Encoding, separator and line breaks of a file.

    One pass over all lines counts those that are no UTF-8 and those in which a quote stays open.  The separator is
    the first that splits the header, quotes respected, into more than one column.
    """
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    n, bad, open_quotes = lines.agg(
        F.count(F.lit(1)), F.count_if(~F.is_valid_utf8("value")), F.count_if(quotes % 2 == 1)
    ).first()
    encoding = ENCODINGS[1] if bad else ENCODINGS[0]
    if n < 2:
        return Dialect(encoding, None, False)
    header = lines.first()[0].lstrip("\ufeff")
    sep = next((s for s in SEPARATORS if len(next(csv.reader([header], delimiter=s), [])) > 1), None)
    return Dialect(encoding, sep, open_quotes > 0)


def _inferred_types(df: DataFrame) -> dict[str, str]:
    """Narrowest type every non-missing value of a column fits in: bigint, double, or text (one pass)."""
    tests = []
    for i, c in enumerate(df.columns):
        x = F.trim(quoted(c))
        tests += [
            F.count(x).alias(f"n{i}"),
            F.count(F.when(F.rlike(x, F.lit(r"^[+-]?\d{1,18}$")), x)).alias(f"l{i}"),
            F.count(F.when(is_number(x), x)).alias(f"d{i}"),
            F.count(F.when(F.lower(x).isin("true", "false"), x)).alias(f"b{i}"),
        ]
    row = df.agg(*tests).first()
    out = {}
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        if n and row[f"l{i}"] == n:
            out[c] = "bigint"
        elif n and row[f"d{i}"] == n:
            out[c] = "double"
        elif n and row[f"b{i}"] == n:
            out[c] = "boolean"
    return out


def load_csv(spark: SparkSession, path: str, infer_types: bool = True) -> DataFrame:
    """Read a CSV whose encoding and separator are unknown.

    Values are read as text, the usual "missing" words become null, then types are inferred.  Without a
    recognised separator the file is read with commas and trimmed headers.
    """
    d = sniff_dialect(spark, path)
    raw = spark.read.csv(
        path, header=True, inferSchema=False, sep=d.sep or ",", encoding=d.encoding, quote='"', escape='"', multiLine=d.multiline
    )
    if d.sep is None:
        raw = trim_headers(raw)
    text = raw.withColumns({c: F.when(~quoted(c).isin(*MISSING_TOKENS), quoted(c)) for c in string_columns(raw)})
    if not infer_types:
        return text
    casts = _inferred_types(text)
    return text.withColumns({c: F.trim(quoted(c)).try_cast(t) for c, t in casts.items()})


def write_csv(df: DataFrame, path: str) -> str:
    """Folder of CSV parts with headers."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, date: str | None = None, sort: tuple[str, ...] = ()) -> str:
    """Parquet, by month of ``date`` when given so that range filters skip files; sorted inside the files.

    Rows of a month spread over as many tasks as their bytes need, so one busy month is no bottleneck.
    """
    out = df
    if date:
        out = out.withColumn("year_month", F.date_format(date, "yyyy-MM")).hint("rebalance", "year_month")
    if sort:
        out = out.sortWithinPartitions(*(["year_month"] if date else []), *map(quoted, sort))
    writer = out.write.mode("overwrite")
    (writer.partitionBy("year_month") if date else writer).parquet(path)
    return path
