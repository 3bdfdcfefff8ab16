"""Table profile: structure, dates, missing values, numbers, categories, integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdemand.functions.columns import nan_to_null, numeric_columns, quoted, round_to, string_columns
from sparkdemand.operators.order import agg_with_quantiles


def unpivot_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form ``Column, Value`` with every value as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("Column"), quoted(c).cast("string").alias("Value")) for c in columns])
    return nan_to_null(df.select(*map(quoted, columns))).select(F.inline(pairs))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``Column, Value, n`` for all listed columns from one scan and one shuffle (map-side combined)."""
    return unpivot_text(df, columns).groupBy("Column", "Value").agg(F.count(F.lit(1)).alias("n"))


#: Types of up to eight bytes, on which the 64-bit hash is one-to-one.
_NARROW = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _cell(column: Column, kind: T.DataType) -> tuple[Column, Column]:
    """A cell as two numbers: one for narrow types, two independent hashes for the others, both null for null."""
    if isinstance(kind, _NARROW):
        return F.when(column.isNotNull(), F.xxhash64(column)), F.lit(0).cast("long")
    value = column if isinstance(kind, T.StringType) else column.cast("string")
    return F.when(column.isNotNull(), F.xxhash64(value)), F.xxhash64(F.lit(1), value)


def column_counts(df: DataFrame) -> DataFrame:
    """Per column: rows, missing cells, distinct values with null counted as one.

    One pass and one shuffle of fixed-width rows: cells travel as (column number, value hash), never as text, and equal
    ones are joined before the shuffle.
    """
    plain = nan_to_null(df)
    cells = []
    for i, f in enumerate(plain.schema.fields):
        a, b = _cell(quoted(f.name), f.dataType)
        cells.append(F.struct(F.lit(i).alias("c"), a.alias("a"), b.alias("b")))
    seen = plain.select(F.inline(F.array(*cells))).groupBy("c", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(c) for c in df.columns])
    return (
        seen.groupBy("c")
        .agg(
            F.sum("n").alias("Rows"),
            F.sum(F.when(F.col("a").isNull(), F.col("n")).otherwise(0)).alias("Missing"),
            F.count(F.lit(1)).alias("Unique_Values"),
        )
        .select(F.get(names, F.col("c")).alias("Column"), "Rows", "Missing", "Unique_Values")
    )


def structure(df: DataFrame) -> DataFrame:
    """Rows, columns and exact duplicate rows (one shuffle; copies collapse before it)."""
    groups = nan_to_null(df).groupBy(*map(quoted, df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.lit(len(df.columns)).alias("total_cols"),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_rows"),
    )


def date_profile(df: DataFrame, date: str) -> DataFrame:
    """First and last date, number of distinct dates, span in days with both ends."""
    return (
        df.where(F.col(date).isNotNull())
        .groupBy(F.col(date).alias("_d"))
        .agg(F.lit(1))
        .agg(
            F.min(F.col("_d").cast("date")).alias("min_date"),
            F.max(F.col("_d").cast("date")).alias("max_date"),
            F.count("_d").alias("unique_dates"),
        )
        .withColumn("span_days", F.datediff("max_date", "min_date") + 1)
    )


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing cells per column, most incomplete first."""
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    return (
        column_counts(df)
        .select(
            "Column",
            types[F.col("Column")].alias("Type"),
            F.col("Missing").alias("Missing_Count"),
            round_to(F.col("Missing") / F.greatest(F.col("Rows"), F.lit(1)) * 100, 2).alias("Missing_Pct"),
            "Unique_Values",
        )
        .orderBy(F.desc("Missing_Pct"), "Column")
    )


def unpivot_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("Column"), quoted(c).cast("double").alias("x")) for c in columns])
    long = df.select(*map(quoted, columns)).select(F.inline(pairs))
    return nan_to_null(long).where(F.col("x").isNotNull())


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, spread, quartile range and out-of-range share per numeric column with more than four values."""
    long = unpivot_numbers(df, columns or numeric_columns(df))
    stats = agg_with_quantiles(
        long,
        ["Column"],
        [
            F.count("x").alias("n"),
            F.avg("x").alias("mean"),
            F.stddev_samp("x").alias("std"),
            F.min("x").alias("min"),
            F.max("x").alias("max"),
        ],
        {"q1": ("x", 0.25), "median": ("x", 0.5), "q3": ("x", 0.75)},
    ).where(F.col("n") > 4)
    iqr = F.col("q3") - F.col("q1")
    bounds = stats.select("Column", (F.col("q1") - 1.5 * iqr).alias("low"), (F.col("q3") + 1.5 * iqr).alias("high"))
    # At most one row per column of the table, hence the broadcast.
    outside = (
        long.join(F.broadcast(bounds), "Column")
        .groupBy("Column")
        .agg(F.count_if((F.col("x") < F.col("low")) | (F.col("x") > F.col("high"))).alias("outliers"))
    )
    return stats.join(F.broadcast(outside), "Column").select(
        "Column",
        round_to("mean", 2).alias("Mean"),
        round_to("std", 2).alias("Std"),
        round_to("min", 2).alias("Min"),
        round_to("median", 2).alias("Median"),
        round_to("max", 2).alias("Max"),
        round_to(iqr, 2).alias("IQR"),
        F.col("outliers").alias("Potential_Outliers"),
        round_to(F.col("outliers") / F.col("n") * 100, 2).alias("Outlier_Pct"),
    )


def category_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column: distinct values without null, most frequent value (smallest on ties), its count."""
    return (
        value_counts(df, columns)
        .where(F.col("Value").isNotNull())
        .groupBy("Column")
        .agg(F.count(F.lit(1)).alias("Unique_Classes"), F.min(F.struct((-F.col("n")).alias("neg"), "Value")).alias("top"))
        .select(
            "Column",
            "Unique_Classes",
            F.col("top.Value").alias("Top_Value"),
            (-F.col("top.neg")).alias("Top_Frequency"),
        )
    )


def categorical_profile(df: DataFrame, date: str | None = None) -> DataFrame:
    return category_modes(df, [c for c in string_columns(df) if c != date])


# --- integrity checks ----------------------------------------------------------------------------




def distinct_per_group(df: DataFrame, by: Sequence[str], column: str, name: str = "unique_counts") -> DataFrame:
    """Distinct non-null values of ``column`` per group.

    The pairs are reduced first, so a hot group arrives as its distinct values only.
    """
    pairs = df.groupBy(*by, column).agg(F.lit(1))
    return pairs.groupBy(*by).agg(F.count(column).alias(name))


def incomplete_entities(df: DataFrame, entity: str, date: str, expected: int | None = None) -> DataFrame:
    """Entities whose number of dates differs from the expected one (default: dates in the whole table)."""
    per = distinct_per_group(df, [entity], date)
    if expected is not None:
        return per.where(F.col("unique_counts") != expected)
    total = df.select(date).distinct().agg(F.count(date).alias("_total"))
    return per.crossJoin(F.broadcast(total)).where(F.col("unique_counts") != F.col("_total")).drop("_total")


def varying_attribute(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Groups in which a column that should be constant is not."""
    return distinct_per_group(df, by, column).where(F.col("unique_counts") != 1)


def mixed_within(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Groups in which a column takes more than one value."""
    return distinct_per_group(df, by, column).where(F.col("unique_counts") > 1)
