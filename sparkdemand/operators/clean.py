"""Cleaning: trim, de-duplicate, parse, treat negatives and outliers, fill gaps, audit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdemand.functions.columns import nan_to_null, number, numeric_columns, parse_date, quoted, string_columns
from sparkdemand.operators.order import agg_with_quantiles, with_chunks
from sparkdemand.operators.profile import category_modes
from sparkdemand.session import keep

CLIP, DROP = "Clip to Zero", "Drop"
KEEP, CAP, REMOVE = "Keep", "Cap", "Remove"


@dataclass(frozen=True)
class CleanOptions:
    date: str = "Date"
    sales: str = "Sales"
    order: str | None = "Order"
    store: str | None = None
    product: str | None = None
    negative_handling: str = CLIP
    outlier_treatment: str = KEEP
    impute_missing: bool = True
    date_format: str | None = None
    tie: tuple[str, ...] | None = None  # order of rows that share entity and date; default: a row hash

    def entity(self, df: DataFrame) -> list[str]:
        return [c for c in (self.store, self.product) if c and c in df.columns]

    def order_in(self, df: DataFrame) -> str | None:
        return self.order if self.order and self.order in df.columns else None


@dataclass(frozen=True)
class CleanResult:
    """Cleaned table and its before/after audit, both lazy."""

    data: DataFrame
    audit: DataFrame
    cached: tuple[DataFrame, ...] = ()

    def close(self) -> None:
        for df in self.cached:
            df.unpersist()


# --- row rewriting ------------------------------------------------------------------------------


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim every text column; missing text stays missing."""
    return df.withColumns({c: F.trim(quoted(c)) for c in string_columns(df)})


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def to_number(df: DataFrame, column: str) -> Column:
    """Double or null; text that is no number and NaN both become null."""
    x = number(quoted(column), df.schema[column].dataType)
    return F.when(~F.isnan(x), x)


def parse_and_require_date(df: DataFrame, date: str, fmt: str | None = None) -> DataFrame:
    """Parse the date column; rows without a valid date go."""
    if not isinstance(df.schema[date].dataType, (T.TimestampType, T.TimestampNTZType)):
        df = df.withColumn(date, parse_date(quoted(date), df.schema[date].dataType, fmt))
    return df.where(quoted(date).isNotNull())


def require_target(df: DataFrame, sales: str) -> DataFrame:
    """Coerce the target to double; rows without a number go."""
    return df.withColumn(sales, to_number(df, sales)).where(quoted(sales).isNotNull())


def treat_negatives(df: DataFrame, column: str, how: str, keep_null: bool = False) -> DataFrame:
    """Clip below zero, or drop negative rows (with ``keep_null`` a missing value is no reason to drop)."""
    x = quoted(column)
    if how == DROP:
        return df.where((x >= 0) | x.isNull()) if keep_null else df.where(x >= 0)
    return df.withColumn(column, F.when(x < 0, F.lit(0.0)).otherwise(x))


# --- outlier thresholds -------------------------------------------------------------------------


def iqr_thresholds(df: DataFrame, column: str) -> DataFrame:
    """One row: n, quartiles, and the 1.5x / 3x range bounds (lower bounds never below zero)."""
    stats = agg_with_quantiles(
        df, [], [F.count(quoted(column)).alias("n")], {"q1": (column, 0.25), "median": (column, 0.5), "q3": (column, 0.75)}
    )
    iqr = F.col("q3") - F.col("q1")
    return stats.select(
        "n",
        "q1",
        "median",
        "q3",
        iqr.alias("iqr"),
        F.greatest(F.lit(0.0), F.col("q1") - 1.5 * iqr).alias("lower_bound"),
        (F.col("q3") + 1.5 * iqr).alias("upper_bound"),
        F.greatest(F.lit(0.0), F.col("q1") - 3.0 * iqr).alias("extreme_lower"),
        (F.col("q3") + 3.0 * iqr).alias("extreme_upper"),
    )


def treat_outliers(df: DataFrame, column: str, how: str) -> DataFrame:
    """Cap to the 1.5x range, remove beyond the 3x range, or keep.  Tables of up to four rows are kept."""
    if how not in (CAP, REMOVE):
        return df
    names = ["n", "lower_bound", "upper_bound", "extreme_lower", "extreme_upper"]
    bounds = iqr_thresholds(df, column).select(*[F.col(c).alias(f"_{c}") for c in names])
    work = df.crossJoin(F.broadcast(bounds))
    x = quoted(column)
    if how == CAP:
        capped = F.greatest(F.least(x, F.col("_upper_bound")), F.col("_lower_bound"))
        out = work.withColumn(column, F.when(F.col("_n") > 4, capped).otherwise(x))
    else:
        out = work.where((F.col("_n") <= 4) | x.between(F.col("_extreme_lower"), F.col("_extreme_upper")))
    return out.select(*map(quoted, df.columns))


# --- imputation ---------------------------------------------------------------------------------


def columns_with_gaps(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Which of the columns hold a missing value (one scan of those columns, one result row)."""
    if not columns:
        return []
    plain = nan_to_null(df.select(*map(quoted, columns)))
    row = plain.agg(*[F.max(quoted(c).isNull().cast("int")).alias(f"g{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"g{i}"]]


def _running(keys: Sequence[str], order: Sequence[Column], last: int = 0):
    """Windows from the start of a group up to a row, and from its end back down to the row.

    The second runs over the reversed order: a frame that reaches to the end of the group would be
    recomputed for every row, one that starts at the beginning only grows.
    """
    group = Window.partitionBy(*map(quoted, keys))
    return (
        group.orderBy(*order).rowsBetween(Window.unboundedPreceding, last),
        group.orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, last),
    )


def fill_along_time(
    df: DataFrame, columns: Sequence[str], entity: Sequence[str], date: str, tie: Sequence[str] | None = None
) -> DataFrame:
    """Forward then backward fill inside each entity, ordered by date and tie-break.

    An entity may hold a large share of all rows, so it is never ordered in one task: rows are dealt into ranges of
    (entity, date, tie-break) and filled inside their range; the last and first value of every segment (entity and range)
    are carried on in a table with one row per segment, which for one entity has as many rows as there are ranges.
    Rows without an entity key or a date are not filled and fill nothing.
    """
    work, _, rest = with_chunks(df, [*entity, date], tie)
    chunk, order = [*entity, "_piece"], list(dict.fromkeys([date, *rest]))
    forward, backward = _running(chunk, [quoted(c) for c in order])
    dated = quoted(date).isNotNull()
    ends = []
    for i, c in enumerate(columns):
        seen = F.when(dated & quoted(c).isNotNull(), F.struct(*map(quoted, order), quoted(c).alias("_x")))
        ends += [F.max(seen)["_x"].alias(f"_last_{i}"), F.min(seen)["_x"].alias(f"_first_{i}")]
    per_chunk = work.groupBy(*map(quoted, chunk)).agg(*ends)
    past, ahead = _running(entity, [F.col("_piece")], -1)
    carried = per_chunk.select(
        *[quoted(c).alias(f"_k_{i}") for i, c in enumerate(chunk)],
        *[F.last(f"_last_{i}", ignorenulls=True).over(past).alias(f"_past_{i}") for i in range(len(columns))],
        *[F.last(f"_first_{i}", ignorenulls=True).over(ahead).alias(f"_ahead_{i}") for i in range(len(columns))],
    )
    on = [quoted(c) == F.col(f"_k_{i}") for i, c in enumerate(chunk)]  # null entity keys find no partner
    joined = work.join(carried, on, "left")
    filled = {}
    for i, c in enumerate(columns):
        known = F.when(dated, quoted(c))
        around = [
            F.last(known, ignorenulls=True).over(forward),
            F.col(f"_past_{i}"),
            F.last(known, ignorenulls=True).over(backward),
            F.col(f"_ahead_{i}"),
        ]
        filled[c] = F.coalesce(quoted(c), F.when(dated & F.col("_k_0").isNotNull(), F.coalesce(*around)))
    return joined.withColumns(filled).select(*map(quoted, df.columns))


def gaps_along_time(df: DataFrame, columns: Sequence[str], entity: Sequence[str], date: str) -> list[str]:
    """Which of the columns :func:`fill_along_time` leaves with a missing value, without filling them: a value is missing after it
    where the row has no entity or date, or where no dated row of its entity has one.  One row per entity, one result row."""
    dated, keyed = quoted(date).isNotNull(), F.lit(True)
    for c in entity:
        keyed = keyed & quoted(c).isNotNull()
    seen, gaps = [], []
    for i, c in enumerate(columns):
        seen.append(F.count_if(dated & quoted(c).isNotNull()).alias(f"_n_{i}"))
        seen.append(F.count_if(dated & quoted(c).isNull()).alias(f"_g_{i}"))
        seen.append(F.count_if(~dated & quoted(c).isNull()).alias(f"_u_{i}"))
        gaps.append(F.count_if((F.col(f"_u_{i}") > 0) | ((F.col(f"_g_{i}") > 0) & (~F.col("_keyed") | (F.col(f"_n_{i}") == 0)))).alias(f"g{i}"))
    row = df.groupBy(*map(quoted, entity)).agg(*seen, F.first(keyed).alias("_keyed")).agg(*gaps).first()
    return [c for i, c in enumerate(columns) if row[f"g{i}"]]


def impute_numeric(
    df: DataFrame, columns: Sequence[str], entity: Sequence[str], date: str | None, tie: Sequence[str] | None = None
) -> DataFrame:
    """Fill along time per entity, then with the median of the filled column, then with zero.

    Medians are taken of columns that still have gaps only; each costs another pass over the filled rows.
    """
    if not columns:
        return df
    if entity and date:
        left = gaps_along_time(df, columns, entity, date)
        df, columns = fill_along_time(df, columns, entity, date, tie), left
    if not columns:
        return df
    medians = agg_with_quantiles(df, [], [], {f"_m_{i}": (c, 0.5) for i, c in enumerate(columns)})
    out = df.crossJoin(F.broadcast(medians))
    fills = {
        c: F.coalesce(quoted(c), F.col(f"_m_{i}").cast(df.schema[c].dataType), F.lit(0).cast(df.schema[c].dataType))
        for i, c in enumerate(columns)
    }
    return out.withColumns(fills).select(*map(quoted, df.columns))


def impute_categories(df: DataFrame, columns: Sequence[str], counted: DataFrame | None = None) -> DataFrame:
    """Fill missing text with the most frequent value, or "Unknown" where the column is empty.

    ``counted`` is a frame with the same texts that is cheaper to read than ``df``.
    """
    if not columns:
        return df
    modes = category_modes(df if counted is None else counted, columns)
    row = modes.agg(*[F.max(F.when(F.col("Column") == c, F.col("Top_Value"))).alias(f"_t_{i}") for i, c in enumerate(columns)])
    out = df.crossJoin(F.broadcast(row))
    fills = {c: F.coalesce(quoted(c), F.col(f"_t_{i}"), F.lit("Unknown")) for i, c in enumerate(columns)}
    return out.withColumns(fills).select(*map(quoted, df.columns))


# --- the whole cleaner --------------------------------------------------------------------------


def _typed_rows(df: DataFrame, o: CleanOptions) -> DataFrame:
    """Trimmed, distinct rows with a valid date and target and treated negatives."""
    out = drop_exact_duplicates(trim_strings(nan_to_null(df)))
    if o.date in out.columns:
        out = parse_and_require_date(out, o.date, o.date_format)
    if o.sales in out.columns:
        out = treat_negatives(require_target(out, o.sales), o.sales, o.negative_handling)
    order = o.order_in(df)
    if order:
        out = out.withColumn(order, to_number(out, order))
        out = treat_negatives(out, order, o.negative_handling, keep_null=True)
    return out


def _missing_in_row(columns: Sequence[str]) -> Column:
    return sum((quoted(c).isNull().cast("long") for c in columns), F.lit(0).cast("long"))


def _missing_cells(df: DataFrame) -> Column:
    return F.coalesce(F.sum(_missing_in_row(df.columns)), F.lit(0))


def clean_audit(raw: DataFrame, typed: DataFrame, final: DataFrame, sales: str, treatment: str) -> DataFrame:
    """Six rows of counts before and after.  "Duplicate Rows" counts the input as it came, the row after it
    the input once text is trimmed (which is what the cleaner removes)."""
    # Rows before cleaning are read once: both counts of copies and the missing cells come from the distinct rows.
    kinds = nan_to_null(raw).groupBy(*map(quoted, raw.columns)).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.sum("_n"), F.lit(0))
    missing = F.coalesce(F.sum(F.col("_n") * _missing_in_row(raw.columns)), F.lit(0))
    before = kinds.agg(n.alias("rows_b"), missing.alias("miss_b"), (n - F.count(F.lit(1))).alias("dup_raw"))
    trimmed = trim_strings(kinds).groupBy(*map(quoted, raw.columns)).agg(F.sum("_n").alias("_n"))
    dup_trim = trimmed.agg((n - F.count(F.lit(1))).alias("dup_trim"))
    after = final.agg(F.count(F.lit(1)).alias("rows_a"), _missing_cells(final).alias("miss_a"))
    if sales in typed.columns:
        bounds = iqr_thresholds(typed, sales)
        x = F.col("_x")
        seen = typed.select(quoted(sales).alias("_x")).crossJoin(F.broadcast(bounds))
        outside = F.count_if((F.col("n") > 4) & ((x < F.col("lower_bound")) | (x > F.col("upper_bound"))))
        extreme = F.count_if((F.col("n") > 4) & ((x < F.col("extreme_lower")) | (x > F.col("extreme_upper"))))
        changed = outside if treatment == CAP else extreme if treatment == REMOVE else F.lit(0)
        outliers = seen.agg(outside.alias("out_b"), changed.alias("out_m"))
    else:
        outliers = raw.sparkSession.range(1).select(F.lit(0).alias("out_b"), F.lit(0).alias("out_m"))
    row = before
    for part in (dup_trim, after, outliers):
        row = row.crossJoin(F.broadcast(part))

    def line(pos: int, metric: str, b: Column, a: Column, change: Column) -> Column:
        return F.struct(
            F.lit(pos).alias("pos"),
            F.lit(metric).alias("Metric"),
            b.cast("long").alias("Before_Cleaning"),
            a.cast("long").alias("After_Cleaning"),
            change.cast("long").alias("Change"),
        )

    c = F.col
    lines = [
        line(1, "Total Rows", c("rows_b"), c("rows_a"), c("rows_a") - c("rows_b")),
        line(2, "Duplicate Rows", c("dup_raw"), F.lit(0), -c("dup_raw")),
        line(3, "Duplicate Rows (trimmed)", c("dup_trim"), F.lit(0), -c("dup_trim")),
        line(4, "Missing Cells", c("miss_b"), c("miss_a"), c("miss_a") - c("miss_b")),
        line(5, "Total Columns", F.lit(len(raw.columns)), F.lit(len(final.columns)), F.lit(len(final.columns) - len(raw.columns))),
        line(6, "Potential Outliers", c("out_b"), c("out_b") - c("out_m"), -c("out_m")),
    ]
    return row.select(F.inline(F.array(*lines)))


def clean_dataset(df: DataFrame, options: CleanOptions | None = None, checkpoint: bool = True) -> CleanResult:
    """Apply the whole cleaner.

    The typed rows are read by several later passes (thresholds, fills, medians, audit), so they are kept:
    written to the session's checkpoint folder, or cached when the caller turns ``checkpoint`` off.
    """
    o = options or CleanOptions()
    typed, cached = keep(_typed_rows(df, o), not checkpoint)
    out = treat_outliers(typed, o.sales, o.outlier_treatment) if o.sales in typed.columns else typed
    if o.impute_missing:
        numeric = [c for c in numeric_columns(out) if c != o.sales]
        text = [c for c in string_columns(out) if c != o.date]
        gaps = columns_with_gaps(typed, [*numeric, *text])
        treated = out  # filling numbers keeps its rows and texts
        out = impute_numeric(
            out, [c for c in numeric if c in gaps], o.entity(out), o.date if o.date in out.columns else None, o.tie
        )
        out = impute_categories(out, [c for c in text if c in gaps], treated)
    return CleanResult(out, clean_audit(df, typed, out, o.sales, o.outlier_treatment), cached)
