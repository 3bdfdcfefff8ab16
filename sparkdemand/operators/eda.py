"""Trend, ranges, seasonality, rankings, associations and uplift of a sales table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdemand.functions.columns import (
    ANALYSIS_DISCOUNT_WORDS,
    ANALYSIS_HOLIDAY_WORDS,
    EPS,
    is_truthy,
    quoted,
    ratio_pct,
    round_to,
)
from sparkdemand.operators.clean import to_number
from sparkdemand.operators.order import agg_with_quantiles, with_row_index
from sparkdemand.operators.ranges import is_long, sliding, with_mid_ranks, with_positions

# Rolling windows and labels per frequency; months and fallback rows per range option.
ROLLING = {"Weekly": (4, 12, "4-Week", "12-Week"), "Monthly": (3, 6, "3-Month", "6-Month")}
ROLLING_DEFAULT = (7, 30, "7-Day", "30-Day")
RANGE_OPTIONS = {"1M": (1, 5), "3M": (3, 15), "6M": (6, 30)}
PERIODS = (("LAST 1 MONTH", 1), ("LAST 3 MONTHS", 3), ("LAST 6 MONTHS", 6), ("OVERALL", None))


def _all_rows():
    """Frame over a whole aggregated table (a series by date or a handful of groups)."""
    return Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _by_date(*order: str):
    """Window over an aggregated series.  Such a series has one row per date, which bounds its size."""
    return Window.partitionBy(F.lit(0)).orderBy(*order)


# --- series by date -----------------------------------------------------------------------------


def series_by_date(df: DataFrame, date: str = "Date", sales: str = "Sales") -> DataFrame:
    """Sum, mean, median and count of sales per date."""
    return agg_with_quantiles(
        df.where(F.col(date).isNotNull()),
        [date],
        [F.sum(sales).alias("Total_Sales"), F.avg(sales).alias("Average_Sales"), F.count(sales).alias("Record_Count")],
        {"Median_Sales": (sales, 0.5)},
    )


def with_rolling_means(series: DataFrame, date: str = "Date", total: str = "Total_Sales", frequency: str = "Daily") -> DataFrame:
    """Fast and slow rolling mean including the current row; shorter windows when the series is short.

    A series by date is one window; by time stamps it is cut into ranges, each with the rows before it that it needs.
    """
    fast, slow, fast_label, slow_label = next(
        (v for k, v in ROLLING.items() if k.lower() in frequency.strip().lower()), ROLLING_DEFAULT
    )
    n = F.col("_n")
    short_fast = F.when(n >= 4, F.greatest(F.lit(2), F.least(F.lit(3), F.floor(n / 4)))).otherwise(1)
    short_slow = F.when(n >= 4, F.greatest(short_fast + 1, F.least(F.lit(7), F.floor(n / 2)))).otherwise(2)

    def columns(w) -> dict[str, Column]:
        def mean_of(width: int) -> Column:
            return F.avg(total).over(w.rowsBetween(-(width - 1), 0))

        def choose(width: int, short: Column, options: Iterable[int]) -> Column:
            out = F.when(n >= slow, mean_of(width))
            for k in options:
                out = out.when(short == k, mean_of(k))
            return out

        return {
            "Rolling_Mean_Fast": choose(fast, short_fast, range(1, 4)),
            "Rolling_Mean_Slow": choose(slow, short_slow, range(2, 8)),
            "Rolling_Fast_Label": F.lit(fast_label),
            "Rolling_Slow_Label": F.lit(slow_label),
        }

    if is_long(series, date):
        counted = series.crossJoin(F.broadcast(series.agg(F.count(F.lit(1)).alias("_n"))))
        return sliding(counted, [], [date], max(slow, 7) - 1, columns).drop("_n")
    return series.withColumn("_n", F.count(F.lit(1)).over(_all_rows())).withColumns(columns(_by_date(date))).drop("_n")


def with_trend(series: DataFrame, date: str = "Date", total: str = "Total_Sales") -> DataFrame:
    """Least-squares line of the total over the position 0..n-1 (null for up to two rows)."""
    count = F.count(F.lit(1))
    if is_long(series, date):
        placed = with_positions(series, [], [date], "_i").withColumn("_i", F.col("_i").cast("double"))
        fit = placed.agg(F.regr_slope(total, "_i").alias("_a"), F.regr_intercept(total, "_i").alias("_b"), count.alias("_n"))
        line = F.when(F.col("_n") > 2, F.col("_b") + F.col("_a") * F.col("_i"))
        return placed.crossJoin(F.broadcast(fit)).withColumn("Trend_Line", line).select(*map(quoted, series.columns), "Trend_Line")
    placed = series.withColumn("_i", (F.row_number().over(_by_date(date)) - 1).cast("double"))
    slope, intercept = (f(total, "_i").over(_all_rows()) for f in (F.regr_slope, F.regr_intercept))
    line = F.when(count.over(_all_rows()) > 2, intercept + slope * F.col("_i"))
    return placed.withColumn("Trend_Line", line).drop("_i")


def time_series(df: DataFrame, date: str = "Date", sales: str = "Sales", frequency: str = "Daily") -> DataFrame:
    """Series by date with rolling means and trend line."""
    return with_trend(with_rolling_means(series_by_date(df, date, sales), date, "Total_Sales", frequency), date)


def peak_and_low(series: DataFrame, date: str = "Date", total: str = "Total_Sales") -> DataFrame:
    """Highest and lowest total with their dates; the earliest date wins a tie."""
    back = (-F.unix_date(F.col(date).cast("date"))).alias("back")
    top = F.max(F.struct(F.col(total).alias("v"), back, F.col(date).alias("d")))
    low = F.min(F.struct(F.col(total).alias("v"), F.col(date).alias("d")))
    return series.where(F.col(total).isNotNull()).agg(top.alias("t"), low.alias("l")).select(
        F.col("t.d").alias("peak_date"), F.col("t.v").alias("peak_value"), F.col("l.d").alias("low_date"), F.col("l.v").alias("low_value")
    )


# --- ranges and KPIs ----------------------------------------------------------------------------


def _range_key(option: str) -> str | None:
    text = option.strip().upper()
    return next((k for k in RANGE_OPTIONS if text == k or f"{k[0]} MONTH" in text), None)


def filter_by_range(df: DataFrame, date: str = "Date", option: str = "OVERALL") -> DataFrame:
    """Rows of the last 1, 3 or 6 months before the newest date in the data.

    The newest date is read first (one value), so the filter carries a literal that reaches the scan and
    skips files.  When fewer than two rows remain, the last few rows are taken instead.
    """
    key = _range_key(option)
    if key is None:
        return df
    months, fallback = RANGE_OPTIONS[key]
    cutoff = df.agg(F.add_months(F.max(date), -months)).first()[0]
    recent = df.where(F.col(date) >= F.lit(cutoff))
    if len(recent.select(date).take(2)) >= 2:
        return recent
    return df.orderBy(F.desc(date)).limit(fallback)


def summary_kpis(df: DataFrame, sales: str = "Sales", date: str = "Date", frequency: str = "Daily") -> DataFrame:
    """One row of totals over the whole history."""
    work = df.select(to_number(df, sales).alias("x"), F.col(date).alias("d"))
    stats = agg_with_quantiles(
        work,
        [],
        [
            F.coalesce(F.sum("x"), F.lit(0.0)).alias("total_sales"),
            F.avg("x").alias("avg_sales"),
            F.coalesce(F.min("x"), F.lit(0.0)).alias("min_sales"),
            F.coalesce(F.max("x"), F.lit(0.0)).alias("max_sales"),
            F.count("x").alias("observations"),
            F.min("d").cast("date").alias("first_date"),
            F.max("d").cast("date").alias("last_date"),
        ],
        {"median_sales": ("x", 0.5)},
    )
    return stats.withColumn("frequency", F.lit(frequency))


def period_summaries(df: DataFrame, sales: str = "Sales", date: str = "Date") -> DataFrame:
    """Totals of the last 1, 3, 6 months and overall.  The newest row always lies inside every period."""
    work = df.select(to_number(df, sales).alias("x"), F.col(date).alias("d")).where("x is not null and d is not null")
    newest = work.agg(F.max("d").alias("newest"))
    inside = [
        F.when(F.lit(True) if m is None else F.col("d") >= F.add_months("newest", -m), F.struct(F.lit(i).alias("pos"), F.lit(name).alias("Period")))
        for i, (name, m) in enumerate(PERIODS)
    ]
    rows = (
        work.crossJoin(F.broadcast(newest))
        .select("x", "d", F.explode(F.filter(F.array(*inside), lambda s: s.isNotNull())).alias("p"))
        .select("x", "d", "p.*")
    )
    return agg_with_quantiles(
        rows,
        ["pos", "Period"],
        [
            F.sum("x").alias("Total_Sales"),
            F.avg("x").alias("Average_Sales"),
            F.count("x").alias("Observations"),
            F.min("d").cast("date").alias("Start_Date"),
            F.max("d").cast("date").alias("End_Date"),
        ],
        {"Median_Sales": ("x", 0.5)},
    )


def recent_month_sales(df: DataFrame, sales: str = "Sales", date: str = "Date", tie: Sequence[str] | None = None) -> DataFrame:
    """Sales since one month before the newest date; if that is zero, sales of the last tenth of the rows."""
    newest = df.agg(F.max(date).alias("_newest"))
    recent = df.crossJoin(F.broadcast(newest)).agg(
        F.coalesce(F.sum(F.when(F.col(date) >= F.add_months("_newest", -1), F.col(sales))), F.lit(0.0)).alias("recent_sales"),
        F.count(F.lit(1)).alias("n"),
    )
    row = recent.first()
    if row["recent_sales"] == 0 and row["n"] > 0:
        first = row["n"] - max(1, row["n"] // 10)
        placed = with_row_index(df.select(*df.columns), date, tie, "_pos")
        return placed.where(F.col("_pos") >= first).agg(F.sum(sales).alias("recent_sales"))
    return recent.select("recent_sales")


def search_rows(df: DataFrame, pattern: str, limit: int | None = 50, order: Sequence[str] = ()) -> DataFrame:
    """Rows in which any column, read as text, matches the pattern regardless of case."""
    hit = F.lit(False)
    for c in df.columns:
        hit = hit | F.coalesce(F.rlike(quoted(c).cast("string"), F.lit(f"(?i){pattern}")), F.lit(False))
    out = df.where(hit) if pattern else df
    out = out.orderBy(*order) if order and limit is not None else out
    return out if limit is None else out.limit(limit)


# --- seasonality --------------------------------------------------------------------------------


def _season(df: DataFrame, label: Column, rank: Column, name: str, sales: str) -> DataFrame:
    work = df.select(label.alias(name), rank.alias("pos"), quoted(sales).alias("x")).where(F.col(name).isNotNull())
    return agg_with_quantiles(
        work,
        ["pos", name],
        [F.avg("x").alias("Mean_Sales"), F.sum("x").alias("Total_Sales"), F.count("x").alias("Record_Count")],
        {"Median_Sales": ("x", 0.5)},
    )


def by_weekday(df: DataFrame, date: str = "Date", sales: str = "Sales") -> DataFrame:
    """Monday first; meaningful for daily and irregular data only."""
    return _season(df, F.date_format(date, "EEEE"), F.weekday(date), "Day_of_Week", sales)


def by_month(df: DataFrame, date: str = "Date", sales: str = "Sales") -> DataFrame:
    return _season(df, F.date_format(date, "MMMM"), F.month(date), "Month_Name", sales)


def by_quarter(df: DataFrame, date: str = "Date", sales: str = "Sales") -> DataFrame:
    q = _season(df, F.concat(F.lit("Q"), F.quarter(date)), F.quarter(date), "Quarter", sales)
    return q.withColumn("Share_Pct", F.col("Total_Sales") / F.sum("Total_Sales").over(_all_rows()) * 100.0)


def seasonality(df: DataFrame, date: str = "Date", sales: str = "Sales", frequency: str = "Daily") -> dict[str, DataFrame]:
    out = {"month": by_month(df, date, sales), "quarter": by_quarter(df, date, sales)}
    if frequency in ("Daily", "Irregular"):
        out["dow"] = by_weekday(df, date, sales)
    return out


# --- entities -----------------------------------------------------------------------------------


def entity_totals(df: DataFrame, entity: str, sales: str = "Sales") -> DataFrame:
    """Sum, mean, median, count and share of the whole per entity."""
    known = df.where(quoted(entity).isNotNull())
    per = agg_with_quantiles(
        known,
        [entity],
        [F.sum(sales).alias("Total_Sales"), F.avg(sales).alias("Mean_Sales"), F.count(sales).alias("Records")],
        {"Median_Sales": (sales, 0.5)},
    )
    whole = known.agg(F.sum(sales).alias("_whole"))
    share = F.col("Total_Sales") / F.greatest(F.col("_whole"), F.lit(EPS)) * 100.0
    return per.crossJoin(F.broadcast(whole)).withColumn("Sales_Share_Pct", share).drop("_whole")


def top_entities(df: DataFrame, entity: str, sales: str = "Sales", top_n: int = 10) -> DataFrame:
    return entity_totals(df, entity, sales).orderBy(F.desc("Total_Sales"), entity).limit(top_n)


def bottom_entities(df: DataFrame, entity: str, sales: str = "Sales", top_n: int = 10) -> DataFrame:
    return entity_totals(df, entity, sales).orderBy(F.asc("Total_Sales"), entity).limit(top_n)


def entity_overview(df: DataFrame, entity: str, sales: str = "Sales") -> DataFrame:
    """Number of entities and their total."""
    per = df.where(quoted(entity).isNotNull()).groupBy(entity).agg(F.sum(sales).alias("s"))
    return per.agg(F.count(F.lit(1)).alias("total_entities"), F.sum("s").alias("total_sales"))


# --- association --------------------------------------------------------------------------------


def valid_pairs(df: DataFrame, sales: str = "Sales", order: str = "Order") -> DataFrame:
    """Rows with both values present and not negative."""
    x, y = to_number(df, sales), to_number(df, order)
    return df.where((x >= 0) & (y >= 0))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation over all rows with both values: ``n, spearman``.

    Equal pairs are merged; ranks are taken inside ranges of (value, other value), so no row moves to the key of its
    value and a hot value spans as many ranges as its share.
    """
    both = df.where(quoted(x).isNotNull() & quoted(y).isNotNull()).select(
        quoted(x).cast("double").alias("x"), quoted(y).cast("double").alias("y")
    )
    pairs = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    ranked = with_mid_ranks(with_mid_ranks(pairs, "x", "y", "w", "rx"), "y", "x", "w", "ry")
    return rank_correlation(ranked, pairs.agg(F.sum("w").alias("n")))


def rank_correlation(ranked: DataFrame, n: DataFrame) -> DataFrame:
    """``n, spearman`` from the ranks ``rx`` and ``ry`` of rows that stand for ``w`` rows each, and the number of all rows."""
    mid = (F.col("n") + 1) / 2.0
    dx, dy, w = F.col("rx") - mid, F.col("ry") - mid, F.col("w")
    return (
        ranked.crossJoin(F.broadcast(n))
        .agg(F.sum("w").alias("n"), F.sum(w * dx * dy).alias("xy"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dy * dy).alias("yy"))
        .select("n", F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("spearman"))
    )


def correlation(df: DataFrame, sales: str = "Sales", order: str = "Order") -> DataFrame:
    """Pearson, Spearman, least-squares line of sales on orders, number of pairs.  Empty below five pairs."""
    pairs = valid_pairs(df, sales, order)
    s, o = quoted(sales).cast("double"), quoted(order).cast("double")
    base = pairs.agg(
        F.corr(s, o).alias("pearson_corr"),
        F.regr_slope(s, o).alias("slope"),
        F.regr_intercept(s, o).alias("intercept"),
        F.count(F.lit(1)).alias("total_paired_records"),
    ).where(F.col("total_paired_records") >= 5)
    ranked = spearman(pairs, sales, order).select(round_to("spearman", 4).alias("spearman_corr"))
    return base.crossJoin(F.broadcast(ranked)).select(
        round_to("pearson_corr", 4).alias("pearson_corr"),
        "spearman_corr",
        round_to("slope", 2).alias("slope"),
        round_to("intercept", 2).alias("intercept"),
        "total_paired_records",
    )


def scatter_sample(df: DataFrame, keys: Sequence[str], sales: str = "Sales", order: str = "Order", n: int = 2000) -> DataFrame:
    """At most ``n`` pairs for a scatter plot, chosen by a hash of the row keys, so the same rows each time."""
    code = F.md5(F.concat_ws("|", *[quoted(k).cast("string") for k in keys]))
    return valid_pairs(df, sales, order).orderBy(code, *keys).limit(n).select(*dict.fromkeys([*keys, sales, order]))


# --- uplift -------------------------------------------------------------------------------------


def uplift_by_flag(df: DataFrame, flag: Column, sales: str = "Sales") -> DataFrame:
    """Mean, median and count of sales with the flag on and off: ``is_on, mean, median, n``."""
    work = df.select(flag.alias("is_on"), quoted(sales).alias("x")).where(F.col("x").isNotNull())
    return agg_with_quantiles(work, ["is_on"], [F.avg("x").alias("mean"), F.count("x").alias("n")], {"median": ("x", 0.5)})


def uplift(df: DataFrame, flag: Column, sales: str, prefix: str, minimum: int = 3) -> DataFrame:
    """One row comparing flagged with other rows; empty when a side has fewer than ``minimum`` rows."""
    sides = uplift_by_flag(df, flag, sales)

    def side(on: bool, c: str) -> Column:
        return F.max(F.when(F.col("is_on") == on, F.col(c)))

    row = sides.agg(
        side(True, "mean").alias("on_mean"),
        side(False, "mean").alias("off_mean"),
        side(True, "median").alias("on_median"),
        side(False, "median").alias("off_median"),
        F.coalesce(side(True, "n"), F.lit(0)).alias("on_n"),
        F.coalesce(side(False, "n"), F.lit(0)).alias("off_n"),
    ).where((F.col("on_n") >= minimum) & (F.col("off_n") >= minimum))
    c = F.col
    return row.select(
        c("on_mean").alias(f"{prefix}_mean"),
        c("off_mean").alias("regular_mean"),
        c("on_median").alias(f"{prefix}_median"),
        c("off_median").alias("regular_median"),
        c("on_n").alias(f"{prefix}_n"),
        c("off_n").alias("regular_n"),
        round_to(ratio_pct(c("on_mean") - c("off_mean"), c("off_mean")), 2).alias("mean_diff_pct"),
        round_to(ratio_pct(c("on_median") - c("off_median"), c("off_median")), 2).alias("median_diff_pct"),
    )


def discount_uplift(df: DataFrame, discount: str, sales: str = "Sales") -> DataFrame:
    return uplift(df, is_truthy(quoted(discount), ANALYSIS_DISCOUNT_WORDS), sales, "promo")


def holiday_uplift(df: DataFrame, holiday: str, sales: str = "Sales") -> DataFrame:
    return uplift(df, is_truthy(quoted(holiday), ANALYSIS_HOLIDAY_WORDS), sales, "holiday")
