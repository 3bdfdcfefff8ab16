"""Plain-language takeaways from one aggregated row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdemand.functions.columns import FEATURE_DISCOUNT_WORDS, FEATURE_HOLIDAY_WORDS, is_truthy, quoted
from sparkdemand.operators.clean import to_number


def takeaway_numbers(df: DataFrame, sales: str = "Sales", discount: str | None = None, holiday: str | None = None) -> DataFrame:
    """Totals and conditional means behind the takeaways, from one pass."""
    x = F.col("x")
    cols, aggs = [to_number(df, sales).alias("x")], [F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean")]
    for tag, name, words in (("promo", discount, FEATURE_DISCOUNT_WORDS), ("holiday", holiday, FEATURE_HOLIDAY_WORDS)):
        if name and name in df.columns:
            cols.append(is_truthy(quoted(name), words).alias(tag))
            on, off = F.avg(F.when(F.col(tag), x)), F.avg(F.when(~F.col(tag), x))
        else:
            on = off = F.lit(None).cast("double")
        aggs += [on.alias(f"{tag}_on"), off.alias(f"{tag}_off")]
    row = df.select(*cols).agg(*aggs)
    for tag in ("promo", "holiday"):
        on, off = F.col(f"{tag}_on"), F.col(f"{tag}_off")
        row = row.withColumn(f"{tag}_diff_pct", F.when(off > 0, (on - off) / off * 100.0))
    return row


def business_takeaways(
    df: DataFrame,
    forecast_summary: DataFrame | None = None,
    sales: str = "Sales",
    discount: str | None = None,
    holiday: str | None = None,
) -> DataFrame:
    """Up to four lines: ``category, title, metric, summary``.  Lines without data are left out."""
    row = takeaway_numbers(df, sales, discount, holiday)
    c = F.col
    if forecast_summary is not None:
        row = row.crossJoin(F.broadcast(forecast_summary.select("total_forecast", "trend", "change_vs_recent_pct")))
    else:
        row = row.withColumns(
            {"total_forecast": F.lit(None).cast("double"), "trend": F.lit(""), "change_vs_recent_pct": F.lit(0.0)}
        )

    def money(x: Column, digits: int) -> Column:
        return F.concat(F.lit("$"), F.format_number(x, digits))

    def line(pos: int, keep: Column, category: str, title: Column, metric: Column, summary: Column) -> Column:
        made = F.struct(
            F.lit(pos).alias("pos"), F.lit(category).alias("category"), title.alias("title"), metric.alias("metric"), summary.alias("summary")
        )
        return F.when(keep, made)

    def pair(tag: str, on_name: str, off_name: str) -> Column:
        return F.concat(F.lit(f"{on_name} averaged "), money(c(f"{tag}_on"), 2), F.lit(" vs "), money(c(f"{tag}_off"), 2), F.lit(f" on {off_name}."))

    signed = lambda x: F.format_string("%+.1f%%", x)
    lines = [
        line(1, c("n") > 0, "Historical Baseline", F.lit("Historical Sales Performance"), money(c("total"), 0),
             F.concat(F.lit("Revenue over "), F.format_number(c("n"), 0), F.lit(" records, "), money(c("mean"), 2), F.lit(" on average."))),
        line(2, c("promo_diff_pct").isNotNull(), "Promotions", F.lit("Promotional Uplift Association"), signed(c("promo_diff_pct")),
             pair("promo", "Promotional periods", "regular periods")),
        line(3, c("holiday_diff_pct").isNotNull(), "Seasonality", F.lit("Holiday Demand Multiplier"), signed(c("holiday_diff_pct")),
             pair("holiday", "Holiday periods", "regular periods")),
        line(4, c("total_forecast") > 0, "Forecast Outlook", F.format_string("Forecast Horizon Demand (%s Trend)", c("trend")), money(c("total_forecast"), 0),
             F.concat(F.lit("Projected change of "), signed(c("change_vs_recent_pct")), F.lit(" against the preceding period of equal length."))),
    ]
    return row.select(F.inline(F.filter(F.array(*lines), lambda s: s.isNotNull())))
