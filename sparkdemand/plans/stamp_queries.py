"""Queries on series by time stamps, where one series may be longer than a task should hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdemand.operators import clean, eda, features, forecast, order, split, stats
from sparkdemand.operators.features import FeatureConfig
from sparkdemand.plans import sql as S
from sparkdemand.plans.registry import query, rounded
from sparkdemand.plans.sql import rnd
from sparkdemand.sources import views

_BY_STAMP = S.EVENTS_STAMP + ", by_stamp AS (SELECT Stamp, SUM(Sales) AS Sales FROM events_stamp GROUP BY Stamp)"


def _by_stamp(spark, d):
    return views.events_stamp(spark, d).groupBy("Stamp").agg(F.sum("Sales").alias("Sales"))


def _mean(width: int) -> str:
    return rnd(f"AVG(Sales) OVER (ORDER BY Stamp ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)", 4)


@query(
    "W2_W3_rolling_and_trend_by_stamp",
    f"""WITH {_BY_STAMP}, p AS (SELECT *, row_number() OVER (ORDER BY Stamp) - 1 AS i FROM by_stamp),
        l AS (SELECT regr_slope(Sales, i) AS a, regr_intercept(Sales, i) AS b FROM p)
        SELECT Stamp, {_mean(7)} AS Rolling_Mean_Fast, {_mean(30)} AS Rolling_Mean_Slow, {rnd('b + a * i', 3)} AS Trend_Line FROM p, l""",
)
def _(spark, d):
    out = eda.with_trend(eda.with_rolling_means(_by_stamp(spark, d), "Stamp", "Sales"), "Stamp", "Sales")
    means = rounded(out.select("Stamp", "Rolling_Mean_Fast", "Rolling_Mean_Slow", F.col("Trend_Line").cast("decimal(38,10)").alias("Trend_Line")))
    line = F.col("Trend_Line").cast("double")
    return means.withColumn("Trend_Line", F.round(line + F.signum(line) * 3e-7, 3))


_OVER = "(PARTITION BY Store ORDER BY Stamp"


def _history_sql(c: str, k: int) -> str:
    frame = f"OVER {_OVER} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return ", ".join(
        [
            f"{rnd(f'AVG({c}) {frame}', 4)} AS rolling_{c}_{k}_mean",
            f"{rnd(f'coalesce(stddev_samp({c}) {frame}, 0.0)', 4)} AS rolling_{c}_{k}_std",
            f"MIN({c}) {frame} AS rolling_{c}_{k}_min",
            f"MAX({c}) {frame} AS rolling_{c}_{k}_max",
        ]
    )


_LAGS = ", ".join(f"lag(Sales, {k}) OVER {_OVER}) AS lag_{k}_Sales" for k in (1, 7, 14, 28))
_ROLLING = ", ".join(_history_sql("Sales", k) for k in (7, 14, 30))
_STORE_STAMP = S.EVENTS_STAMP + ", store_stamp AS (SELECT Store, Stamp, SUM(Sales) AS Sales FROM events_stamp GROUP BY Store, Stamp)"


def _store_stamp(spark, d):
    return views.events_stamp(spark, d).groupBy("Store", "Stamp").agg(F.sum("Sales").alias("Sales"))


@query("W4_W5_history_of_one_long_series", f"WITH {_STORE_STAMP} SELECT Store, Stamp, {_LAGS}, {_ROLLING} FROM store_stamp")
def _(spark, d):
    config = FeatureConfig(date="Stamp", order=None, store="Store")
    out = features.transform(_store_stamp(spark, d), config)
    names = [c for c in out.columns if c.startswith(("lag_", "rolling_"))]
    return rounded(out.select("Store", "Stamp", *names))


@query(
    "W6_strict_rolling_of_one_long_series",
    f"""WITH {_STORE_STAMP}, w AS (SELECT Store, Stamp, COUNT(*) OVER {_OVER} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS n,
        AVG(Sales) OVER {_OVER} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS a FROM store_stamp)
        SELECT Store, Stamp, CASE WHEN n = 7 THEN {rnd('a', 4)} END AS rolling_Sales_7 FROM w""",
)
def _(spark, d):
    made = features.with_history(
        _store_stamp(spark, d), ["Store"], "Stamp", 7, lambda w: features.strict_rolling_columns(["Sales"], [7], w)
    )
    return rounded(made.select("Store", "Stamp", "rolling_Sales_7"))


@query(
    "W10_recent_total_by_stamp",
    f"""WITH {_BY_STAMP} SELECT {rnd('SUM(Sales)', 2)} AS recent FROM (SELECT Sales FROM by_stamp ORDER BY Stamp DESC LIMIT 300)""",
)
def _(spark, d):
    steps = spark.range(1).select(F.lit(300).alias("h"))
    return rounded(forecast.recent_total(_by_stamp(spark, d), steps, "Sales", "Stamp"), 2)


@query("W11_positions_by_stamp", f"WITH {S.EVENTS_STAMP} SELECT Event, row_number() OVER (ORDER BY Stamp, Event) - 1 AS row_index FROM events_stamp")
def _(spark, d):
    return order.with_row_index(views.events_stamp(spark, d), "Stamp", ["Event"]).select("Event", "row_index")


@query(
    "M1_split_by_stamp",
    f"""WITH {S.EVENTS_STAMP}, r AS (SELECT Stamp, row_number() OVER (ORDER BY Stamp) - 1 AS i, COUNT(*) OVER () AS n
          FROM (SELECT DISTINCT Stamp FROM events_stamp)),
        c AS (SELECT (SELECT Stamp FROM r WHERE i = CAST(floor(n * 0.70) AS BIGINT)) AS a, (SELECT Stamp FROM r WHERE i = CAST(floor(n * 0.85) AS BIGINT)) AS b)
        SELECT Event, CASE WHEN Stamp < a THEN 'train' WHEN Stamp < b THEN 'val' ELSE 'test' END AS part FROM events_stamp, c""",
)
def _(spark, d):
    s = split.chronological_split(views.events_stamp(spark, d), "Stamp")
    named = [p.select("Event", F.lit(name).alias("part")) for name, p in (("train", s.train), ("val", s.val), ("test", s.test))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def _filled_sql(by: str) -> str:
    order_by = f"({by} ORDER BY Stamp, Event ROWS BETWEEN"
    return f"""coalesce(Units, last_value(Units IGNORE NULLS) OVER {order_by} UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(Units IGNORE NULLS) OVER {order_by} CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("C6_W9_fill_along_stamps", f"WITH {S.EVENTS_STAMP} SELECT Event, {_filled_sql('PARTITION BY Store')} AS Units FROM events_stamp")
def _(spark, d):
    return clean.fill_along_time(views.events_stamp(spark, d), ["Units"], ["Store"], "Stamp", ["Event"]).select("Event", "Units")


@query("C6_W9_fill_one_entity_over_all_stamps", f"WITH {S.EVENTS_STAMP} SELECT Event, {_filled_sql('')} AS Units FROM events_stamp")
def _(spark, d):
    rows = views.events_stamp(spark, d).withColumn("Chain", F.lit("all"))
    return clean.fill_along_time(rows, ["Units"], ["Chain"], "Stamp", ["Event"]).select("Event", "Units")


_HOT = (
    S.EVENTS_STAMP
    + """, hot AS (SELECT CASE WHEN Event % 10 < 7 THEN 0.0 ELSE coalesce(Units, -1.0) END AS x, epoch_us(Stamp)::DOUBLE AS y FROM events_stamp),
    ranked AS (SELECT rank() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
                      rank() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM hot)"""
)


@query("A8_T8_spearman_with_one_hot_value", f"WITH {_HOT} SELECT COUNT(*) AS n, {rnd('corr(rx, ry)', 6)} AS spearman FROM ranked")
def _(spark, d):
    e = views.events_stamp(spark, d)
    x = F.when(F.col("Event") % 10 < 7, 0.0).otherwise(F.coalesce("Units", F.lit(-1.0)))
    return rounded(eda.spearman(e.select(x.alias("x"), F.unix_micros(F.col("Stamp").cast("timestamp")).cast("double").alias("y")), "x", "y"), 6)


@query(
    "T6_kruskal_with_one_hot_value",
    f"""WITH {S.EVENTS_STAMP}, v AS (SELECT Store AS g, CASE WHEN Event % 10 < 7 THEN 5.0 ELSE Sales END AS x FROM events_stamp),
        r AS (SELECT g, x, rank() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS r, COUNT(*) OVER () AS n FROM v),
        per AS (SELECT g, COUNT(*) AS c, AVG(r) AS m, MAX(n)::DOUBLE AS n FROM r GROUP BY g),
        t AS (SELECT SUM(k * k * k - k) AS ties FROM (SELECT COUNT(*)::DOUBLE AS k FROM v GROUP BY x))
        SELECT COUNT(*) AS k, {rnd('SUM(12.0 / (n * (n + 1)) * c * pow(m - (n + 1) / 2, 2)) / MAX(1 - ties / (n * n * n - n))', 4)} AS h FROM per, t""",
)
def _(spark, d):
    e = views.events_stamp(spark, d)
    work = e.select("Store", F.when(F.col("Event") % 10 < 7, 5.0).otherwise(F.col("Sales")).alias("x"))
    return rounded(stats.kruskal(work, "Store", "x").select("k", "h"))
