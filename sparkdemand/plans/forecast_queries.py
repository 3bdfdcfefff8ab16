"""Forecasts that move from step to step, with the same recursion written in SQL, and categories of any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdemand.operators import features, forecast, models
from sparkdemand.operators.features import FeatureConfig
from sparkdemand.plans import sql as S
from sparkdemand.plans.closed_form_queries import _normal
from sparkdemand.plans.registry import query, rounded
from sparkdemand.plans.sql import rnd, rnd_plain
from sparkdemand.sources import views

WEEKLY = FeatureConfig(order="Units", store="Store", lags=(7,), rolling=(), feature_columns=("lag_7_Sales",))
SCOPE_WEEKLY = FeatureConfig(order="Units", lags=(7,), rolling=(), feature_columns=("lag_7_Sales",))
COUPLED = FeatureConfig(order="Units", lags=(1,), rolling=(), feature_columns=("lag_1_Sales", "lag_1_Units", "pred_orders"))
STEPS = 20


def _weekly_sql(source: str, keys: str, part: str) -> str:
    """The last seven values, repeated: a series by lag 7 of itself."""
    return f"""n AS (SELECT *, row_number() OVER ({part} ORDER BY Date DESC) AS back, MAX(Date) OVER ({part}) AS x FROM {source}),
        fc AS (SELECT {keys} i + 1 AS step, CAST(x + (i + 1) * INTERVAL 1 DAY AS DATE) AS Date, {rnd_plain('Sales', 2)} AS v FROM n, range({STEPS}) r(i) WHERE back = 7 - i % 7)"""


_STORE_WEEKLY = f"{S.STORE_DAY}, {_weekly_sql('store_day', 'Store,', 'PARTITION BY Store')}"
_SCOPE_WEEKLY = f"{S.SCOPE_DAY}, {_weekly_sql('scope_day', '', '')}"


def _by_week(spark, d):
    return forecast.recursive_forecast(views.store_day(spark, d), WEEKLY, models.naive_model("lag_7_Sales"), STEPS)


def _scope_by_week(spark, d):
    series = views.scope_day(spark, d)
    return series, forecast.recursive_forecast(series, SCOPE_WEEKLY, models.naive_model("lag_7_Sales"), STEPS)


@query("H3_weekly_forecast_all_stores", f"WITH {_STORE_WEEKLY} SELECT Store, CAST(step AS INT) AS step, Date, v AS Forecasted_Sales FROM fc")
def _(spark, d):
    return _by_week(spark, d)


@query(
    "H6_checks_of_weekly_forecast",
    f"""WITH {_STORE_WEEKLY} SELECT Store, COUNT(*) AS rows, COUNT(CASE WHEN v IS NULL THEN 1 END) AS invalid, COUNT(CASE WHEN v < 0 THEN 1 END) AS negative,
        COUNT(*) = {STEPS} AND COUNT(v) = {STEPS} AND MIN(v) >= 0 AS ok FROM fc GROUP BY Store""",
)
def _(spark, d):
    return forecast.forecast_checks(_by_week(spark, d), STEPS, ["Store"])


@query(
    "H7_summary_of_weekly_forecast",
    f"""WITH {_SCOPE_WEEKLY}, r AS (SELECT SUM(Sales) AS recent FROM n WHERE back <= {STEPS}),
        t AS (SELECT SUM(v) AS total, AVG(v) AS mean, arg_max(Date, struct_pack(a := v, b := -step)) AS peak, MAX(v) AS hi, arg_min(Date, struct_pack(a := v, b := step)) AS low, MIN(v) AS lo FROM fc),
        c AS (SELECT *, (total - recent) / recent * 100 AS change FROM t, r)
        SELECT {rnd('total', 2)} AS total_forecast, {rnd('mean', 2)} AS avg_forecast, peak AS peak_period, {rnd('hi', 2)} AS peak_val, low AS low_period, {rnd('lo', 2)} AS low_val,
               CASE WHEN change >= 2 THEN 'Increasing' WHEN change <= -2 THEN 'Decreasing' ELSE 'Stable' END AS trend, {rnd('change', 2)} AS change_vs_recent_pct,
               {rnd('recent', 2)} AS recent_actual_total FROM c""",
)
def _(spark, d):
    series, ahead = _scope_by_week(spark, d)
    return rounded(forecast.forecast_summary(ahead, series), 2)


@query(
    "U2_curve_of_weekly_forecast",
    f"""WITH {_SCOPE_WEEKLY} SELECT Date, {rnd('Sales', 2)} AS value, 'actual' AS kind FROM scope_day
        UNION ALL SELECT Date, {rnd('Sales', 2)}, 'forecast' FROM n WHERE back = 1 UNION ALL SELECT Date, v, 'forecast' FROM fc""",
)
def _(spark, d):
    return rounded(forecast.stitched_curve(*_scope_by_week(spark, d)), 2)


@query(
    "H8_first_step_of_weekly_forecast",
    f"""WITH {_SCOPE_WEEKLY}, l AS (SELECT Sales AS a FROM n WHERE back = 1), f AS (SELECT v AS b FROM fc WHERE step = 1)
        SELECT {rnd('a', 2)} AS last_actual, {rnd('b', 2)} AS first_forecast, {rnd('(b - a) / greatest(a, 1.0) * 100', 2)} AS step_pct FROM l, f""",
)
def _(spark, d):
    return rounded(forecast.first_step_jump(*_scope_by_week(spark, d)), 2)


# --- orders and sales together --------------------------------------------------------------------


_FITS = f"""{S.SCOPE_DAY}, r AS (SELECT Date, Sales AS y, Units AS o, lag(Sales) OVER (ORDER BY Date) AS a, lag(Units) OVER (ORDER BY Date) AS c FROM scope_day),
    t AS (SELECT * FROM r WHERE a IS NOT NULL AND c IS NOT NULL),
    f AS (SELECT covar_pop(c, o) * COUNT(*) / (var_pop(c) * COUNT(*) + 5.0) AS oc, AVG(o) AS mo, AVG(c) AS mc FROM t), f2 AS (SELECT oc, mo - oc * mc AS o0 FROM f),
    staged AS (SELECT t.*, o0 + oc * c AS p FROM t, f2), {_normal('g', 'staged', ('a', 'p'), 'y', '3.0')},
    newest AS (SELECT max_by(Sales, Date) AS ns, max_by(Units, Date) AS nu, MAX(Date) AS x FROM scope_day)"""


def _coupled_sql(order: str) -> str:
    return f"""WITH RECURSIVE {_FITS}, w AS (SELECT wa, wb, w0, oc, o0 FROM g, f2),
        steps AS (SELECT 0 AS i, ns AS s, nu AS u FROM newest UNION ALL
          SELECT i + 1, greatest(0.0, w0 + wa * s + wb * {order}), {order} FROM steps, w WHERE i < {STEPS})
        SELECT CAST(i AS INT) AS step, CAST(x + i * INTERVAL 1 DAY AS DATE) AS Date, {rnd('s', 1)} AS Forecasted_Sales, {rnd('u', 1)} AS Orders, true AS Orders_Carried
        FROM steps, newest WHERE i > 0"""


def _coupled(spark, d, scenario=None):
    series = views.scope_day(spark, d)
    matrix = features.transform(series, COUPLED)
    fitted = models.fit_two_stage(
        matrix, ("lag_1_Units",), ("lag_1_Sales",), "Units", "Sales", order_params={"alpha": 5.0}, sales_params={"alpha": 3.0}
    )
    out = forecast.recursive_forecast(
        series, COUPLED, fitted.sales, STEPS, scenario=scenario, orders=fitted.orders, order_input="pred_orders", with_orders=True, digits=None
    )
    return rounded(out, 1)


@query("H3_M10_orders_and_sales_forecast", _coupled_sql("greatest(0.0, o0 + oc * u)"))
def _(spark, d):
    return _coupled(spark, d)


@query("H4_scenario_on_orders", _coupled_sql("4000.0::DOUBLE"))
def _(spark, d):
    return _coupled(spark, d, {"Units": 4000.0})


@query("H3_forest_forecast_store_panel")
def _(spark, d):
    series = views.store_day(spark, d)
    config = FeatureConfig(order="Units", store="Store", discount="Discount", holiday="Holiday", categorical=("Region",))
    matrix, config = features.fit_transform(series, config)
    rows = features.complete_rows(matrix, config)
    forest = models.fit_model(models.FOREST, models.stable_order(rows, ("Date", "Store")), config.feature_columns, "Sales", {"numTrees": 20, "maxDepth": 6})
    return forecast.recursive_forecast(series, config, forest, 14)


# --- categories of any size -------------------------------------------------------------------------


@query(
    "E4_sparse_levels",
    """WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS level, COUNT(*) AS n FROM lineitem GROUP BY 1)
       SELECT row_number() OVER (ORDER BY level) - 1 AS position, level, n::DOUBLE AS n FROM l""",
)
def _(spark, d):
    lines = views.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("OrderKey"))
    levels = features.level_table(lines, "OrderKey").persist()
    encoded = features.with_sparse_levels(lines, levels, "OrderKey", "v")
    sums = features.sparse_sums(encoded, "v", "position", "n")
    return sums.join(levels, "position").select("position", "level", "n")


_LEVEL_FIT = """l AS (SELECT l_suppkey AS g, COUNT(*) AS n, AVG(l_quantity) AS m FROM lineitem GROUP BY 1), b AS (SELECT SUM(n / (n + 2.0) * m) / SUM(n / (n + 2.0)) AS b FROM l)"""


@query(
    "M4_ridge_on_sparse_levels",
    f"WITH {_LEVEL_FIT} SELECT g::VARCHAR AS Supplier, {rnd('b + n * (m - b) / (n + 2.0)', 4)} AS prediction FROM l, b",
)
def _(spark, d):
    lines = views.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("Supplier"), F.col("l_quantity").cast("double").alias("Sales"))
    rows = lines.withColumn("none", F.lit(0.0))
    model = models.fit_model(models.RIDGE, rows, ["none"], "Sales", {"alpha": 2.0}, categories=["Supplier"])
    return rounded(model.transform(rows.select("Supplier", "none").distinct()).select("Supplier", "prediction"), 4)
