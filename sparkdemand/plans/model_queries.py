"""Queries on features, splits, models, evaluation, forecasts and saved runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdemand.operators import evaluate, features, forecast, models, split, tune
from sparkdemand.operators.features import FeatureConfig
from sparkdemand.plans import sql as S
from sparkdemand.plans.analysis_queries import cents
from sparkdemand.plans.registry import query, rounded
from sparkdemand.plans.sql import rnd, rnd_plain
from sparkdemand.plans.table_queries import scratch
from sparkdemand.sources import runs, views

SCOPE = FeatureConfig(order="Units", holiday="Holiday")
PANEL = FeatureConfig(order="Units", store="Store", discount="Discount", holiday="Holiday", categorical=("Region",))

_W = "(PARTITION BY Store ORDER BY Date"


def _panel(spark, d):
    return views.store_day(spark, d)


# --- features ------------------------------------------------------------------------------------


@query(
    "E1_calendar_columns",
    f"""WITH {S.SCOPE_DAY} SELECT Date, day(Date) AS day, month(Date) AS month, year(Date) AS year, isodow(Date) - 1 AS weekday,
        CAST(isodow(Date) >= 6 AS INT) AS is_weekend, quarter(Date) AS quarter, dayofyear(Date) AS dayofyear, week(Date) AS weekofyear,
        CAST(day(Date) = 1 AS INT) AS is_month_start, CAST(Date = last_day(Date) AS INT) AS is_month_end FROM scope_day""",
)
def _(spark, d):
    return views.scope_day(spark, d).select("Date").withColumns(features.calendar_columns(F.col("Date")))


@query(
    "E2_calendar_short_list",
    f"""WITH {S.ORDERS_FACT} SELECT DISTINCT Date, day(Date) AS day, month(Date) AS month, year(Date) AS year, isodow(Date) - 1 AS weekday,
        week(Date) AS weekofyear, CAST(isodow(Date) >= 6 AS INT) AS is_weekend FROM orders_fact""",
)
def _(spark, d):
    days = views.orders_fact(spark, d).select("Date").distinct()
    return days.withColumns(features.calendar_columns(F.col("Date"), features.CALENDAR_SHORT))


_LAGS = ", ".join(f"{rnd(f'lag({c}, {k}) OVER {_W})', 2)} AS lag_{k}_{c}" for c in ("Sales", "Units") for k in (1, 7, 14, 28))


@query("W4_lags_per_store", f"WITH {S.STORE_DAY} SELECT Store, Date, {_LAGS} FROM store_day")
def _(spark, d):
    w = features.history_window(["Store"], "Date")
    lags = features.lag_columns(["Sales", "Units"], PANEL.lags, w)
    return rounded(_panel(spark, d).select("Store", "Date", *[c.alias(n) for n, c in lags.items()]), 2)


def _rolling_sql(c: str, k: int) -> str:
    frame = f"OVER {_W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return ", ".join(
        [
            f"{rnd(f'AVG({c}) {frame}', 4)} AS rolling_{c}_{k}_mean",
            f"{rnd(f'coalesce(stddev_samp({c}) {frame}, 0.0)', 3)} AS rolling_{c}_{k}_std",
            f"{rnd(f'MIN({c}) {frame}', 2)} AS rolling_{c}_{k}_min",
            f"{rnd(f'MAX({c}) {frame}', 2)} AS rolling_{c}_{k}_max",
        ]
    )


_ROLLING = ", ".join(_rolling_sql(c, k) for c in ("Sales", "Units") for k in (7, 14, 30))


@query("W5_shifted_rolling_per_store", f"WITH {S.STORE_DAY} SELECT Store, Date, {_ROLLING} FROM store_day")
def _(spark, d):
    w = features.history_window(["Store"], "Date")
    cols = features.rolling_columns(["Sales", "Units"], PANEL.rolling, w)
    out = _panel(spark, d).select("Store", "Date", *[c.alias(n) for n, c in cols.items()])
    digits = {"mean": 4, "std": 3, "min": 2, "max": 2}
    fix = lambda n: F.round(F.col(n) + F.signum(n) * 3 * 10.0 ** -(digits[n[-4:].strip("_")] + 4), digits[n[-4:].strip("_")])
    return out.withColumns({n: fix(n) for n in cols})


@query(
    "W6_strict_rolling_per_store",
    f"""WITH {S.STORE_DAY}, w AS (SELECT Store, Date, COUNT(*) OVER {_W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS n,
        AVG(Sales) OVER {_W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS a FROM store_day)
        SELECT Store, Date, CASE WHEN n = 7 THEN {rnd('a', 4)} END AS rolling_Sales_7 FROM w""",
)
def _(spark, d):
    w = features.history_window(["Store"], "Date")
    return rounded(_panel(spark, d).select("Store", "Date", *[c.alias(n) for n, c in features.strict_rolling_columns(["Sales"], [7], w).items()]))


@query(
    "W7_W8_growth_and_order_value",
    f"""WITH {S.STORE_DAY}, l AS (SELECT Store, Date, lag(Sales, 1) OVER {_W}) AS s1, lag(Sales, 7) OVER {_W}) AS s7, lag(Units, 1) OVER {_W}) AS u1 FROM store_day)
        SELECT Store, Date, {rnd('(s1 - s7) / greatest(abs(s7), 1e-5)', 4)} AS sales_growth_lag, {rnd('s1 / (greatest(u1, 0.0) + 1e-5)', 4)} AS lag_1_aov,
               {rnd('s1 / (u1 + 1)', 4)} AS lag_1_aov_plus_one FROM l""",
)
def _(spark, d):
    out = features.transform(_panel(spark, d), PANEL)
    plus = features.order_value_plus_one(F.col("lag_1_Sales"), F.col("lag_1_Units")).alias("lag_1_aov_plus_one")
    return rounded(out.select("Store", "Date", "sales_growth_lag", "lag_1_aov", plus))


@query(
    "E3_event_flags",
    f"""WITH {S.STORE_DAY} SELECT Store, Date, CAST(lower(trim(Discount)) IN ('yes', '1', 'true', 'y', 'promo') AS INT) AS Discount_Flag,
        CAST(CAST(Holiday AS VARCHAR) IN ('yes', '1', 'true', 'y', 'holiday', '1.0') AS INT) AS Holiday_Flag FROM store_day""",
)
def _(spark, d):
    p = _panel(spark, d)
    return p.select("Store", "Date", *[c.alias(n) for n, c in features.flag_columns(PANEL, p.columns).items()])


_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _one_hot_sql(names) -> str:
    cols = ", ".join(f"""CAST(Region = '{r}' AS INT) AS "Region_{r}" """ for r in names)
    return f"WITH {S.STORE_DAY} SELECT Store, Date, {cols} FROM store_day"


@query("E4_one_hot_regions", _one_hot_sql(_REGIONS))
def _(spark, d):
    p = _panel(spark, d)
    levels = features.category_levels(p, ["Region"])
    return p.select("Store", "Date", *[c.alias(n) for n, c in features.one_hot_columns(levels, p.columns).items()])


@query("E9_one_hot_without_first", _one_hot_sql(_REGIONS[1:]))
def _(spark, d):
    p = _panel(spark, d)
    levels = features.category_levels(p, ["Region"])
    return p.select("Store", "Date", *[c.alias(n) for n, c in features.one_hot_columns(levels, p.columns, drop_first=True).items()])


@query("E5_E6_feature_matrix")
def _(spark, d):
    matrix, config = features.fit_transform(_panel(spark, d), PANEL)
    return features.complete_rows(matrix, config).select("Store", "Date", "Sales", *[F.col(f"`{c}`") for c in config.feature_columns])


@query(
    "E7_leakage_check",
    f"""WITH {S.SCOPE_DAY}, n AS (SELECT unnest(['Tax', 'day', 'month', 'year', 'weekday', 'is_weekend', 'quarter', 'dayofyear', 'weekofyear', 'is_month_start',
          'is_month_end', 'lag_1_Sales', 'lag_7_Sales', 'lag_14_Sales', 'lag_28_Sales', 'lag_1_Units', 'lag_7_Units', 'lag_14_Units', 'lag_28_Units',
          {', '.join(f"'rolling_{c}_{k}_{s}'" for c in ('Sales', 'Units') for k in (7, 14, 30) for s in ('mean', 'std', 'min', 'max'))},
          'sales_growth_lag', 'lag_1_aov', 'Holiday_Flag']) AS Feature_Name)
        SELECT Feature_Name, 0 AS changed FROM n""",
)
def _(spark, d):
    series = views.scope_day(spark, d)
    return features.leakage_violations(series, features.fit(series, SCOPE), "1999-06-01")


@query(
    "E8_vif_two_columns",
    f"""WITH {S.STORE_DAY}, r AS (SELECT corr(Sales, Units) AS r FROM store_day), c AS (SELECT 1 / (1 - r * r) AS v FROM r)
        SELECT f AS Feature, {rnd('v', 6)} AS VIF, CASE WHEN v < 5 THEN 'Safe' WHEN v < 10 THEN 'Moderate' WHEN v < 50 THEN 'High'
               ELSE 'Severe / Potentially Perfect Collinearity' END AS Interpretation FROM c, (SELECT unnest(['Sales', 'Units']) AS f)""",
)
def _(spark, d):
    return rounded(features.variance_inflation(_panel(spark, d), ["Sales", "Units"]).drop("pos"), 6)


@query("E8_vif_feature_matrix")
def _(spark, d):
    matrix, config = features.fit_transform(_panel(spark, d), PANEL)
    return features.variance_inflation(matrix, [*config.feature_columns, "Sales", "Units"])


@query(
    "H5_series_per_store_product",
    f"""WITH {S.SALES_FACT} SELECT Store, Product, Date, {rnd('SUM(Sales)', 2)} AS Sales, {rnd('SUM(Units)', 2)} AS Units, MAX(Holiday) AS Holiday
        FROM sales_fact GROUP BY Store, Product, Date""",
)
def _(spark, d):
    f = views.sales_fact(spark, d).select("Store", "Product", "Date", "Sales", "Units", "Holiday")
    return rounded(features.to_series(f, FeatureConfig(order="Units", store="Store", product="Product")), 2)


# --- splits ---------------------------------------------------------------------------------------


@query(
    "M1_chronological_split",
    f"""WITH {S.STORE_DAY}, d AS (SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT Date FROM store_day)),
        c AS (SELECT MAX(CASE WHEN i = CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) THEN Date END) AS a,
                     MAX(CASE WHEN i = CAST(floor(n * CAST(0.85 AS DOUBLE)) AS BIGINT) THEN Date END) AS b FROM d),
        s AS (SELECT CASE WHEN Date < a THEN 'train' WHEN Date < b THEN 'val' ELSE 'test' END AS part, Date FROM store_day, c)
        SELECT part, MIN(Date) AS first_date, MAX(Date) AS last_date, COUNT(*) AS rows FROM s GROUP BY part""",
)
def _(spark, d):
    return split.chronological_split(_panel(spark, d)).info.drop("pos")


@query(
    "M1_split_by_position_few_dates",
    f"""WITH {S.SALES_FACT}, y AS (SELECT CAST(date_trunc('year', Date) AS DATE) AS Date FROM sales_fact), n AS (SELECT COUNT(*) AS n FROM y),
        p AS (SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS i FROM y),
        s AS (SELECT CASE WHEN i < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN i < floor(n * CAST(0.85 AS DOUBLE)) THEN 'val' ELSE 'test' END AS part, Date FROM p, n)
        SELECT part, MIN(Date) AS first_date, MAX(Date) AS last_date, COUNT(*) AS rows FROM s GROUP BY part""",
)
def _(spark, d):
    yearly = views.sales_fact(spark, d).select(F.trunc("Date", "year").alias("Date"))
    return split.chronological_split(yearly).info.drop("pos")


@query(
    "F9_fixed_date_split",
    f"""WITH {S.SALES_FACT}, s AS (SELECT CASE WHEN Date < DATE '1999-02-01' THEN 'train' WHEN Date < DATE '1999-05-01' THEN 'val' ELSE 'test' END AS part, Date FROM sales_fact)
        SELECT part, MIN(Date) AS first_date, MAX(Date) AS last_date, COUNT(*) AS rows FROM s GROUP BY part""",
)
def _(spark, d):
    parts = split.fixed_date_split(views.sales_fact(spark, d), "1999-02-01", "1999-05-01")
    return split.split_info(*parts, "Date").drop("pos")


@query(
    "M2_expanding_folds",
    f"""WITH {S.STORE_DAY}, p AS (SELECT Date, row_number() OVER (ORDER BY Date, Store) - 1 AS i, COUNT(*) OVER () AS n FROM store_day),
        f AS (SELECT unnest([0, 1, 2]) AS fold), b AS (SELECT fold, Date, i, n - (3 - fold) * (n // 4) AS lo, n - (2 - fold) * (n // 4) AS hi FROM p, f)
        SELECT fold, COUNT(CASE WHEN i < lo THEN 1 END) AS train_rows, COUNT(CASE WHEN i >= lo AND i < hi THEN 1 END) AS test_rows,
               MIN(CASE WHEN i >= lo AND i < hi THEN Date END) AS first_test_date, MAX(CASE WHEN i >= lo AND i < hi THEN Date END) AS last_test_date
        FROM b GROUP BY fold""",
)
def _(spark, d):
    # Store names sort as text, so the tie-break is their order among all stores of a date.
    return split.fold_sizes(_panel(spark, d).select("Date", "Store"), "Date", 3, ["Store"])


# --- models and evaluation --------------------------------------------------------------------------

_NAIVE = f"""{S.STORE_DAY}, n AS (SELECT Store, Date, Sales AS y, greatest(0.0, coalesce(lag(Sales, 1) OVER {_W}), 0.0)) AS p1,
             greatest(0.0, coalesce(lag(Sales, 7) OVER {_W}), 0.0)) AS p7 FROM store_day)"""


def _naive_rows(spark, d):
    out = features.transform(_panel(spark, d), PANEL)
    out = models.naive_model("lag_1_Sales").transform(out, "p1")
    return models.naive_model("lag_7_Sales").transform(out, "p7").select("Store", "Date", "Sales", "p1", "p7")


@query("M3_naive_predictions", f"WITH {_NAIVE} SELECT Store, Date, {rnd('p1', 2)} AS p1, {rnd('p7', 2)} AS p7 FROM n")
def _(spark, d):
    return rounded(_naive_rows(spark, d).drop("Sales"), 2)


def _metrics_sql(p: str) -> str:
    return f"""SELECT AVG(abs(y - {p})) AS mae, AVG((y - {p}) * (y - {p})) AS mse, SUM(abs(y - {p})) / SUM(abs(y)) AS w,
                      AVG(abs(y - {p}) / greatest(abs(y), 1.0)) AS mape, 1 - AVG((y - {p}) * (y - {p})) / var_pop(y) AS r2 FROM n"""


@query(
    "V1_regression_metrics",
    f"""WITH {_NAIVE}, m AS ({_metrics_sql('p1')}) SELECT {rnd_plain('mae', 2)} AS MAE, {rnd_plain('sqrt(mse)', 2)} AS RMSE, {rnd_plain('mse', 2)} AS MSE,
        {rnd_plain('w * 100', 2)} AS WAPE_Pct, {rnd_plain('greatest(0, (1 - w) * 100)', 2)} AS WAPE_Accuracy_Pct, {rnd_plain('mape * 100', 2)} AS Safe_MAPE_Pct,
        {rnd_plain('r2', 4)} AS R2 FROM m""",
)
def _(spark, d):
    return evaluate.regression_metrics(_naive_rows(spark, d), "Sales", "p1")


@query(
    "V2_leaderboard",
    f"WITH {_NAIVE} "
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS Model, {rnd_plain('greatest(0, (1 - w) * 100)', 2)} AS Accuracy_Pct, {rnd_plain('mae', 2)} AS MAE, {rnd_plain('sqrt(mse)', 2)} AS RMSE,
            {rnd_plain('w * 100', 2)} AS WAPE_Pct, {rnd_plain('r2', 4)} AS R2 FROM ({_metrics_sql(p)})"""
        for name, p in (("Naive lag 1", "p1"), ("Naive lag 7", "p7"))
    ),
)
def _(spark, d):
    return evaluate.leaderboard(_naive_rows(spark, d), "Sales", {"Naive lag 1": "p1", "Naive lag 7": "p7"})


_DIAG = f"""{_NAIVE}, diag AS (SELECT Date, {rnd_plain('y', 2)} AS Actual_Sales, {rnd_plain('p1', 2)} AS Predicted_Sales, {rnd_plain('y - p1', 2)} AS Residual,
            {rnd_plain('abs(y - p1)', 2)} AS Absolute_Error, {rnd_plain('abs(y - p1) / greatest(y, 1.0) * 100', 2)} AS Percentage_Error FROM n)"""


@query("V3_J4_diagnostics", f"WITH {_DIAG} SELECT * FROM diag")
def _(spark, d):
    return evaluate.diagnostics(_naive_rows(spark, d), "Date", "Sales", "p1")


@query("V4_parity_range", f"WITH {_DIAG} SELECT least(MIN(Actual_Sales), MIN(Predicted_Sales)) AS min_value, greatest(MAX(Actual_Sales), MAX(Predicted_Sales)) AS max_value FROM diag")
def _(spark, d):
    return evaluate.parity_range(evaluate.diagnostics(_naive_rows(spark, d), "Date", "Sales", "p1"))


@query(
    "A18_V4_residual_histogram",
    f"""WITH {_DIAG}, s AS (SELECT MIN(Residual) AS lo, MAX(Residual) AS hi FROM diag),
        h AS (SELECT CAST(least(floor((Residual - lo) / ((hi - lo) / 25)), 24) AS INT) AS bin, lo, hi FROM diag, s)
        SELECT bin, {rnd('lo + bin * ((hi - lo) / 25)', 4)} AS bin_start, {rnd('lo + (bin + 1) * ((hi - lo) / 25)', 4)} AS bin_end, COUNT(*) AS n FROM h GROUP BY bin, lo, hi""",
)
def _(spark, d):
    return rounded(evaluate.residual_histogram(evaluate.diagnostics(_naive_rows(spark, d), "Date", "Sales", "p1")))


@query("V5_metric_cards")
def _(spark, d):
    return evaluate.metric_cards(evaluate.regression_metrics(_naive_rows(spark, d), "Sales", "p1"))


@query(
    "V6_batch_measures",
    f"WITH {_NAIVE} SELECT {rnd('SUM(abs(y - p7)) / (SUM(y) + 1e-8)', 6)} AS WAPE, {rnd('AVG(abs((y - p7) / y))', 4)} AS MAPE FROM n",
)
def _(spark, d):
    m = evaluate.wape_mape(_naive_rows(spark, d), "Sales", "p7")
    return m.select(F.round(F.col("WAPE") + 3e-10, 6).alias("WAPE"), F.round(F.col("MAPE") + 3e-8, 4).alias("MAPE"))


def _training_rows(spark, d, config, series):
    matrix, fitted = features.fit_transform(series, config)
    rows = features.complete_rows(matrix, fitted).persist()
    return rows, fitted


def _trained(spark, d, names, params=None, panel=False):
    series, config, keys = (_panel(spark, d), PANEL, ("Date", "Store")) if panel else (views.scope_day(spark, d), SCOPE, ("Date",))
    rows, fitted = _training_rows(spark, d, config, series)
    parts = split.chronological_split(rows)
    return models.train_models(parts.train, parts.val, parts.test, fitted.feature_columns, "Sales", names, params, keys), fitted, series


@query("M4_M8_ridge_on_store_panel")
def _(spark, d):
    result, _c, _s = _trained(spark, d, (models.RIDGE,), panel=True)
    return result.test.select("Store", "Date", "Sales", result.prediction_cols[models.RIDGE])


@query("M5_random_forest")
def _(spark, d):
    result, _c, _s = _trained(spark, d, (models.FOREST,))
    return result.test.select("Date", "Sales", result.prediction_cols[models.FOREST])


@query("M9_V2_train_and_rank")
def _(spark, d):
    result, _c, _s = _trained(spark, d, (models.NAIVE, models.RIDGE, models.FOREST, models.BOOSTED))
    return evaluate.leaderboard(result.test, "Sales", result.prediction_cols, result.times).drop("Train_Time_s")


@query("M7_leafwise_boosting")
def _(spark, d):
    result, _c, _s = _trained(spark, d, (models.LEAFWISE,))
    return result.test.select("Date", "Sales", result.prediction_cols[models.LEAFWISE])


@query("M6_boosted_trees")
def _(spark, d):
    result, _c, _s = _trained(spark, d, (models.BOOSTED,))
    return result.test.select("Date", "Sales", result.prediction_cols[models.BOOSTED])


_ORDER_FEATURES = ("day", "month", "weekday", "weekofyear", "is_weekend", "Holiday_Flag", "Discount_Flag", "lag_1_Units", "lag_7_Units", "rolling_Units_7_mean", "lag_1_Sales", "lag_7_Sales", "rolling_Sales_7_mean", "lag_1_aov")


@query("M10_two_stage_ridge")
def _(spark, d):
    rows, _c = _training_rows(spark, d, PANEL, _panel(spark, d))
    parts = split.chronological_split(rows)
    fitted = models.fit_two_stage(parts.train, _ORDER_FEATURES, _ORDER_FEATURES, "Units", "Sales")
    return models.two_stage_errors(fitted, parts.val, "Units", "Sales")


@query("M11_ridge_search")
def _(spark, d):
    rows, fitted = _training_rows(spark, d, SCOPE, views.scope_day(spark, d))
    return tune.tune_model(rows, fitted.feature_columns, "Sales", models.RIDGE).trials


@query("M12_batch_ridge_search")
def _(spark, d):
    rows, fitted = _training_rows(spark, d, SCOPE, views.scope_day(spark, d))
    return tune.tune_model(rows, fitted.feature_columns, "Units", models.RIDGE, 30, 3, "MAE", "batch", drop_missing=True).trials


@query("K3_ridge_importances")
def _(spark, d):
    result, _c, _s = _trained(spark, d, (models.RIDGE,))
    ridge = result.models[models.RIDGE]
    return evaluate.importance_table(spark, ridge.feature_cols, ridge.weights(), 15)


@query("S6_S7_S8_saved_runs")
def _(spark, d):
    result, fitted, _s = _trained(spark, d, (models.NAIVE, models.RIDGE))
    root = scratch(spark, "runs")
    runs.save_run(spark, root, fitted, result.models, "Daily Sales", result.times, now=1_700_000_000)
    runs.save_run(spark, root, fitted, {}, "Other", {}, now=1_700_000_060)
    latest = runs.load_latest(spark, root, "Daily Sales")
    again = latest["models"][models.RIDGE].transform(result.test, "again")
    gap = again.agg(F.max(F.abs(F.col("again") - F.col(result.prediction_cols[models.RIDGE]))).alias("largest_gap"))
    return runs.list_runs(spark, root).crossJoin(gap)


# --- forecasts ------------------------------------------------------------------------------------


def _future_sql(ctes: str, source: str, first: str, step: str, n: int) -> str:
    return f"""WITH {ctes}, l AS (SELECT MAX(Date) AS x FROM {source}), f AS (SELECT {first} AS f FROM l)
        SELECT CAST(i AS INT) + 1 AS step, CAST(f + i * INTERVAL {step} AS DATE) AS Date FROM f, range({n}) r(i)"""


@query("H1_H2_future_days", _future_sql(S.SCOPE_DAY, "scope_day", "CAST(x + INTERVAL 1 DAY AS DATE)", "1 DAY", 90))
def _(spark, d):
    return forecast.future_calendar(views.scope_day(spark, d), "Date", forecast.horizon_for("3 Months", "Daily"), "Daily")


@query(
    "H1_H2_future_weeks",
    _future_sql(S.SCOPE_WEEK, "scope_week", "CAST(x + INTERVAL 7 DAY + ((7 - isodow(x + INTERVAL 7 DAY)) % 7) * INTERVAL 1 DAY AS DATE)", "7 DAY", 13),
)
def _(spark, d):
    return forecast.future_calendar(views.scope_week(spark, d), "Date", forecast.horizon_for("3 Months", "Weekly"), "Weekly")


@query(
    "H1_H2_future_months",
    _future_sql(
        S.SALES_FACT, "sales_fact",
        """CASE WHEN day(x + INTERVAL 1 MONTH) = 1 THEN CAST(x + INTERVAL 1 MONTH AS DATE) ELSE CAST(date_trunc('month', x + INTERVAL 2 MONTH) AS DATE) END""",
        "1 MONTH", 6,
    ),
)
def _(spark, d):
    return forecast.future_calendar(views.sales_fact(spark, d), "Date", forecast.horizon_for("6 Months", "Monthly"), "Monthly")


@query(
    "U1_history_with_future_rows",
    f"""WITH {S.SCOPE_DAY}, l AS (SELECT MAX(Date) AS x FROM scope_day)
        SELECT Date, {rnd('Sales', 2)} AS Sales FROM scope_day UNION ALL SELECT CAST(x + (i + 1) * INTERVAL 1 DAY AS DATE), NULL FROM l, range(30) r(i)""",
)
def _(spark, d):
    series = views.scope_day(spark, d).select("Date", "Sales")
    ahead = forecast.future_calendar(series, "Date", 30, "Daily").select("Date")
    return rounded(forecast.append_rows(series, ahead), 2)


@query("U3_distinct_dates", f"WITH {S.SALES_FACT} SELECT DISTINCT Store, Date FROM sales_fact")
def _(spark, d):
    return views.sales_fact(spark, d).select("Store", "Date").distinct()


_LAST = "l AS (SELECT Store, MAX(Date) AS x, max_by(Sales, Date) AS v FROM store_day GROUP BY Store)"


def _naive_forecast(spark, d):
    series = _panel(spark, d)
    return forecast.recursive_forecast(series, features.fit(series, PANEL), models.naive_model("lag_1_Sales"), 30)


@query(
    "H3_naive_forecast_all_stores",
    f"""WITH {S.STORE_DAY}, {_LAST} SELECT Store, CAST(i AS INT) + 1 AS step, CAST(x + (i + 1) * INTERVAL 1 DAY AS DATE) AS Date, {rnd_plain('v', 2)} AS Forecasted_Sales
        FROM l, range(30) r(i)""",
)
def _(spark, d):
    return _naive_forecast(spark, d)


@query(
    "H6_forecast_checks",
    f"WITH {S.STORE_DAY} SELECT Store, 30 AS rows, 0 AS invalid, 0 AS negative, true AS ok FROM store_day GROUP BY Store",
)
def _(spark, d):
    return forecast.forecast_checks(_naive_forecast(spark, d), 30, ["Store"])


def _scope_naive(spark, d):
    series = views.scope_day(spark, d)
    return series, forecast.recursive_forecast(series, features.fit(series, SCOPE), models.naive_model("lag_1_Sales"), 30)


_SCOPE_NAIVE = f"""{S.SCOPE_DAY}, l AS (SELECT MAX(Date) AS x, max_by(Sales, Date) AS last_actual FROM scope_day),
    fc AS (SELECT CAST(x + (i + 1) * INTERVAL 1 DAY AS DATE) AS Date, {rnd_plain('last_actual', 2)} AS v FROM l, range(30) r(i))"""


@query(
    "H7_W10_forecast_summary",
    f"""WITH {_SCOPE_NAIVE}, r AS (SELECT SUM(Sales) AS recent FROM (SELECT Sales FROM scope_day ORDER BY Date DESC LIMIT 30)),
        t AS (SELECT SUM(v) AS total, AVG(v) AS mean, MIN(Date) AS first, MAX(v) AS v FROM fc), c AS (SELECT *, (total - recent) / recent * 100 AS change FROM t, r)
        SELECT {rnd('total', 2)} AS total_forecast, {rnd('mean', 2)} AS avg_forecast, first AS peak_period, v AS peak_val, first AS low_period, v AS low_val,
               CASE WHEN change >= 2 THEN 'Increasing' WHEN change <= -2 THEN 'Decreasing' ELSE 'Stable' END AS trend, {rnd('change', 2)} AS change_vs_recent_pct,
               {rnd('recent', 2)} AS recent_actual_total FROM c""",
)
def _(spark, d):
    series, ahead = _scope_naive(spark, d)
    return rounded(forecast.forecast_summary(ahead, series), 2)


@query(
    "U2_stitched_curve",
    f"""WITH {_SCOPE_NAIVE} SELECT Date, {rnd('Sales', 2)} AS value, 'actual' AS kind FROM scope_day
        UNION ALL SELECT x, {rnd('last_actual', 2)}, 'forecast' FROM l UNION ALL SELECT Date, v, 'forecast' FROM fc""",
)
def _(spark, d):
    return rounded(forecast.stitched_curve(*_scope_naive(spark, d)), 2)


@query("H8_first_step_jump", f"WITH {_SCOPE_NAIVE} SELECT {rnd('last_actual', 2)} AS last_actual, {rnd('last_actual', 2)} AS first_forecast, 0.0 AS step_pct FROM l")
def _(spark, d):
    return rounded(forecast.first_step_jump(*_scope_naive(spark, d)), 2)


@query("H3_ridge_forecast_all_stores")
def _(spark, d):
    result, fitted, series = _trained(spark, d, (models.RIDGE,), panel=True)
    return forecast.recursive_forecast(series, fitted, result.models[models.RIDGE], 30)


@query("H3_forest_forecast")
def _(spark, d):
    result, fitted, series = _trained(spark, d, (models.FOREST,))
    return forecast.recursive_forecast(series, fitted, result.models[models.FOREST], forecast.horizon_for("3 Months", "Daily"))


@query("H4_holiday_scenario")
def _(spark, d):
    result, fitted, series = _trained(spark, d, (models.RIDGE,))
    base = forecast.recursive_forecast(series, fitted, result.models[models.RIDGE], 30)
    busy = forecast.recursive_forecast(series, fitted, result.models[models.RIDGE], 30, "Daily", {"Holiday": 1})
    return base.join(busy.select("step", F.col("Forecasted_Sales").alias("Scenario_Sales")), "step")
