"""Models, searches and p-values whose numbers SQL can work out in closed form, on two inputs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sparkdemand.functions import columns as fc
from sparkdemand.operators import evaluate, features, models, ridge, split, stats, tune
from sparkdemand.operators.features import FeatureConfig
from sparkdemand.plans import sql as S
from sparkdemand.plans.registry import query, rounded
from sparkdemand.plans.sql import rnd
from sparkdemand.plans.table_queries import scratch
from sparkdemand.sources import runs, views

LAGGED = FeatureConfig(order="Units", store="Store", lags=(1, 7), rolling=())
INPUTS = ("lag_1_Sales", "lag_7_Sales")
_W = "(PARTITION BY Store ORDER BY Date)"

_ROWS = f"""{S.STORE_DAY}, lagged AS (SELECT Store, Date, Sales AS y, Units AS o, lag(Sales, 1) OVER {_W} AS a, lag(Sales, 7) OVER {_W} AS b,
      lag(Units, 1) OVER {_W} AS c, lag(Units, 7) OVER {_W} AS e FROM store_day),
    r AS (SELECT * FROM lagged WHERE b IS NOT NULL)"""
_CUTS = """d AS (SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT Date FROM r)),
    cuts AS (SELECT MAX(CASE WHEN i = CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) THEN Date END) AS v,
                    MAX(CASE WHEN i = CAST(floor(n * CAST(0.85 AS DOUBLE)) AS BIGINT) THEN Date END) AS t FROM d),
    train AS (SELECT r.* FROM r, cuts WHERE Date < v), val AS (SELECT r.* FROM r, cuts WHERE Date >= v AND Date < t), test AS (SELECT r.* FROM r, cuts WHERE Date >= t)"""


def _normal(name: str, source: str, x: tuple[str, str], y: str, alpha: str, by: str = "") -> str:
    """CTE with the weights wa, wb and the intercept w0 of a ridge fit on two inputs."""
    a, b = x
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""{name}_s AS (SELECT {keys}{alpha} AS alpha, COUNT(*) AS n, AVG({a}) AS ma, AVG({b}) AS mb, AVG({y}) AS my, var_pop({a}) * COUNT(*) + {alpha} AS aa,
      var_pop({b}) * COUNT(*) + {alpha} AS bb, covar_pop({a}, {b}) * COUNT(*) AS ab, covar_pop({a}, {y}) * COUNT(*) AS ay, covar_pop({b}, {y}) * COUNT(*) AS yb FROM {source}{group}),
    {name}_w AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM {name}_s),
    {name} AS (SELECT *, my - wa * ma - wb * mb AS w0 FROM {name}_w)"""


def _lagged_rows(spark, d):
    out = features.transform(views.store_day(spark, d), LAGGED)
    return out.where(F.col("lag_7_Sales").isNotNull()).select("Store", "Date", "Sales", "Units", *INPUTS, "lag_1_Units", "lag_7_Units")


# --- ridge ----------------------------------------------------------------------------------------


_RIDGE = f"{_ROWS}, {_CUTS}, {_normal('m', 'train', ('a', 'b'), 'y', '1.0')}"


@query(
    "M4_M8_ridge_two_inputs",
    f"WITH {_RIDGE} SELECT Store, Date, {rnd('greatest(0.0, w0 + wa * a + wb * b)', 2)} AS prediction FROM test, m",
)
def _(spark, d):
    rows = _lagged_rows(spark, d).persist()
    parts = split.chronological_split(rows)
    model = models.fit_model(models.RIDGE, parts.train, INPUTS, "Sales", {"alpha": 1.0})
    return rounded(model.transform(parts.test).select("Store", "Date", "prediction"), 2)


@query(
    "M4_ridge_from_sums",
    f"WITH {_RIDGE} SELECT {rnd('wa', 6)} AS lag_1_Sales, {rnd('wb', 6)} AS lag_7_Sales, {rnd('w0', 2)} AS intercept FROM m",
)
def _(spark, d):
    parts = split.chronological_split(_lagged_rows(spark, d).persist())
    m = ridge.fit_ridge(parts.train, INPUTS, "Sales", 1.0)
    row = spark.createDataFrame([(*map(float, m.weights), m.intercept)], "lag_1_Sales double, lag_7_Sales double, intercept double")
    return rounded(row.withColumn("intercept", F.round("intercept", 2)), 6)


@query(
    "K3_ridge_importances_two_inputs",
    f"""WITH {_RIDGE}, i AS (SELECT 'lag_1_Sales' AS Feature, abs(wa) / (abs(wa) + abs(wb)) * 100 AS p FROM m UNION ALL SELECT 'lag_7_Sales', abs(wb) / (abs(wa) + abs(wb)) * 100 FROM m)
        SELECT Feature, {rnd('p', 2)} AS Importance_Pct FROM i""",
)
def _(spark, d):
    parts = split.chronological_split(_lagged_rows(spark, d).persist())
    model = models.fit_model(models.RIDGE, parts.train, INPUTS, "Sales")
    return rounded(evaluate.importance_table(spark, model.feature_cols, model.weights()), 2)


@query(
    "S6_S7_S8_reloaded_ridge",
    f"""WITH {_RIDGE} SELECT 'Lagged_Sales_1700000000' AS Run_ID, 2 AS Features, '2023-11-14 22:13' AS Saved_At, Store, Date,
        {rnd('greatest(0.0, w0 + wa * a + wb * b)', 2)} AS prediction FROM test, m""",
)
def _(spark, d):
    parts = split.chronological_split(_lagged_rows(spark, d).persist())
    fitted = models.fit_model(models.RIDGE, parts.train, INPUTS, "Sales")
    root = scratch(spark, "lagged-runs")
    config = FeatureConfig(order="Units", store="Store", lags=(1, 7), rolling=(), feature_columns=INPUTS)
    runs.save_run(spark, root, config, {models.RIDGE: fitted}, "Lagged Sales", now=1_700_000_000)
    runs.save_run(spark, root, config, {}, "Other", now=1_700_000_060)
    again = runs.load_latest(spark, root, "Lagged Sales")["models"][models.RIDGE]
    listed = runs.list_runs(spark, root).where("Dataset = 'Lagged Sales'").select("Run_ID", "Features", "Saved_At")
    return rounded(again.transform(parts.test).select("Store", "Date", "prediction"), 2).crossJoin(F.broadcast(listed))


_ORDERS = "(o0 + oa * c + oe * e)"


@query(
    "M10_two_stage_two_inputs",
    f"""WITH {_ROWS}, {_CUTS}, {_normal('f', 'train', ('c', 'e'), 'o', '5.0')}, f2 AS (SELECT w0 AS o0, wa AS oa, wb AS oe FROM f),
        staged AS (SELECT train.*, {_ORDERS} AS p FROM train, f2), {_normal('g', 'staged', ('a', 'p'), 'y', '3.0')},
        scored AS (SELECT abs(y - (w0 + wa * a + wb * {_ORDERS})) AS es, abs(o - {_ORDERS}) AS eo FROM val, f2, g)
        SELECT {rnd('AVG(es)', 3)} AS sales_mae, {rnd('AVG(eo)', 4)} AS orders_mae FROM scored""",
)
def _(spark, d):
    parts = split.chronological_split(_lagged_rows(spark, d).persist())
    fitted = models.fit_two_stage(
        parts.train, ("lag_1_Units", "lag_7_Units"), ("lag_1_Sales",), "Units", "Sales", order_params={"alpha": 5.0}, sales_params={"alpha": 3.0}
    )
    out = models.two_stage_errors(fitted, parts.val, "Units", "Sales")
    return rounded(out.select(F.round(F.col("sales_mae") + 3e-7, 3).alias("sales_mae"), "orders_mae"), 4)


def _search_sql(space: str, trials: int) -> str:
    rng = random.Random(models.SEED)
    alphas = [tune.draw(tune.SPACES[space][models.RIDGE], rng)["alpha"] for _ in range(trials)]
    drawn = ", ".join(f"({i}, CAST({a!r} AS DOUBLE))" for i, a in enumerate(alphas))
    mean = lambda x, k: rnd(f"AVG({x})", k)
    return f"""WITH {_ROWS}, drawn AS (SELECT * FROM (VALUES {drawn}) t(trial, alpha)),
        p AS (SELECT *, row_number() OVER (ORDER BY Date, Store) - 1 AS i, COUNT(*) OVER () AS size FROM r), f AS (SELECT unnest([0, 1, 2]) AS fold),
        b AS (SELECT fold, p.*, size - (3 - fold) * (size // 4) AS lo, size - (2 - fold) * (size // 4) AS hi FROM p, f),
        t AS (SELECT * FROM b, drawn WHERE i < lo), {_normal('m', 't', ('a', 'b'), 'y', 'alpha', 'trial, fold, alpha').replace('alpha AS alpha, ', '')},
        s AS (SELECT trial, fold, y, abs(y - (w0 + wa * a + wb * b.b)) AS e FROM b JOIN m USING (fold) WHERE i >= lo AND i < hi),
        k AS (SELECT trial, fold, SUM(e) / SUM(abs(y)) AS wape, AVG(e) AS mae, AVG(e * e) AS mse, AVG(CASE WHEN y <> 0 THEN e / abs(y) END) AS mape FROM s GROUP BY trial, fold)
        SELECT trial AS Trial, {mean('wape', 8)} AS WAPE, {mean('mae', 3)} AS MAE, {mean('sqrt(mse)', 3)} AS RMSE, {mean('mape', 6)} AS MAPE FROM k GROUP BY trial"""


def _search(spark, d, space: str, trials: int, objective: str):
    found = tune.tune_model(_lagged_rows(spark, d), INPUTS, "Sales", models.RIDGE, trials, 3, objective, space, tie=["Store"]).trials
    digits = {"WAPE": 8, "MAE": 3, "RMSE": 3, "MAPE": 6}
    return found.select("Trial", *[F.round(F.col(c) + 3 * 10.0 ** -(k + 4), k).alias(c) for c, k in digits.items()])


@query("M11_ridge_search_two_inputs", _search_sql("library", 15))
def _(spark, d):
    return _search(spark, d, "library", 15, "WAPE")


@query("M12_batch_ridge_search_two_inputs", _search_sql("batch", 30))
def _(spark, d):
    return _search(spark, d, "batch", 30, "MAE")


# --- the feature matrix ---------------------------------------------------------------------------


def _matrix_sql() -> str:
    w = "(PARTITION BY Store ORDER BY Date"
    made = [f"lag({c}, {k}) OVER {w}) AS lag_{k}_{c}" for c in ("Sales", "Units") for k in (1, 7, 14, 28)]
    for c in ("Sales", "Units"):
        for k in (7, 14, 30):
            frame = f"OVER {w} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
            made += [f"{f}({c}) {frame} AS rolling_{c}_{k}_{n}" for n, f in (("mean", "AVG"), ("min", "MIN"), ("max", "MAX"))]
            made.append(f"coalesce(stddev_samp({c}) {frame}, 0.0) AS rolling_{c}_{k}_std")
    plain = {
        "day": "day(Date)", "month": "month(Date)", "year": "year(Date)", "weekday": "isodow(Date) - 1", "is_weekend": "CAST(isodow(Date) >= 6 AS INT)",
        "quarter": "quarter(Date)", "dayofyear": "dayofyear(Date)", "weekofyear": "week(Date)", "is_month_start": "CAST(day(Date) = 1 AS INT)",
        "is_month_end": "CAST(Date = last_day(Date) AS INT)", "Discount_Flag": "CAST(lower(trim(Discount)) IN ('yes', '1', 'true', 'y', 'promo') AS INT)",
        "Holiday_Flag": "CAST(CAST(Holiday AS VARCHAR) IN ('yes', '1', 'true', 'y', 'holiday', '1.0') AS INT)",
    }
    plain |= {f'"Region_{r}"': f"CAST(Region = '{r}' AS INT)" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")}
    derived = {
        "Sales": "Sales", "Tax": "Tax", "sales_growth_lag": "(lag_1_Sales - lag_7_Sales) / greatest(abs(lag_7_Sales), 1e-5)",
        "lag_1_aov": "lag_1_Sales / (greatest(lag_1_Units, 0.0) + 1e-5)",
    }
    names = [m.rsplit(" AS ", 1)[1] for m in made]
    columns = [f"{v} AS {k}" for k, v in plain.items()] + [f"{rnd(v, 2)} AS {k}" for k, v in derived.items()] + [f"{rnd(n, 2)} AS {n}" for n in names]
    return f"""WITH {S.STORE_DAY}, x AS (SELECT *, {', '.join(made)} FROM store_day)
        SELECT Store, Date, {', '.join(columns)} FROM x WHERE lag_28_Sales IS NOT NULL AND lag_28_Units IS NOT NULL AND Tax IS NOT NULL"""


@query("E5_E6_complete_feature_matrix", _matrix_sql())
def _(spark, d):
    config = FeatureConfig(order="Units", store="Store", discount="Discount", holiday="Holiday", categorical=("Region",))
    matrix, fitted = features.fit_transform(views.store_day(spark, d), config)
    rows = features.complete_rows(matrix, fitted)
    return rounded(rows.select("Store", "Date", "Sales", *[F.col(f"`{c}`") for c in fitted.feature_columns]), 2)


# --- p-values ---------------------------------------------------------------------------------------


def _area(density, top: str, steps: int = 4000) -> str:
    """Area under a density from 0 to ``top`` by Simpson's rule."""
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"({top} / {steps}.0 / 3.0 * list_sum([({weight}) * {density(f'(i * {top} / {steps}.0)')} FOR i IN range(0, {steps + 1})]))"


def _t_p(t: str, v: str) -> str:
    front = f"lgamma(({v} + 1) / 2) - lgamma({v} / 2) - 0.5 * ln({v} * pi())"
    return f"(1 - 2 * {_area(lambda u: f'exp({front} - ({v} + 1) / 2 * ln(1 + {u} * {u} / {v}))', f'abs({t})')})"


def _f_p(f: str, a: str, b: str) -> str:
    front = f"lgamma(({a} + {b}) / 2) - lgamma({a} / 2) - lgamma({b} / 2) + {a} / 2 * ln({a} / {b})"
    return f"(1 - {_area(lambda u: f'exp({front} + ({a} / 2 - 1) * ln(greatest({u}, 1e-300)) - ({a} + {b}) / 2 * ln(1 + {a} * {u} / {b}))', f)})"


def _chi2_p(x: str, k: str) -> str:
    return f"(1 - {_area(lambda u: f'exp(({k} / 2 - 1) * ln(greatest({u}, 1e-300)) - {u} / 2 - {k} / 2 * ln(2.0) - lgamma({k} / 2))', x)})"


_SIDES = """SELECT Store, COUNT(CASE WHEN Discount = 'Yes' THEN 1 END)::DOUBLE AS n1, COUNT(CASE WHEN Discount <> 'Yes' THEN 1 END)::DOUBLE AS n0,
    AVG(CASE WHEN Discount = 'Yes' THEN Sales END) AS m1, AVG(CASE WHEN Discount <> 'Yes' THEN Sales END) AS m0,
    var_samp(CASE WHEN Discount = 'Yes' THEN Sales END) AS v1, var_samp(CASE WHEN Discount <> 'Yes' THEN Sales END) AS v0 FROM sales_fact GROUP BY Store"""


@query(
    "T1_T3_p_values_by_store",
    f"""WITH {S.SALES_FACT}, s AS ({_SIDES}),
        t AS (SELECT Store, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)) AS ts, n1 + n0 - 2 AS ds,
                     (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS tw, pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS dw FROM s WHERE n1 >= 5 AND n0 >= 5)
        SELECT Store, {rnd('ts', 6)} AS t_student, {rnd(_t_p('ts', 'ds'), 6)} AS p_student, {rnd('tw', 6)} AS t_welch, {rnd(_t_p('tw', 'dw'), 6)} AS p_welch FROM t""",
)
def _(spark, d):
    f = views.sales_fact(spark, d)
    out = stats.two_group_tests(f, ["Store"], fc.is_truthy(F.col("Discount"), fc.ANALYSIS_DISCOUNT_WORDS), "Sales")
    return rounded(out.select("Store", "t_student", "p_student", "t_welch", "p_welch"), 6)


@query(
    "T5_anova_p_value",
    f"""WITH {S.SALES_FACT}, p AS (SELECT Store AS g, COUNT(Sales) AS n, AVG(Sales) AS m, var_pop(Sales) AS v FROM sales_fact GROUP BY Store),
        gm AS (SELECT SUM(n * m) / SUM(n) AS grand FROM p), s AS (SELECT COUNT(*)::DOUBLE AS k, SUM(n)::DOUBLE AS n, SUM(n * (m - grand) * (m - grand)) AS b, SUM(n * v) AS w FROM p, gm),
        f AS (SELECT (b / (k - 1)) / (w / (n - k)) AS f, k - 1 AS a, n - k AS b FROM s)
        SELECT {rnd('f', 6)} AS f, {rnd(_f_p('f', 'a', 'b'), 6)} AS p FROM f""",
)
def _(spark, d):
    return rounded(stats.with_f_p(stats.anova(views.sales_fact(spark, d), "Store", "Sales")).select("f", "p"), 6)


@query(
    "T6_kruskal_p_value",
    f"""WITH {S.SALES_FACT}, r AS (SELECT Region, Sales, rank() OVER (ORDER BY Sales) + (COUNT(*) OVER (PARTITION BY Sales) - 1) / 2.0 AS k FROM sales_fact),
        g AS (SELECT Region, COUNT(*) AS n, AVG(k) AS mr FROM r GROUP BY Region), t AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM r),
        ties AS (SELECT SUM(c * c * c - c) AS s FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS c FROM r GROUP BY Sales)),
        h AS (SELECT SUM(12.0 / (t.n * (t.n + 1)) * g.n * (mr - (t.n + 1) / 2) * (mr - (t.n + 1) / 2)) / MAX(1 - s / (t.n * t.n * t.n - t.n)) AS h, COUNT(*) - 1.0 AS k FROM g, t, ties)
        SELECT {rnd('h', 6)} AS h, {rnd(_chi2_p('h', 'k'), 6)} AS p FROM h""",
)
def _(spark, d):
    return rounded(stats.with_h_p(stats.kruskal(views.sales_fact(spark, d), "Region", "Sales")).select("h", "p"), 6)


@query(
    "T8_correlation_p_value",
    f"""WITH {S.STORE_DAY}, r AS (SELECT Store, Region, corr(Tax, Sales) AS r, COUNT(*)::DOUBLE AS n FROM store_day WHERE Store = (SELECT MIN(Store) FROM store_day) GROUP BY Store, Region),
        t AS (SELECT r, n, r * sqrt((n - 2) / (1 - r * r)) AS t FROM r) SELECT {rnd('r', 6)} AS pearson, {rnd(_t_p('t', '(n - 2)'), 6)} AS p_pearson FROM t""",
)
def _(spark, d):
    days = views.store_day(spark, d)
    one = days.join(F.broadcast(days.agg(F.min("Store").alias("Store"))), "Store")
    return rounded(stats.with_correlation_p(stats.correlation_statistics(one, "Tax", "Sales")).select("pearson", "p_pearson"), 6)
