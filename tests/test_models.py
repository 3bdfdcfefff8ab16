"""Features, splits, models, evaluation and forecasts."""

import datetime as dt
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkdemand.operators import evaluate, features, forecast, models, split, tune
from sparkdemand.operators.features import FeatureConfig
from sparkdemand.sources import runs

CONFIG = FeatureConfig(order="Order", store="Store", discount="Discount", lags=(1, 7), rolling=(3, 7), categorical=("Kind",))
SMALL = {models.FOREST: {"numTrees": 5, "maxDepth": 4}, models.BOOSTED: {"maxIter": 3, "maxDepth": 3}}


def panel_frame(days=90, stores=("a", "b")):
    rng = np.random.default_rng(11)
    rows = []
    for s in stores:
        for i in range(days):
            order = 20 + 5 * (i % 7) + rng.integers(0, 5)
            rows.append((dt.date(2024, 1, 1) + dt.timedelta(i), s, "k" + s, float(order), float(order * 3 + rng.normal(0, 2)), "Yes" if i % 9 == 0 else "No", 15.0 + i % 4))
    return pd.DataFrame(rows, columns=["Date", "Store", "Kind", "Order", "Sales", "Discount", "Temperature"])


@pytest.fixture(scope="module")
def panel(spark):
    pdf = panel_frame()
    df = spark.createDataFrame(pdf, "Date date, Store string, Kind string, Order double, Sales double, Discount string, Temperature double")
    return pdf, df.cache()


@pytest.fixture(scope="module")
def fitted(panel):
    _, df = panel
    matrix, config = features.fit_transform(df, CONFIG)
    rows = features.complete_rows(matrix, config).cache()
    parts = split.chronological_split(rows)
    names = (models.NAIVE, models.RIDGE, models.FOREST, models.BOOSTED)
    return config, rows, parts, models.train_models(parts.train, parts.val, parts.test, config.feature_columns, "Sales", names, SMALL, ("Date", "Store"))


def test_lags_and_rolling_equal_grouped_shifts(panel, fitted):
    pdf, df = panel
    got = features.transform(df, fitted[0]).orderBy("Store", "Date").toPandas()
    by = pdf.groupby("Store")["Sales"]
    np.testing.assert_allclose(got.lag_7_Sales, by.shift(7))
    past = by.transform(lambda s: s.shift(1).rolling(3, min_periods=1).std()).fillna(0.0)
    np.testing.assert_allclose(got.rolling_Sales_3_std, past, atol=1e-9)
    np.testing.assert_allclose(got.rolling_Sales_7_max, by.transform(lambda s: s.shift(1).rolling(7, min_periods=1).max()))
    growth = (by.shift(1) - by.shift(7)) / by.shift(7).abs()
    np.testing.assert_allclose(got.sales_growth_lag, growth)
    assert set(got.Kind_ka + got.Kind_kb) == {1} and got.Discount_Flag.sum() == (pdf.Discount == "Yes").sum()


def test_inputs_leave_out_target_orders_and_keys(fitted):
    names = fitted[0].feature_columns
    assert not {"Sales", "Order", "Store", "Kind", "Discount", "Date"} & set(names)
    assert {"Temperature", "Discount_Flag", "Kind_ka", "lag_1_aov"} <= set(names)
    assert FeatureConfig.from_json(fitted[0].to_json()) == fitted[0]


def test_unseen_level_gives_zeros(spark, fitted):
    df = spark.createDataFrame([("zz",), (None,)], "Kind string")
    cols = features.one_hot_columns(fitted[0].levels, df.columns)
    assert [tuple(r) for r in df.select(*cols.values()).collect()] == [(0, 0), (0, 0)]


def test_no_feature_sees_the_current_or_a_later_target(panel, fitted):
    changed = features.leakage_violations(panel[1], fitted[0], dt.date(2024, 2, 20)).collect()
    assert len(changed) == len(fitted[0].feature_columns) and all(r.changed == 0 for r in changed)


def test_vif(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 200))
    pdf = pd.DataFrame({"a": a, "b": a + 0.5 * b, "c": rng.normal(size=200), "d": 2 * a})
    df = spark.createDataFrame(pdf)
    r = np.linalg.inv(np.corrcoef(pdf[["a", "b", "c"]].T))
    got = {x.Feature: x.VIF for x in features.variance_inflation(df, ["a", "b", "c"]).collect()}
    assert got == pytest.approx({"a": r[0, 0], "b": r[1, 1], "c": r[2, 2]})
    whole = {x.Feature: (x.VIF, x.Interpretation) for x in features.variance_inflation(df, ["a", "b", "c", "d"]).collect()}
    assert whole["a"][0] == whole["d"][0] == float("inf") and whole["c"][1] == "Safe"
    plain = {x.Feature: x.VIF for x in features.variance_inflation(df, ["a", "c"], intercept=False).collect()}
    g = pdf[["a", "c"]].to_numpy()
    g = g / np.sqrt((g**2).sum(0))
    assert plain["a"] == pytest.approx(np.linalg.inv(g.T @ g)[0, 0])


def test_split_partitions_rows_in_time_order(fitted):
    _, rows, parts, _ = fitted
    sizes = [p.count() for p in (parts.train, parts.val, parts.test)]
    assert sum(sizes) == rows.count()
    edges = [p.agg(F.min("Date"), F.max("Date")).first() for p in (parts.train, parts.val, parts.test)]
    assert edges[0][1] < edges[1][0] and edges[1][1] < edges[2][0]


def test_few_dates_split_by_position_with_copies(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1)] * 14 + [(dt.date(2024, 1, 2), i) for i in range(6)], "Date date, v int")
    parts = split.chronological_split(df)
    got = [Counter(tuple(r) for r in p.collect()) for p in (parts.train, parts.val, parts.test)]
    assert [sum(c.values()) for c in got] == [14, 3, 3]
    assert got[0] == {(dt.date(2024, 1, 1), 1): 14} and sum(got, Counter()) == Counter(tuple(r) for r in df.collect())


def test_fold_bounds():
    assert split.fold_bounds(10, 3) == [(4, 6), (6, 8), (8, 10)]
    with pytest.raises(ValueError):
        split.fold_bounds(3, 3)


def test_ridge_equals_closed_form(fitted):
    config, _, parts, result = fitted
    cols = list(config.feature_columns)
    train, test = (p.toPandas() for p in (parts.train, result.test))
    x, y = train[cols].fillna(0).to_numpy(float), train.Sales.to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(len(cols)), xc.T @ yc)
    want = np.maximum(0, (test[cols].fillna(0).to_numpy(float) - x.mean(0)) @ w + y.mean())
    np.testing.assert_allclose(test[result.prediction_cols[models.RIDGE]], want, rtol=1e-7)


def test_tree_models_beat_naive(fitted):
    board = {r.Model: r.Accuracy_Pct for r in evaluate.leaderboard(fitted[3].test, "Sales", fitted[3].prediction_cols).collect()}
    assert board[models.FOREST] > board[models.NAIVE] and board[models.RIDGE] > board[models.NAIVE]
    assert fitted[3].test.where(F.col(fitted[3].prediction_cols[models.BOOSTED]) < 0).count() == 0


def test_same_seed_same_forest(fitted):
    config, _, parts, result = fitted
    again = models.train_models(parts.train, parts.val, parts.test, config.feature_columns, "Sales", (models.FOREST,), SMALL, ("Date", "Store"))
    col = result.prediction_cols[models.FOREST]
    a, b = (r.test.orderBy("Store", "Date").toPandas()[col] for r in (result, again))
    np.testing.assert_array_equal(a, b)


def test_metrics_of_four_pairs(spark):
    df = spark.createDataFrame([(100.0, 90.0), (200.0, 210.0), (300.0, 310.0), (400.0, 380.0), (None, 1.0)], "y double, p double")
    m = evaluate.regression_metrics(df, "y", "p").first()
    assert (m.WAPE_Pct, m.WAPE_Accuracy_Pct, m.MAE, m.MSE) == (5.0, 95.0, 12.5, 175.0)
    none = evaluate.regression_metrics(df.where("y is null"), "y", "p").first()
    assert tuple(none) == (0.0,) * 7
    assert [r.metric for r in evaluate.metric_cards(evaluate.regression_metrics(df, "y", "p")).orderBy("pos").collect()][0].startswith("WAPE")


def test_importances_sum_to_hundred(spark, fitted):
    config, _, _, result = fitted
    rows = evaluate.importance_table(spark, config.feature_columns, result.models[models.FOREST].weights(), 100).collect()
    assert sum(r.Importance_Pct for r in rows) == pytest.approx(100, abs=0.5)


@pytest.mark.parametrize("period,steps", [("1 Month", (30, 4, 1, 4)), ("3 Months", (90, 13, 3, 13)), ("6 Months", (180, 26, 6, 26)), ("x", (30, 4, 6, 6))])
def test_horizons(period, steps):
    assert tuple(forecast.horizon_for(period, f) for f in ("Daily", "Weekly", "Monthly", "Irregular")) == steps


@pytest.mark.parametrize("freq,alias", [("Weekly", "W"), ("Monthly", "MS"), ("Daily", "D")])
def test_future_dates_follow_calendar_rules(spark, freq, alias):
    last = [dt.date(2023, 1, 25) + dt.timedelta(i) for i in range(70)]
    got = spark.createDataFrame([(d,) for d in last], "d date").select("d", forecast.future_dates(F.col("d"), 3, freq)).collect()
    step = {"W": pd.Timedelta(days=7), "MS": pd.DateOffset(months=1), "D": pd.Timedelta(days=1)}[alias]
    for d, dates in got:
        assert dates == [x.date() for x in pd.date_range(pd.Timestamp(d) + step, periods=3, freq=alias)]


@pytest.mark.parametrize("name", [models.NAIVE, models.RIDGE, models.FOREST, models.BOOSTED])
def test_forecast_equals_step_by_step_recursion(spark, panel, fitted, name):
    """Append one row per series, rebuild all features, predict, write back - and compare."""
    config, _, _, result = fitted
    _, df = panel
    model, history = result.models[name], df
    for _ in range(3):
        last = history.groupBy("Store").agg(F.max_by(F.struct(*df.columns), "Date").alias("r")).select("r.*")
        new = last.withColumns({"Date": F.date_add("Date", 1), "Sales": F.lit(None).cast("double"), "Order": F.lit(None).cast("double")})
        matrix = features.transform(history.unionByName(new), config).join(new.select("Store", F.col("Date").alias("_d")), "Store")
        step = model.transform(matrix.where("Date = _d").drop("_d"), "p").select("Store", "p")
        history = history.unionByName(new.drop("Sales").join(step, "Store").withColumnRenamed("p", "Sales").select(*df.columns))
        history = spark.createDataFrame(history.toPandas(), df.schema)
    want = history.where(F.col("Date") > dt.date(2024, 3, 30)).orderBy("Store", "Date").toPandas().Sales.round(2)
    got = forecast.recursive_forecast(df, config, model, 3).orderBy("Store", "Date").toPandas()
    np.testing.assert_allclose(got.Forecasted_Sales, want, atol=0.011)
    assert list(got.step) == [1, 2, 3, 1, 2, 3]


def test_one_series_alone_forecasts_the_same(panel, fitted):
    config, _, _, result = fitted
    run = lambda d: forecast.recursive_forecast(d, config, result.models[models.FOREST], 5).where("Store = 'a'").orderBy("step").collect()
    assert run(panel[1]) == run(panel[1].where("Store = 'a'"))


def test_scenario_changes_the_flag(panel, fitted):
    config, _, _, result = fitted
    ridge = result.models[models.RIDGE]
    base = forecast.recursive_forecast(panel[1], config, ridge, 3).toPandas().Forecasted_Sales
    promo = forecast.recursive_forecast(panel[1], config, ridge, 3, scenario={"Discount": "Yes"}).toPandas().Forecasted_Sales
    assert (base - promo).abs().max() > 0


def test_forecast_summary_trends(spark):
    mk = lambda xs: spark.createDataFrame([(i + 1, dt.date(2024, 2, 1) + dt.timedelta(i), float(x)) for i, x in enumerate(xs)], "step int, Date date, Forecasted_Sales double")
    hist = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(i), 10.0) for i in range(5)], "Date date, Sales double")
    up = forecast.forecast_summary(mk([11, 12, 12]), hist).first()
    assert (up.trend, up.recent_actual_total, up.peak_period) == ("Increasing", 30.0, dt.date(2024, 2, 2))
    assert forecast.forecast_summary(mk([10, 10, 10]), hist).first().trend == "Stable"
    assert forecast.forecast_summary(mk([10, 9, 8])).first().trend == "Decreasing"
    assert forecast.forecast_summary(mk([1] * 6), hist).first().recent_actual_total == 0.0
    checks = forecast.forecast_checks(mk([1, 2]), 3).first()
    assert not checks.ok and checks.invalid == 0


def test_two_stage(panel, fitted):
    _, _, parts, _ = fitted
    inputs = ["weekday", "lag_1_Order", "lag_7_Order", "lag_1_Sales"]
    model = models.fit_two_stage(parts.train, inputs, inputs)
    row = models.two_stage_errors(model, parts.val).first()
    assert 0 < row.orders_mae < 10 and 0 < row.sales_mae < 30 and model.sales.feature_cols[-1] == "pred_orders"


def test_search_is_repeatable(fitted):
    config, rows, _, _ = fitted
    run = lambda: tune.tune_model(rows, config.feature_columns, "Sales", models.RIDGE, 3, 2, tie=["Store"])
    a, b = run(), run()
    assert a.status == "success" and a.best_params == b.best_params and a.trials.count() == 3
    assert tune.tune_model(rows.limit(5), config.feature_columns, model=models.RIDGE).status == "error"


def test_saved_runs(spark, tmp_path, panel, fitted):
    config, _, _, result = fitted
    root = str(tmp_path / "runs")
    kept = {k: result.models[k] for k in (models.NAIVE, models.FOREST)}
    runs.save_run(spark, root, config, kept, "My Data.csv", result.times, now=1_700_000_000)
    runs.save_run(spark, root, config, {}, "A later one", {}, now=1_700_000_100)
    assert [r.Run_ID for r in runs.list_runs(spark, root).collect()] == ["A_later_one_1700000100", "My_Data_csv_1700000000"]
    latest = runs.load_latest(spark, root, "My Data.csv")
    assert latest["config"] == config and runs.load_latest(spark, root, "nothing") is None
    a, b = (forecast.recursive_forecast(panel[1], config, m, 2).collect() for m in (latest["models"][models.FOREST], kept[models.FOREST]))
    assert a == b


def test_scenarios_on_unknown_columns_are_refused(panel, fitted):
    config, _, _, result = fitted
    with pytest.raises(ValueError, match="Nothing"):
        forecast.recursive_forecast(panel[1], config, result.models[models.RIDGE], 2, scenario={"Nothing": 1})


@pytest.mark.parametrize("name", [models.RIDGE, models.FOREST])
def test_orders_are_carried(panel, fitted, name):
    config, _, parts, result = fitted
    inputs = ["weekday", "lag_1_Order", "lag_7_Order"]
    orders = models.fit_model(name, parts.train, inputs, "Order", SMALL.get(name))
    ahead = lambda **kw: forecast.recursive_forecast(panel[1], config, result.models[name], 9, with_orders=True, **kw).orderBy("Store", "step").toPandas()
    none, carried, fixed = ahead(), ahead(orders=orders), ahead(scenario={"Order": 30.0})
    assert not none.Orders_Carried.any() and none.Orders.isna().all()
    assert carried.Orders_Carried.all() and carried.Orders.between(10, 70).all() and carried.Orders.nunique() > 3
    assert fixed.Orders.eq(30.0).all() and not np.allclose(fixed.Forecasted_Sales, none.Forecasted_Sales)
    # The first step uses known orders only, so what is carried does not change it.
    assert carried[carried.step == 1].Forecasted_Sales.tolist() == none[none.step == 1].Forecasted_Sales.tolist()


def test_forecasts_are_rounded_once(spark):
    # 10 and 0.149, repeated: to one digit that is 0.1, by way of two digits 0.15 and 0.2.
    df = spark.createDataFrame([(dt.date(2024, 1, 1 + i), 10.0 if i % 2 == 0 else 0.149, 7.046) for i in range(8)], "Date date, Sales double, Order double")
    config = FeatureConfig(order="Order", lags=(2,), rolling=(), feature_columns=("lag_2_Sales",))
    ahead = lambda **kw: forecast.recursive_forecast(df, config, models.naive_model("lag_2_Sales"), 2, scenario={"Order": 7.046}, with_orders=True, **kw).orderBy("step").collect()
    assert [(r.Forecasted_Sales, r.Orders) for r in ahead()] == [(10.0, 7.05), (0.15, 7.05)]
    assert [(r.Forecasted_Sales, r.Orders) for r in ahead(digits=None)] == [(10.0, 7.046), (0.149, 7.046)]
    assert [(r.Forecasted_Sales, r.Orders) for r in ahead(digits=1)] == [(10.0, 7.0), (0.1, 7.0)]


@pytest.mark.parametrize("name", [models.RIDGE, models.FOREST])
def test_sparse_categories(spark, panel, fitted, name):
    _, df = panel
    config = FeatureConfig(order=None, store="Store", lags=(1,), rolling=(), feature_columns=("lag_1_Sales",))
    rows = features.transform(df.withColumn("Kind", F.concat("Kind", F.dayofweek("Date").cast("string"))), config).dropna(subset=["lag_1_Sales"])
    sparse = models.fit_model(name, rows, ["lag_1_Sales"], "Sales", SMALL.get(name), categories=["Kind"])
    wide = rows.withColumns(features.one_hot_columns(features.category_levels(rows, ["Kind"]), rows.columns))
    names = [c for c in wide.columns if c.startswith("Kind_")]
    dense = models.fit_model(name, wide, ["lag_1_Sales", *names], "Sales", SMALL.get(name))
    assert sparse.categories == ("Kind",) and len(names) == 14 and len(sparse.weights()) == 15
    both = dense.transform(sparse.transform(wide, "a"), "b").toPandas()
    np.testing.assert_allclose(both.a, both.b, rtol=1e-5)
    ahead = forecast.recursive_forecast(df.withColumn("Kind", F.concat("Kind", F.lit("3"))), config, sparse, 2)
    assert ahead.count() == 4 and ahead.where("Forecasted_Sales > 0").count() == 4
    unseen = sparse.transform(spark.createDataFrame([(5.0, "zz"), (5.0, None)], "lag_1_Sales double, Kind string"), "p").collect()
    assert len(unseen) == 2 and unseen[0].p == unseen[1].p


def test_sparse_levels_number_the_level_table(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("b",)], "k string")
    levels = features.level_table(df, "k")
    assert {(r.level, r.position) for r in levels.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    got = {r.k: tuple(r.v.toArray()) for r in features.with_sparse_levels(df, levels.where("level <> 'c'"), "k", "v").collect()}
    assert got == {"a": (1.0, 0.0), "b": (0.0, 1.0), "c": (0.0, 0.0), None: (0.0, 0.0)}
    first = {r.k: tuple(r.v.toArray()) for r in features.with_sparse_levels(df, levels, "k", "v", drop_first=True).collect()}
    assert first == {"a": (0.0, 0.0), "b": (1.0, 0.0), "c": (0.0, 1.0), None: (0.0, 0.0)}


def test_ridge_sums_equal_the_fitted_model(fitted):
    from sparkdemand.operators import ridge

    config, _, parts, result = fitted
    m = ridge.fit_ridge(parts.train, config.feature_columns, "Sales", 1.0)
    both = result.models[models.RIDGE].transform(parts.test, "a").withColumn("b", F.greatest(F.lit(0.0), m.prediction())).toPandas()
    np.testing.assert_allclose(both.a, both.b, rtol=1e-5)


def test_tails_equal_published_values(spark):
    from sparkdemand.functions import special, tails

    x, a, b = F.col("x"), F.col("a"), F.col("b")
    cases = [(2.228, 10.0, 1.0), (1.96, 1e6, 1.0), (-3.0, 4.0, 1.0), (0.0, 7.0, 1.0), (4.96, 1.0, 10.0), (3.84, 1.0, 59999.0), (18.307, 10.0, 2.0), (0.5, 24.0, 6e5), (1.3, 24.0, 6e5)]
    df = spark.createDataFrame(cases, "x double, a double, b double")
    for column, scalar in (
        (tails.t_tail(x, a), lambda x, a, b: special.t_tail(x, a)),
        (tails.f_tail(x, a, b), special.f_tail),
        (tails.chi2_tail(F.abs(x), a), lambda x, a, b: special.chi2_tail(abs(x), a)),
    ):
        got = [r.p for r in df.select(column.alias("p")).collect()]
        np.testing.assert_allclose(got, [scalar(*c) for c in cases], atol=2e-9)
    known = spark.range(1).select(tails.t_tail(F.lit(2.228), F.lit(10.0)), tails.f_tail(F.lit(4.965), F.lit(1.0), F.lit(10.0)), tails.chi2_tail(F.lit(18.307), F.lit(10.0))).first()
    assert [round(p, 3) for p in known] == [0.05, 0.05, 0.05]


def test_sparse_levels_keep_no_name_per_level_and_sum_as_rows(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("b",)], "k string")
    encoded = features.with_sparse_levels(df, features.level_table(df, "k"), "k", "v")
    assert encoded.schema["v"].metadata == {"ml_attr": {"num_attrs": 3}}
    assert {(r.at, r.n) for r in features.sparse_sums(encoded, "v", "at", "n").collect()} == {(0, 1.0), (1, 2.0), (2, 1.0)}


def test_training_pieces_follow_the_rows_not_the_session(spark):
    rows = spark.range(300).select(F.col("id").alias("Date"))
    width = spark.conf.get("spark.sql.shuffle.partitions")
    dealt = []
    try:
        for n in ("8", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            held = models.dealt_rows(rows, ("Date",)).persist()
            dealt.append(held.select("Date", F.spark_partition_id().alias("p")).rdd.glom().collect())
            held.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert len(dealt[0]) == len(dealt[1]) == models.LEAST_PIECES and dealt[0] == dealt[1]
