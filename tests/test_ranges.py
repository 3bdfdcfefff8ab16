"""Windows in ranges against pandas on the whole series, with hot keys, short ranges, ties and nulls."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkdemand.operators import clean, eda, features, forecast, order, ranges, split, stats


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    n = 700
    key = np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({"k": key, "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.permutation(n), unit="s"), "x": rng.normal(size=n).round(3)})
    return spark.createDataFrame(pdf).repartition(5).persist(), pdf.sort_values("t").reset_index(drop=True)


def by_time(df):
    return df.toPandas().sort_values("t").reset_index(drop=True)


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("depth", [1, 5, 400])
def test_lags_and_sums_over_ranges(series, keys, depth):
    df, pdf = series
    made = ranges.sliding(df, keys, ["t"], depth, lambda w: {"lag": F.lag("x", depth).over(w), "sum": F.sum("x").over(w.rowsBetween(-depth, -1))})
    got = by_time(made)
    groups = pdf.groupby("k")["x"] if keys else pdf["x"]
    lag = groups.shift(depth)
    past = groups.transform(lambda s: s.shift(1).rolling(depth, min_periods=1).sum()) if keys else pdf["x"].shift(1).rolling(depth, min_periods=1).sum()
    assert made.columns == ["k", "t", "x", "lag", "sum"] and len(got) == len(pdf)
    np.testing.assert_allclose(got["lag"].astype(float), lag)
    np.testing.assert_allclose(got["sum"].astype(float), past, atol=1e-9)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_positions(series, keys):
    df, pdf = series
    got = by_time(ranges.with_positions(df, keys, ["t"], "i", "n"))
    want = pdf.groupby("k").cumcount() if keys else pd.Series(range(len(pdf)))
    count = pdf.groupby("k")["x"].transform("size") if keys else pd.Series([len(pdf)] * len(pdf))
    assert got["i"].tolist() == want.tolist() and got["n"].tolist() == count.tolist()


def test_a_hot_key_spreads_over_ranges(series):
    df, _ = series
    r = ranges.deal(df, ["k"], ["t"])
    hot = r.segments.where("k = 'hot'").collect()
    assert len(hot) > 3 and max(s["_rows"] for s in hot) < 400
    spanning = r.segments.where("_rows < _all").count()
    assert spanning <= 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def test_series_shorter_than_the_ranges_and_empty(spark):
    rows = [("a", 3, 1.0), ("a", 1, 2.0), ("b", 2, 3.0), (None, 5, 4.0), (None, 4, 5.0)]
    df = spark.createDataFrame(rows, "k string, t long, x double")
    made = ranges.sliding(df, ["k"], ["t"], 3, lambda w: {"lag": F.lag("x", 1).over(w)})
    assert {(r.k, r.t, r.lag) for r in made.collect()} == {("a", 1, None), ("a", 3, 2.0), ("b", 2, None), (None, 4, None), (None, 5, 5.0)}
    nothing = ranges.sliding(df.where("false"), [], ["t"], 3, lambda w: {"lag": F.lag("x", 1).over(w)})
    assert nothing.count() == 0 and ranges.with_positions(df.where("false"), [], ["t"], "i").count() == 0


def test_rolling_means_and_trend_by_stamp(series):
    df, pdf = series
    got = by_time(eda.with_trend(eda.with_rolling_means(df.select("t", "x"), "t", "x"), "t", "x"))
    np.testing.assert_allclose(got["Rolling_Mean_Fast"], pdf["x"].rolling(7, min_periods=1).mean(), atol=1e-9)
    np.testing.assert_allclose(got["Rolling_Mean_Slow"], pdf["x"].rolling(30, min_periods=1).mean(), atol=1e-9)
    a, b = np.polyfit(range(len(pdf)), pdf["x"], 1)
    np.testing.assert_allclose(got["Trend_Line"], b + a * np.arange(len(pdf)), atol=1e-9)


def test_stamps_and_dates_give_the_same_features(spark):
    days = pd.date_range("2024-01-01", periods=60)
    pdf = pd.DataFrame({"Store": ["s"] * 60, "Date": days, "Sales": np.arange(60.0) ** 1.5})
    stamps = spark.createDataFrame(pdf)
    config = features.FeatureConfig(order=None, store="Store")
    one, two = (features.transform(f, config).withColumn("Date", F.col("Date").cast("date")).toPandas() for f in (stamps, stamps.withColumn("Date", F.col("Date").cast("date"))))
    names = sorted(one.columns)
    pd.testing.assert_frame_equal(one.sort_values("Date")[names].reset_index(drop=True), two.sort_values("Date")[names].reset_index(drop=True))


def test_recent_total_and_cuts_by_stamp(series, spark):
    df, pdf = series
    steps = spark.range(1).select(F.lit(40).alias("h"))
    assert forecast.recent_total(df, steps, "x", "t").first()[0] == pytest.approx(pdf["x"].tail(40).sum())
    n, a, b = split.split_cuts(df, "t", 0.7, 0.15)
    assert (n, pd.Timestamp(a), pd.Timestamp(b)) == (len(pdf), pdf["t"][int(n * 0.7)], pdf["t"][int(n * 0.85)])


@pytest.mark.parametrize("hot", [0.0, 0.6, 1.0])
def test_mid_ranks_with_a_hot_value(spark, hot):
    rng = np.random.default_rng(8)
    n = 500
    x = np.where(rng.random(n) < hot, 5.0, rng.integers(0, 12, n))
    pdf = pd.DataFrame({"x": x, "y": rng.normal(size=n), "w": rng.integers(1, 4, n)})
    got = ranges.with_mid_ranks(spark.createDataFrame(pdf).repartition(4), "x", "y", "w", "r").toPandas().sort_values("y")
    whole = pdf.loc[pdf.index.repeat(pdf["w"])]
    want = whole["x"].rank().groupby(level=0).first()
    np.testing.assert_allclose(got["r"].to_numpy(), want[pdf.sort_values("y").index].to_numpy())
    rho = eda.spearman(spark.createDataFrame(pdf), "x", "y").first()
    if hot < 1:
        assert rho.spearman == pytest.approx(pdf["x"].rank().corr(pdf["y"].rank()))
    else:
        assert rho.spearman is None


def test_kruskal_with_a_hot_value(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": rng.choice(list("abc"), 300), "x": np.where(rng.random(300) < 0.5, 1.0, rng.normal(size=300))})
    row = stats.kruskal(spark.createDataFrame(pdf), "g", "x").first()
    r = pdf["x"].rank()
    n, per = len(pdf), r.groupby(pdf["g"]).agg(["mean", "size"])
    raw = 12 / (n * (n + 1)) * (per["size"] * (per["mean"] - (n + 1) / 2) ** 2).sum()
    c = pdf["x"].value_counts()
    assert row.h == pytest.approx(raw / (1 - (c**3 - c).sum() / (n**3 - n)))


def test_fill_of_one_hot_entity(series):
    df, pdf = series
    holes = df.withColumn("v", F.when(F.pmod(F.hash("x"), F.lit(4)) == 0, F.col("x")))
    want = by_time(holes)
    want["v"] = want.groupby("k")["v"].transform(lambda s: s.astype(float).ffill().bfill())
    got = by_time(clean.fill_along_time(holes, ["v"], ["k"], "t", ["x"]))
    np.testing.assert_allclose(got["v"].astype(float), want["v"].astype(float))


def test_row_index_orders_ties_by_the_tie_break(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(200)], "g long, id long")
    got = order.with_row_index(df, "g", ["id"]).orderBy("row_index").collect()
    assert [(r.g, r.id, r.row_index) for r in got] == [(g, i, p) for p, (g, i) in enumerate(sorted((i % 3, i) for i in range(200)))]
