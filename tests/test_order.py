import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkdemand.operators import clean, order


@pytest.fixture
def frame(spark):
    rng = np.random.default_rng(7)
    n = 600
    pdf = pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n)),
            "x": np.where(rng.random(n) < 0.3, 0.0, rng.normal(10, 5, n).round(1)),
            "id": rng.permutation(n),
        }
    )
    return pdf, spark.createDataFrame(pdf).cache()


def test_quantiles_equal_linear_interpolation(frame):
    pdf, df = frame
    probs = {"q1": ("x", 0.25), "q2": ("x", 0.5), "q9": ("x", 0.9)}
    got = order.agg_with_quantiles(df, ["g"], [F.count(F.lit(1)).alias("n")], probs).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert got.loc[g, "n"] == len(part)
        np.testing.assert_allclose(got.loc[g, ["q1", "q2", "q9"]].astype(float), part.x.quantile([0.25, 0.5, 0.9]), rtol=1e-12)


def test_global_quantile_and_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", None)], "g string, x double")
    one = order.exact_quantiles(df, "x", [0.5]).first()
    assert one["q_0"] == 3.0
    per = {r["g"]: r["q_0"] for r in order.exact_quantiles(df, "x", [0.5], ["g"]).collect()}
    assert per == {None: 2.0, "a": 5.0}


def test_value_ranges_are_monotone(frame):
    _, df = frame
    rows = order.with_value_range(df, "x", 17).select("x", "_range").distinct().orderBy("x").collect()
    ranges = [r["_range"] for r in rows]
    assert ranges == sorted(ranges) and len(set(ranges)) > 5


def test_mid_ranks(frame):
    pdf, df = frame
    got = {r["_v"]: r["rank"] for r in order.mid_ranks(df, "x").collect()}
    want = dict(zip(pdf.x, pdf.x.rank(), strict=True))
    assert got == pytest.approx(want)


def test_row_index_with_hot_key(frame):
    pdf, df = frame
    got = order.with_row_index(df, "g", ["id"]).orderBy("row_index").toPandas()
    want = pdf.sort_values(["g", "id"])
    assert list(got.row_index) == list(range(len(pdf)))
    assert list(got.id) == list(want.id)


def test_repeat_rows(spark):
    df = spark.createDataFrame([("a", 5), ("b", 0), ("c", 2)], "k string, t long")
    assert sorted(r.k for r in order.repeat_rows(df, "t", block=2).collect()) == list("aaaaacc")


@pytest.mark.parametrize("text_tie", [False, True])
def test_fill_matches_forward_then_backward_fill(spark, text_tie):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"s": rng.choice(["hot", "hot", "hot", "b", "empty"], n), "d": rng.integers(0, 6, n), "k": rng.permutation(n)})
    if text_tie:
        pdf["k"] = pdf.k.map(lambda k: f"{k:05d}")
    pdf["v"] = np.where((rng.random(n) < 0.7) | (pdf.s == "empty"), np.nan, rng.normal(size=n).round(3))
    pdf = pdf.sort_values(["s", "d", "k"])
    want = pdf.groupby("s")["v"].transform(lambda x: x.ffill().bfill())
    df = spark.createDataFrame(pdf.astype({"d": int})).selectExpr("s", "date_add(date'2024-01-01', int(d)) AS d", "k", "nanvl(v, null) AS v")
    got = clean.fill_along_time(df, ["v"], ["s"], "d", ["k"]).toPandas().set_index("k").loc[pdf.k, "v"]
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float))
