"""The report of all tests: few passes over its rows, and the same numbers whatever rows a test leaves out."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkdemand.operators import order, ranges, stats


def _kruskal(values, groups):
    """H with tie correction and the number of groups with five rows, as on paper."""
    sizes = groups.value_counts()
    kept = values.notna() & groups.isin(sizes[sizes >= 5].index)
    x, g = values[kept], groups[kept]
    n, ranks, ties = len(x), x.rank(), x.value_counts()
    h = 12 / (n * (n + 1)) * sum(r.sum() ** 2 / len(r) for _, r in ranks.groupby(g)) - 3 * (n + 1)
    return h / (1 - (ties**3 - ties).sum() / (n**3 - n)), g.nunique()


def _sales(hot, copies, seed=3):
    """Skewed sales, orders and two groupings; one of the groups is too small, and orders and groups have nulls."""
    rng = np.random.default_rng(seed)
    n = 600
    pdf = pd.DataFrame({"Sales": np.where(rng.random(n) < hot, 7.0, rng.lognormal(3, 1, n)), "Units": rng.integers(1, 9, n) + rng.random(n)})
    pdf["Store"], pdf["Region"] = rng.choice(["a", "b", "c"], n), rng.choice(["n", "s"], n)
    pdf["Discount"], pdf["Holiday"] = rng.choice(["Yes", "No"], n), rng.choice(["1", "0"], n)
    pdf.loc[:2, "Store"] = "tiny"
    pdf.loc[10:30, "Region"] = None
    pdf.loc[50:60, "Units"] = np.nan
    return pd.concat([pdf] * copies, ignore_index=True) if copies > 1 else pdf


@pytest.mark.parametrize(("hot", "copies", "whole"), [(0.0, 1, True), (0.4, 1, False), (0.4, 6, True), (0.0, 6, False)])
def test_report_numbers(spark, hot, copies, whole):
    pdf = _sales(hot, copies)
    if whole:  # every test uses every row, so that they share the ranks
        pdf = pdf.fillna({"Region": "n", "Units": 4.0}).replace({"Store": "tiny"}, "a")
    df = spark.createDataFrame(pdf).repartition(3)
    found = {r.test_id: r for r in stats.run_tests(df, "Sales", "Units", "Discount", "Holiday", ["Store", "Region"]).collect()}
    for g in ("Store", "Region"):
        h, k = _kruskal(pdf["Sales"], pdf[g])
        row = found[f"{g}_variation"]
        assert row.test_used == "Kruskal-Wallis H-Test" and row.statistic == pytest.approx(h, abs=6e-5)
        assert row.summary.startswith(f"Evaluated {k} ")
    both = pdf.dropna(subset=["Sales", "Units"])
    rho, row = both["Sales"].rank().corr(both["Units"].rank()), found["orders_sales_correlation"]
    assert row.test_used == "Spearman Rank Correlation" and row.statistic == pytest.approx(rho, abs=6e-5)
    assert f"Pearson r = {both['Sales'].corr(both['Units']):+.4f}" in row.summary and f"over {len(both):,} pairs" in row.summary


def test_report_takes_few_passes(spark):
    """Each Levene read the rows seven times and more, each rank test sorted them anew: 533 stages before."""
    df = spark.createDataFrame(_sales(0.0, 1)).repartition(3)
    group = "report passes"
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert stats.run_tests(df, "Sales", "Units", "Discount", "Holiday", ["Store", "Region"]).count() == 5
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        assert len(stages) < 300
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("hot", [0.0, 0.6, 1.0])
@pytest.mark.parametrize("weight", [None, "w"])
def test_ranks_of_rows(spark, hot, weight):
    rng = np.random.default_rng(4)
    n = 800
    x = np.where(rng.random(n) < hot, 5.0, np.where(rng.random(n) < 0.3, rng.integers(-3, 9, n), rng.normal(3, 9, n)))
    pdf = pd.DataFrame({"x": x, "y": np.arange(n), "w": rng.integers(1, 4, n)})
    df = spark.createDataFrame(pdf).repartition(4)
    cuts = ranges.cuts_of(df.agg(ranges.cut_sketch(df, "x")).first()[0])
    got = ranges.with_ranks(df, "x", "r", "c", cuts, weight).toPandas().sort_values("y")
    rows = pdf.loc[pdf.index.repeat(pdf["w"] if weight else 1)]
    np.testing.assert_allclose(got["r"].to_numpy(), rows["x"].rank().groupby(level=0).first().to_numpy())
    np.testing.assert_allclose(got["c"].to_numpy(), rows.groupby("x")["x"].transform("size").groupby(level=0).first().to_numpy())
    assert ranges.with_ranks(df, "x", "r", "c", ranges.Cuts((), ())).orderBy("y").toPandas()["r"].tolist() == pdf["x"].rank().tolist()
    empty = df.where("false")
    assert ranges.with_ranks(empty, "x", "r", "c", ranges.cuts_of(empty.agg(ranges.cut_sketch(empty, "x")).first()[0])).count() == 0


def test_medians_of_rows(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 900, p=[0.6, 0.3, 0.1]), "x": rng.normal(size=900).round(2)})
    pdf.loc[pdf.g == "c", "x"] += 100
    pdf.loc[pdf.g == "b", "x"] = np.where(rng.random((pdf.g == "b").sum()) < 0.5, 2.0, 3.0)
    df = spark.createDataFrame(pdf).repartition(4)
    for cuts in (ranges.cuts_of(df.agg(ranges.cut_sketch(df, "x")).first()[0]), ranges.Cuts((0.0, 50.0), ()), ranges.Cuts((), ())):
        got = {r["g"]: r["q_0"] for r in ranges.medians(df, "g", "x", cuts).collect()}
        assert got == pytest.approx(pdf.groupby("g")["x"].median().to_dict())
    assert got == pytest.approx({r["g"]: r["q_0"] for r in order.exact_quantiles(df, "x", [0.5], ["g"]).collect()})
    assert ranges.medians(df.where(F.lit(False)), "g", "x", cuts).count() == 0
