"""Trend, ranges, uplift, outliers and hypothesis tests against hand-computed or closed-form values."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkdemand.functions import special
from sparkdemand.operators import eda, outliers, report, stats


def daily(spark, values, start=dt.date(2024, 1, 1)):
    return spark.createDataFrame([(start + dt.timedelta(i), float(v)) for i, v in enumerate(values)], "Date date, Sales double")


@pytest.mark.parametrize("n,fast,slow", [(3, 1, 2), (8, 2, 4), (20, 3, 7), (40, 7, 30)])
def test_rolling_windows_adapt_to_history(spark, n, fast, slow):
    x = np.arange(n) ** 1.5
    got = eda.time_series(daily(spark, x)).orderBy("Date").toPandas()
    s = pd.Series(x)
    np.testing.assert_allclose(got.Rolling_Mean_Fast, s.rolling(fast, min_periods=1).mean())
    np.testing.assert_allclose(got.Rolling_Mean_Slow, s.rolling(slow, min_periods=1).mean())
    slope, intercept = np.polyfit(np.arange(n), x, 1)
    np.testing.assert_allclose(got.Trend_Line, intercept + slope * np.arange(n))


def test_ranges_nest_and_fall_back(spark):
    weeks = spark.createDataFrame([(dt.date(2022, 1, 2) + dt.timedelta(7 * i), 1.0) for i in range(105)], "Date date, Sales double")
    sizes = [eda.filter_by_range(weeks, "Date", o).count() for o in ("1 MONTH", "3 MONTHS", "6 MONTHS", "OVERALL")]
    assert sizes == sorted(set(sizes)) and sizes[-1] == 105
    sparse = spark.createDataFrame([(dt.date(2020 + i, 1, 1), 1.0) for i in range(4)], "Date date, Sales double")
    assert eda.filter_by_range(sparse, "Date", "1M").count() == 4


def test_peak_takes_the_first_of_equal_dates(spark):
    row = eda.peak_and_low(daily(spark, [5, 9, 9, 1, 1]), "Date", "Sales").first()
    assert (row.peak_date.day, row.low_date.day) == (2, 4)


def test_recent_month_falls_back_to_last_tenth(spark):
    row = eda.recent_month_sales(daily(spark, [1.0] * 60 + [0.0] * 40)).first()
    assert row.recent_sales == 0.0
    zero = daily(spark, [7.0] * 10).unionByName(daily(spark, [0.0], dt.date(2025, 1, 1)))
    assert eda.recent_month_sales(zero).first().recent_sales == 0.0


def test_outlier_table_with_zero_range(spark):
    df = daily(spark, [100.0] * 50 + [5000.0] + [100.0] * 49)
    s = outliers.outlier_summary(df).first()
    assert s.outlier_count == 1 and s.iqr == 0.0 and s.has_outliers
    top = outliers.top_outliers(df).first()
    assert top.Deviation_From_Normal == 4900.0 and top.Outlier_Type == outliers.EXTREME_SPIKE
    assert outliers.histogram(df, "Sales", 45).agg(F.sum("n")).first()[0] == 100


def test_uplift_needs_three_rows_per_side(spark):
    df = spark.createDataFrame([("Yes", 10.0)] * 2 + [("No", 5.0)] * 5, "Discount string, Sales double")
    assert eda.discount_uplift(df, "Discount").count() == 0
    df = df.unionByName(spark.createDataFrame([("promo", 40.0)], "Discount string, Sales double"))
    row = eda.discount_uplift(df, "Discount").first()
    assert (row.promo_mean, row.mean_diff_pct, row.median_diff_pct) == (20.0, 300.0, 100.0)


def test_tail_probabilities():
    assert special.t_tail(2.0, 10) == pytest.approx(0.07338803477074, rel=1e-10)
    assert special.t_tail_greater(-2.0, 10) == pytest.approx(1 - 0.07338803477074 / 2, rel=1e-10)
    assert special.f_tail(3.0, 2, 20) == pytest.approx(0.0725381503, rel=1e-8)
    assert special.chi2_tail(5.0, 3) == pytest.approx(0.1717971442967, rel=1e-10)
    assert special.chi2_tail(9.0, 2) == pytest.approx(math.exp(-4.5), rel=1e-12)
    assert special.beta_cdf(2, 3, 0.4) == pytest.approx(0.5248, rel=1e-12)


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 300), "o": rng.integers(1, 9, 300)})
    pdf["Sales"] = (50 + 5 * (pdf.g == "a") + 3 * pdf.o + rng.normal(0, 8, 300)).round(0)
    return pdf, spark.createDataFrame(pdf).cache()


def test_group_tests(groups):
    pdf, df = groups
    parts = [p.Sales for _, p in pdf.groupby("g")]
    n, grand = len(pdf), pdf.Sales.mean()
    between = sum(len(p) * (p.mean() - grand) ** 2 for p in parts) / 2
    within = sum(((p - p.mean()) ** 2).sum() for p in parts) / (n - 3)
    assert stats.anova(df, "g", "Sales").first().f == pytest.approx(between / within)
    ranks = pdf.Sales.rank()
    h = 12 / (n * (n + 1)) * sum(r.sum() ** 2 / len(r) for _, r in ranks.groupby(pdf.g)) - 3 * (n + 1)
    ties = 1 - sum(c**3 - c for c in pdf.Sales.value_counts()) / (n**3 - n)
    assert stats.kruskal(df, "g", "Sales").first().h == pytest.approx(h / ties)
    row = stats.correlation_statistics(df, "o", "Sales").first()
    assert row.pearson == pytest.approx(pdf.o.corr(pdf.Sales)) and row.spearman == pytest.approx(pdf.o.rank().corr(pdf.Sales.rank()))


def test_test_report(groups):
    _, df = groups
    out = {r.test_id: r for r in stats.run_tests(df, "Sales", "o", None, None, ["g"]).collect()}
    assert set(out) == {"g_variation", "orders_sales_correlation"}
    assert out["orders_sales_correlation"].verdict == stats.SIGNIFICANT
    flag = F.col("g") == "a"
    both, greater = stats.compare_two_groups(df, flag, "Sales"), stats.compare_two_groups(df, flag, "Sales", one_sided=True)
    assert greater["p"] < both["p"] < 0.05 and not greater["equal_var"]
    assert stats.run_tests(df.limit(5)).count() == 0


def test_takeaways_leave_out_missing_parts(spark):
    lines = [r.category for r in report.business_takeaways(daily(spark, [1, 2, 3])).orderBy("pos").collect()]
    assert lines == ["Historical Baseline"]


def test_report_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(x):
        made.add(1)
        return x

    df = spark.range(40).select(
        slow((F.col("id") * 7 % 23).cast("double")).alias("Sales"),
        (F.col("id") % 5).cast("double").alias("Units"),
        F.when(F.col("id") % 2 == 0, "Yes").otherwise("No").alias("Discount"),
        (F.col("id") % 4).cast("string").alias("Store"),
    )
    found = stats.run_tests(df, "Sales", "Units", "Discount", None, ["Store"])
    assert {r.test_id for r in found.collect()} == {"discount_impact", "Store_variation", "orders_sales_correlation"}
    assert made.value <= 80  # take(10) may make a partition a second time
