"""Whole runs on differently shaped tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from sparkdemand.operators import models
from sparkdemand.plans.pipeline import run_pipeline

PARAMS = {models.FOREST: {"numTrees": 3, "maxDepth": 3}}


def base(n=100, per_day=1, seed=1):
    rng = np.random.default_rng(seed)
    dates = pd.date_range("2023-01-01", periods=n, freq="D").repeat(per_day)
    return pd.DataFrame({"Date": dates, "Sales": 500 + 30 * np.sin(np.linspace(0, 10, n * per_day)) + rng.normal(0, 5, n * per_day)})


def stores():
    out = base(60, 2)
    return out.assign(Store=np.tile([1, 2], 60))


def weekly():
    out = base(120, 2).rename(columns={"Sales": "Weekly_Sales"})
    out["Date"] = np.repeat(pd.date_range("2020-02-07", periods=120, freq="7D"), 2).strftime("%d-%m-%Y")
    return out.assign(Store=np.tile([1, 2], 120), Holiday_Flag=(np.arange(240) % 20 == 0).astype(int), CPI=200.0 + np.arange(240) / 50)


def missing():
    out = base().assign(Temperature=np.linspace(20, 80, 100))
    out.loc[[5, 12], "Sales"] = np.nan
    out.loc[[8, 20], "Temperature"] = np.nan
    return out


def spikes():
    out = base()
    out.loc[[30, 65], "Sales"] = [5000.0, 4500.0]
    return out


CASES = {
    "plain": (base, {"store": None}),
    "stores": (stores, {"store": "Store"}),
    "orders": (lambda: stores().assign(Quantity=np.arange(120) % 40 + 10), {"order": "Quantity"}),
    "weekly": (weekly, {"sales": "Weekly_Sales", "holiday": "Holiday_Flag"}),
    "missing": (missing, {}),
    "copies": (lambda: pd.concat([base(80), base(80).head(20)], ignore_index=True), {}),
    "spikes": (spikes, {}),
    "date alias": (lambda: base().rename(columns={"Date": "Transaction_Date"}), {"date": "Transaction_Date"}),
    "sales alias": (lambda: base().rename(columns={"Sales": "Total_Revenue"}), {"sales": "Total_Revenue"}),
}


@pytest.mark.parametrize("case", list(CASES))
def test_scenario(spark, case):
    make, roles = CASES[case]
    pdf = make()
    result = run_pipeline(spark.createDataFrame(pdf), models=(models.NAIVE, models.RIDGE, models.FOREST), params=PARAMS, period="1 Month")
    for role, name in roles.items():
        assert getattr(result.roles, role) == name
    board = result.leaderboard.collect()
    assert len(board) == 3 and board[0].Accuracy_Pct >= board[-1].Accuracy_Pct
    ahead = result.forecast.collect()
    assert len(ahead) == (4 if case == "weekly" else 30) and all(r.Forecasted_Sales >= 0 for r in ahead)
    assert result.frequency == ("Weekly" if case == "weekly" else "Daily") and result.champion == models.FOREST
    last = result.scope.orderBy("Date", ascending=False).first().Sales
    if case != "spikes":  # there the last spike is still inside the rolling windows
        assert 0.5 <= ahead[0].Forecasted_Sales / last <= 2.0
    audit = {r.Metric: r for r in result.clean_audit.collect()}
    if case == "copies":
        assert audit["Duplicate Rows"].Before_Cleaning == 20 and result.clean.count() == 80
    if case == "missing":
        assert result.clean.count() == 98 and result.clean.where("Temperature is null").count() == 0
    if case == "spikes":
        assert result.outlier_summary.first().outlier_count >= 2 and result.clean.where("Sales > 4000").count() == 2
    result.close()


def test_no_target_is_an_error(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "x")], "Date date, Note string")
    with pytest.raises(ValueError):
        run_pipeline(df)
