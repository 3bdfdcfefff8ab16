"""Roles, cleaning, profile, sources."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkdemand.functions import columns as fc
from sparkdemand.operators import clean, profile, roles
from sparkdemand.operators.roles import Roles
from sparkdemand.sources import csv


def test_name_patterns_and_overrides(spark):
    df = spark.createDataFrame(
        [("2024-01-0%d" % i, i * 1.0, i, "s", 0) for i in range(1, 6)],
        "Transaction_Date string, Total_Revenue double, Quantity int, Branch string, Holiday_Flag int",
    )
    found, cands = roles.detect_roles(df)
    assert (found.date, found.sales, found.order, found.store, found.holiday) == (
        "Transaction_Date", "Total_Revenue", "Quantity", "Branch", "Holiday_Flag",
    )
    assert "Holiday_Flag" in cands["date"]  # "day" is contained in the name
    changed = found.override(df.columns, store="None", order="Nope")
    assert changed.store is None and changed.order == "Quantity"


def test_number_column_is_no_date_and_layouts_are_found(spark):
    df = spark.createDataFrame([(10.0, "13/02/2024"), (20.0, "14/02/2024")], "Weekly_Sales double, When_Date string")
    found, _ = roles.detect_roles(df)
    assert found.date == "When_Date" and found.date_format == "d/M/yyyy" and found.sales == "Weekly_Sales"
    out = clean.parse_and_require_date(df, "When_Date", found.date_format)
    assert out.first()["When_Date"] == dt.date(2024, 2, 13)


def test_audit_excludes_identifiers_constants_and_free_text(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(i), float(i), f"uuid-{i}", f"comment {i}", 0, "http://x/y") for i in range(100)]
    df = spark.createDataFrame(rows, "Date date, Sales double, Transaction_UUID string, Long_Text string, Zero int, Web_URL string")
    found, _ = roles.detect_roles(df)
    status = {r.Column_Name: (r.Status, r.Detected_Role) for r in roles.column_audit(df, found).collect()}
    assert status["Transaction_UUID"][0] == status["Zero"][0] == status["Web_URL"][0] == "EXCLUDED"
    assert status["Long_Text"] == ("EXCLUDED", "High Cardinality Text")
    assert status["Date"] == ("KEEP", "Index: Date")


@pytest.mark.parametrize(
    "step,want", [(1, "Daily"), (7, "Weekly"), (30, "Monthly"), (3, "Irregular")]
)
def test_frequency(spark, step, want):
    days = [(dt.date(2024, 1, 1) + dt.timedelta(step * i),) for i in range(12)]
    freq, lags, rolling = roles.detect_frequency(spark.createDataFrame(days * 2, "d date"), "d")
    assert freq == want and tuple(lags) == roles.FREQUENCY_DEFAULTS[want][0] and tuple(rolling) == roles.FREQUENCY_DEFAULTS[want][1]


def test_frequency_of_short_and_missing_history(spark):
    two = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 3, 1),)], "d date")
    assert roles.detect_frequency(two, "d") == ("Daily", [1, 7], [7])
    assert roles.detect_frequency(two, "nope")[0] == "Daily"


def test_timestamp_gaps_cross_hours(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=25 * i),) for i in range(20)]
    row = roles.frequency_report(spark.createDataFrame(rows, "t timestamp"), "t").first()
    assert row["n_dates"] == 20 and row["median_gap"] == pytest.approx(25 / 1440)


DIRTY = [
    ("2024-01-01", " A ", "10", 1.0, None),
    ("2024-01-02", "A", "-5", None, "Yes"),
    ("2024-01-02", "A", "-5", None, "Yes"),
    ("2024-01-03", "A", "30", 3.0, "Yes"),
    ("bad", "A", "30", 3.0, "No"),
    ("2024-01-04", "B", "x", 3.0, "No"),
    ("2024-01-05", "B", "20", None, "No"),
]
DIRTY_SCHEMA = "Date string, Store string, Sales string, Order double, Discount string"


def test_cleaner_by_hand(spark):
    res = clean.clean_dataset(spark.createDataFrame(DIRTY, DIRTY_SCHEMA), clean.CleanOptions(store="Store"))
    rows = sorted(tuple(r) for r in res.data.select("Date", "Store", "Sales", "Order", "Discount").collect())
    day = lambda i: dt.date(2024, 1, i)
    # Order of store B has no value to fill from: median of the filled column (1, 1, 3).
    assert rows == [(day(1), "A", 10.0, 1.0, "Yes"), (day(2), "A", 0.0, 1.0, "Yes"), (day(3), "A", 30.0, 3.0, "Yes"), (day(5), "B", 20.0, 1.0, "No")]
    audit = {r.Metric: (r.Before_Cleaning, r.After_Cleaning, r.Change) for r in res.audit.collect()}
    assert audit["Total Rows"] == (7, 4, -3) and audit["Duplicate Rows"] == (1, 0, -1) and audit["Missing Cells"] == (4, 0, -4)
    res.close()


def test_cleaner_leaves_no_gaps(spark):
    res = clean.clean_dataset(spark.createDataFrame(DIRTY, DIRTY_SCHEMA), clean.CleanOptions(store="Store"))
    assert res.data.count() == 4 and res.data.where("Order is null or Discount is null").count() == 0


def test_negative_drop_keeps_missing_orders(spark):
    opts = clean.CleanOptions(store="Store", negative_handling=clean.DROP, impute_missing=False)
    rows = clean.clean_dataset(spark.createDataFrame(DIRTY, DIRTY_SCHEMA), opts).data.collect()
    assert sorted(r.Sales for r in rows) == [10.0, 20.0, 30.0] and any(r.Order is None for r in rows)


@pytest.mark.parametrize("how,high,n", [(clean.CAP, 157.0, 20), (clean.REMOVE, 19.0, 19), (clean.KEEP, 5000.0, 20)])
def test_outlier_treatment(spark, how, high, n):
    df = spark.createDataFrame([(float(x),) for x in [*range(1, 20), 5000]], "Sales double")
    out = clean.treat_outliers(df, "Sales", how).agg(F.max("Sales").alias("m"), F.count(F.lit(1)).alias("n")).first()
    if how == clean.CAP:
        q1, q3 = 5.75, 15.25
        high = q3 + 1.5 * (q3 - q1)
    assert out["m"] == pytest.approx(high) and out["n"] == n


def test_profile_numbers(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0), (None, 100.0), ("a", 1.0)], "c string, x double")
    s = profile.structure(df).first()
    assert (s.total_rows, s.duplicate_rows) == (6, 1)
    cat = profile.categorical_profile(df).first()
    assert (cat.Unique_Classes, cat.Top_Value, cat.Top_Frequency) == (2, "a", 3)
    num = profile.numeric_profile(df).first()
    assert num.Potential_Outliers == 1 and num.Median == 2.5
    miss = {r.Column: (r.Missing_Count, r.Unique_Values) for r in profile.missing_profile(df).collect()}
    assert miss == {"c": (1, 3), "x": (0, 5)}


def test_integrity_checks(spark):
    df = spark.createDataFrame([("a", 1, "r"), ("a", 2, "r"), ("b", 1, "q"), ("b", 1, "z")], "s string, d int, r string")
    assert [r.s for r in profile.incomplete_entities(df, "s", "d").collect()] == ["b"]
    assert [r.s for r in profile.varying_attribute(df, ["s"], "r").collect()] == ["b"]
    assert profile.mixed_within(df, ["s", "d"], "r").count() == 1


def test_flag_words(spark):
    df = spark.createDataFrame([(" YES ",), ("1.0",), (None,), ("discount",)], "v string")
    on = lambda w: [r[0] for r in df.select(fc.is_truthy(F.col("v"), w)).collect()]
    assert on(fc.FEATURE_DISCOUNT_WORDS) == [True, False, False, False]
    assert on(fc.ANALYSIS_DISCOUNT_WORDS) == [True, False, False, True]
    assert on(fc.ANALYSIS_HOLIDAY_WORDS) == [True, True, False, False]
    assert on(fc.TEST_HOLIDAY_WORDS) == [True, False, False, False]


def test_scope_rules(spark):
    df = spark.createDataFrame(
        [("2024-01-01", 1.0, 2.0, 0, 10.0, 7), ("2024-01-01", 3.0, 4.0, 1, 20.0, 8), (None, 9.0, 9.0, 1, 1.0, 1)],
        "Date string, Sales double, Order double, Holiday_Flag int, Temperature double, Store int",
    )
    row = roles.dataset_scope(df).collect()
    assert len(row) == 1 and "Store" not in row[0]
    assert (row[0].Sales, row[0].Order, row[0].Holiday_Flag, row[0].Temperature) == (4.0, 6.0, 1, 15.0)


def test_standard_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "When int, Revenue int, Qty int")
    out, mapping = roles.standardize(df, Roles(date="When", sales="Revenue", order="Qty"))
    assert out.columns == ["Date", "Sales", "Order"] and mapping == {"When": "Date", "Revenue": "Sales", "Qty": "Order"}


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_csv_dialects(spark, tmp_path, sep):
    path = tmp_path / "t.csv"
    path.write_bytes(sep.join(["Date", "Stadt", "Sales", "Units"]).encode() + b"\n" + sep.join(["2024-01-01", "Köln", "1.5", "NA"]).encode("latin1") + b"\n")
    row = csv.load_csv(spark, str(path)).first()
    assert (row.Stadt, row.Sales, row.Units) == ("Köln", 1.5, None)


def test_csv_without_separator_and_quotes(spark, tmp_path):
    one = tmp_path / "one.csv"
    one.write_text(" Sales \n1\n2\n")
    df = csv.load_csv(spark, str(one))
    assert df.columns == ["Sales"] and [r.Sales for r in df.collect()] == [1, 2]
    quoted = tmp_path / "q.csv"
    quoted.write_text('a,b\n"x, ""y""",2\n')
    assert tuple(csv.load_csv(spark, str(quoted)).first()) == ('x, "y"', 2)


def test_month_folders(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, m, 1), float(m)) for m in (1, 2, 2)], "Date date, Sales double")
    path = csv.write_parquet(df, str(tmp_path / "p"), "Date", ("Date",))
    assert spark.read.parquet(path).groupBy("year_month").count().count() == 2


def test_money_and_date_texts(spark):
    df = spark.createDataFrame([(1.32e9,), (45.5e6,), (12_000.0,), (-950.0,), (None,)], "v double")
    assert [r[0] for r in df.select(fc.currency_text(F.col("v"))).collect()] == ["$1.32B", "$45.5M", "$12K", "-$950.00", "$0.00"]
    assert spark.range(1).select(fc.readable_date(F.lit("2012-12-23").cast("date"))).first()[0] == "Dec 23, 2012"


def test_numbers_in_text_are_plain_numbers(spark):
    rows = [("12D",), ("7f",), ("1e3",), (" 5 ",), ("n/a",), ("-.5",), ("1.",), (None,)]
    df = spark.createDataFrame(rows, "Sales string")
    assert sorted(r.Sales for r in clean.require_target(df, "Sales").collect()) == [-0.5, 1.0, 5.0, 1000.0]


def test_dotted_float_column(spark):
    rows = [(dt.date(2024, 1, i), "A", float(i), None if i == 2 else 2.5) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "Date date, Store string, Sales double, `Fuel.Price` double")
    res = clean.clean_dataset(df, clean.CleanOptions(order=None, store="Store"))
    assert [r["Fuel.Price"] for r in res.data.collect()] == [2.5] * 4
    res.close()


def test_date_layout_is_judged_by_all_rows(spark):
    rows = [("03/04/2024",)] * 45 + [(f"{d}/01/2024",) for d in range(13, 29)]
    found, _ = roles.detect_roles(spark.createDataFrame([(a, 1.0) for (a,) in rows], "Date string, Sales double"))
    assert found.date == "Date" and found.date_format == "d/M/yyyy"


def test_csv_dialects(spark, tmp_path):
    from sparkdemand.sources.csv import load_csv

    def load(text, encoding="utf-8"):
        path = tmp_path / f"{abs(hash(text))}.csv"
        path.write_bytes(text.encode(encoding))
        return load_csv(spark, str(path))

    late = "a;b\n" + "x;1\n" * 80 + "Zürich;2\n"
    assert {r.a for r in load(late, "latin-1").collect()} == {"x", "Zürich"}
    assert load('"a,b";"c"\n1;2\n').columns == ["a,b", "c"]
    assert [tuple(r) for r in load('a,b\n"x\ny",1\nz,2\n').collect()] == [("x\ny", 1), ("z", 2)]
    assert dict(load("a\tb\n10D\t1\n20D\t2\n").dtypes) == {"a": "string", "b": "bigint"}
    assert load("a|b\n1.5|2\n").first()["a"] == 1.5


def test_gaps_are_known_before_the_fill(spark, monkeypatch):
    day = [dt.date(2024, 1, i) for i in range(1, 5)]
    rows = [("a", day[0], 1.0, 1.0), ("a", day[1], None, None), ("b", day[0], 4.0, None), ("b", day[2], None, None), (None, day[3], 9.0, 5.0)]
    df = spark.createDataFrame(rows, "Store string, Date date, x double, y double")
    assert clean.gaps_along_time(df, ["x", "y"], ["Store"], "Date") == ["y"]
    keyless = df.union(spark.createDataFrame([(None, day[0], None, 1.0)], df.schema))
    assert clean.gaps_along_time(keyless, ["x", "y"], ["Store"], "Date") == ["x", "y"]
    asked = []
    real = clean.agg_with_quantiles
    monkeypatch.setattr(clean, "agg_with_quantiles", lambda *a: asked.append(sorted(a[3].values())) or real(*a))
    out = {(r.Store, r.Date): (r.x, r.y) for r in clean.impute_numeric(df, ["x", "y"], ["Store"], "Date").collect()}
    assert asked == [[("y", 0.5)]]  # no median for the column that is full after the fill along time
    assert out == {("a", day[0]): (1.0, 1.0), ("a", day[1]): (1.0, 1.0), ("b", day[0]): (4.0, 1.0), ("b", day[2]): (4.0, 1.0), (None, day[3]): (9.0, 5.0)}


def test_audit_reads_the_rows_before_cleaning_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slow(x):
        made.add(1)
        return x

    rows = [("2024-01-01", " a", "1", 2.0), ("2024-01-01", "a", "1", 2.0), ("2024-01-01", "a", "1", 2.0), ("2024-01-02", None, "2", float("nan"))]
    df = spark.createDataFrame(rows, "Date string, Store string, Sales string, Units double").withColumn("Store", slow("Store"))
    found = clean.clean_dataset(df, clean.CleanOptions(order="Units", store="Store"))
    built = made.value
    audit = {r.Metric: (r.Before_Cleaning, r.After_Cleaning, r.Change) for r in found.audit.collect()}
    assert audit["Total Rows"] == (4, 2, -2) and audit["Missing Cells"] == (2, 0, -2)
    assert audit["Duplicate Rows"] == (1, 0, -1) and audit["Duplicate Rows (trimmed)"] == (2, 0, -2)
    assert made.value - built == 4
