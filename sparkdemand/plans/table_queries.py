"""Queries on table preparation: sources, roles, filters, joins, cleaning, profile."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from sparkdemand.functions import columns as fc
from sparkdemand.operators import clean, profile, roles
from sparkdemand.operators.order import agg_with_quantiles, join_salted
from sparkdemand.plans import sql as S
from sparkdemand.plans.registry import query, rounded
from sparkdemand.plans.sql import rnd, rnd_plain
from sparkdemand.session import ensure_checkpoint_dir
from sparkdemand.sources import csv, views

TYPED = clean.CleanOptions(order="Units", store="Store", tie=("Row_ID", "Line_ID", "Sales"))


def scratch(spark, label: str) -> str:
    """A fresh folder beside the session's checkpoints, which all executors can reach."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{int(time.time())}-{uuid.uuid4().hex[:8]}"


def typed_dirty(spark, d):
    return clean._typed_rows(views.dirty_sales(spark, d), TYPED)


# --- sources ------------------------------------------------------------------------------------

_S1_COLUMNS = "OrderKey, LineNo, Date, Store, Sales, Units, Discount, Holiday"


@query("S1_csv_load_semicolon_dialect", f"WITH {S.SALES_FACT} SELECT {_S1_COLUMNS} FROM sales_fact")
def _(spark, d):
    path = scratch(spark, "csv")
    views.sales_fact(spark, d).select(*_S1_COLUMNS.split(", ")).write.option("header", True).option("sep", ";").csv(path)
    out = csv.load_csv(spark, path)
    return out.withColumn("Date", F.col("Date").cast("date"))


@query("S2_trimmed_headers", f"WITH {S.SALES_FACT} SELECT Store, COUNT(*) AS n FROM sales_fact GROUP BY Store")
def _(spark, d):
    padded = views.sales_fact(spark, d).withColumnRenamed("Store", "  Store ")
    return fc.trim_headers(padded).groupBy("Store").agg(F.count(F.lit(1)).alias("n"))


_LISTED = {k: (",".join(map(str, a)), ",".join(map(str, b))) for k, (a, b) in roles.FREQUENCY_DEFAULTS.items()}


def _frequency_sql(ctes: str, gaps: str) -> str:
    case = lambda i: "CASE frequency " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in _LISTED.items()) + " END"
    return f"""WITH {ctes}, g AS ({gaps}), m AS (SELECT COUNT(*) AS n_dates, median(gap) AS gap FROM g),
      f AS (SELECT *, CASE WHEN gap BETWEEN 0.6 AND 1.5 THEN 'Daily' WHEN gap BETWEEN 5.5 AND 8.5 THEN 'Weekly'
                           WHEN gap BETWEEN 25 AND 33 THEN 'Monthly' ELSE 'Irregular' END AS frequency FROM m)
      SELECT n_dates, {rnd('gap', 6)} AS median_gap, frequency, {case(0)} AS lags, {case(1)} AS rolling FROM f"""


def _day_gaps(source: str) -> str:
    return f"SELECT CAST(date_diff('day', lag(Date) OVER (ORDER BY Date), Date) AS DOUBLE) AS gap FROM (SELECT DISTINCT Date FROM {source})"


@query("S3_S4_W1_frequency_daily", _frequency_sql(S.SCOPE_DAY, _day_gaps("scope_day")))
def _(spark, d):
    return rounded(roles.frequency_report(views.sales_fact(spark, d), "Date"), 6)


@query("S3_S4_W1_frequency_weekly", _frequency_sql(S.SCOPE_WEEK, _day_gaps("scope_week")))
def _(spark, d):
    return rounded(roles.frequency_report(views.scope_week(spark, d), "Date"), 6)


@query("S3_S4_W1_frequency_monthly", _frequency_sql(S.SCOPE_MONTH, _day_gaps("scope_month")))
def _(spark, d):
    return rounded(roles.frequency_report(views.scope_month(spark, d), "Date"), 6)


@query(
    "S3_S4_W1_frequency_timestamps",
    _frequency_sql(
        "t AS (SELECT DISTINCT ts FROM events)",
        "SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts))) / 86400e6 AS gap FROM t",
    ),
)
def _(spark, d):
    return rounded(roles.frequency_report(views.table(spark, d, "events"), "ts"), 6)


@query("S5_csv_sink_roundtrip", f"WITH {S.SCOPE_DAY} SELECT Date, {rnd('Sales', 2)} AS Sales, Units FROM scope_day")
def _(spark, d):
    path = csv.write_csv(views.scope_day(spark, d).select("Date", "Sales", "Units"), scratch(spark, "sink"))
    out = spark.read.schema("Date date, Sales double, Units double").csv(path, header=True)
    return rounded(out, 2)


@query("S5_parquet_sink_by_month", f"WITH {S.SALES_FACT} SELECT strftime(Date, '%Y-%m') AS year_month, COUNT(*) AS n FROM sales_fact GROUP BY 1")
def _(spark, d):
    path = csv.write_parquet(views.sales_fact(spark, d), scratch(spark, "sink"), "Date", ("Store", "Product", "Date"))
    return spark.read.parquet(path).groupBy(F.col("year_month").cast("string")).agg(F.count(F.lit(1)).alias("n"))


# --- roles --------------------------------------------------------------------------------------


@query(
    "R1_normalized_values",
    "SELECT regexp_replace(lower(trim(p_name)), '[^a-z0-9]', '', 'g') AS name, COUNT(*) AS n FROM part GROUP BY 1",
)
def _(spark, d):
    return views.table(spark, d, "part").groupBy(fc.normalize_text(F.col("p_name")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


_AUDIT_COLUMNS = ["LineNo", "Date", "Store", "Product", "Category", "Region", "Sales", "Units", "Discount", "Holiday", "Tax", "Row_ID", "Code", "Flat"]
#: Label, status, category and reason of each column, written out; %d stands for the number of values.
_AUDIT_TEXTS = {
    "LineNo": ("Numeric Predictor", "KEEP", "USEFUL", "A number from outside that may drive the target."),
    "Date": ("Index: Date", "KEEP", "REQUIRED / PRIMARY", "Orders the rows in time; lags and splits follow it."),
    "Store": ("Entity: Store", "KEEP", "USEFUL", "Names the series for which history is kept apart."),
    "Product": ("Entity: Product", "KEEP", "USEFUL", "Names the series for which history is kept apart."),
    "Category": ("Categorical Feature", "KEEP", "OPTIONAL", "A category with %d classes."),
    "Region": ("Categorical Feature", "KEEP", "OPTIONAL", "A category with %d classes."),
    "Sales": ("Target: Sales", "KEEP", "REQUIRED / PRIMARY", "The amount that the models forecast."),
    "Units": ("Predictor: Order/Demand", "KEEP", "USEFUL", "Moves with the target and helps to predict it."),
    "Discount": ("Business Driver", "KEEP", "OPTIONAL", "Marks days with a promotion or a holiday."),
    "Holiday": ("Business Driver", "KEEP", "OPTIONAL", "Marks days with a promotion or a holiday."),
    "Tax": ("Numeric Predictor", "KEEP", "USEFUL", "A number from outside that may drive the target."),
    "Row_ID": ("Record Identifier", "EXCLUDED", "UNUSED / IRRELEVANT", "Numbers the rows; a model would only learn it by heart."),
    "Code": ("High Cardinality Text", "EXCLUDED", "UNUSED / IRRELEVANT", "Text with %d different values, too many to learn from."),
    "Flat": ("Zero-Variance Constant", "EXCLUDED", "UNUSED / IRRELEVANT", "Has the same value everywhere and explains nothing."),
}
_AUDIT_TYPES = {"LineNo": "int", "Date": "date", "Holiday": "int", "Row_ID": "bigint", "Flat": "int", "Sales": "double", "Units": "double", "Tax": "double"}


def _audit_sql() -> str:
    parts = []
    for c in _AUDIT_COLUMNS:
        label, status, category, reason = _AUDIT_TEXTS[c]
        why = f"'{reason}'" if "%d" not in reason else "concat('{}', u, '{}')".format(*reason.split("%d"))
        parts.append(
            f"""SELECT '{c}' AS Column_Name, '{_AUDIT_TYPES.get(c, "string")}' AS Type, u AS Unique_Values,
                       {rnd_plain('m * 100.0 / n', 2)} AS Missing_Pct, '{label}' AS Detected_Role, '{status}' AS Status,
                       '{category}' AS Category, {why} AS Reason
                FROM (SELECT COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS u,
                             SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS m, COUNT(*) AS n FROM wide)"""
        )
    wide = """wide AS (SELECT * EXCLUDE (OrderKey), OrderKey AS Row_ID,
                CASE WHEN OrderKey % 31 = 0 THEN NULL ELSE concat('c-', OrderKey, '-', LineNo, '-', CAST(Sales AS VARCHAR)) END AS Code, 7 AS Flat FROM sales_fact)"""
    return f"WITH {S.SALES_FACT}, {wide} " + " UNION ALL ".join(parts)


def _audited(spark, d):
    """The fact view with an identifier, a free-text and a constant column added, and its audit."""
    f = views.sales_fact(spark, d)
    code = F.concat(F.lit("c-"), "OrderKey", F.lit("-"), "LineNo", F.lit("-"), F.col("Sales").cast("string"))
    extra = {"Row_ID": F.col("OrderKey"), "Code": F.when(F.col("OrderKey") % 31 != 0, code), "Flat": F.lit(7)}
    wide = f.withColumns(extra).drop("OrderKey")
    found, _candidates = roles.detect_roles(wide)
    return roles.column_audit(wide, found)


@query("R2_R7_R9_column_audit", _audit_sql())
def _(spark, d):
    return _audited(spark, d).drop("pos")


@query("A16_excluded_columns", f"SELECT Column_Name, Detected_Role FROM ({_audit_sql()}) AS audit WHERE Status = 'EXCLUDED'")
def _(spark, d):
    return roles.excluded_columns(_audited(spark, d)).select("Column_Name", "Detected_Role")


@query(
    "R8_standard_names",
    f'WITH {S.SALES_FACT} SELECT OrderKey, LineNo, Date, Sales, Units AS "Order", Store FROM sales_fact',
)
def _(spark, d):
    raw = views.sales_fact(spark, d).select(
        "OrderKey", "LineNo", F.col("Date").alias("Transaction_Date"), F.col("Sales").alias("Total_Revenue"), F.col("Units").alias("Quantity"), "Store", "Tax"
    )
    found, _c = roles.detect_roles(raw.drop("OrderKey", "LineNo"))
    return roles.standardize(raw, found, ["Tax"])[0]


@query(
    "R10_dataset_scope",
    f"""WITH {S.SALES_FACT} SELECT Date, {rnd('SUM(Sales)', 2)} AS Sales, {rnd('SUM(Units)', 2)} AS Units, {rnd('AVG(OrderKey)', 4)} AS OrderKey,
        {rnd('AVG(LineNo)', 4)} AS LineNo, MAX(Holiday) AS Holiday, {rnd('AVG(Tax)', 4)} AS Tax FROM sales_fact GROUP BY Date""",
)
def _(spark, d):
    return rounded(roles.dataset_scope(views.sales_fact(spark, d), "Date", "Sales", "Units"))


@query(
    "R11_type_map",
    f"""WITH {S.DIRTY} SELECT Row_ID, Line_ID, TRY_CAST(Sales AS DOUBLE) AS Sales, TRY_CAST(Date AS DATE) AS Date,
        CAST(Constant_Zero AS DOUBLE) AS Constant_Zero FROM dirty_sales""",
)
def _(spark, d):
    out = roles.cast_types(views.dirty_sales(spark, d), {"Sales": "double", "Date": "date", "Constant_Zero": "double"})
    return out.select("Row_ID", "Line_ID", "Sales", "Date", "Constant_Zero")


# --- filters and predicates -----------------------------------------------------------------------


@query("F1_trimmed_text", f"WITH {S.DIRTY} SELECT trim(Store) AS Store, trim(Discount) AS Discount, COUNT(*) AS n FROM dirty_sales GROUP BY 1, 2")
def _(spark, d):
    return clean.trim_strings(views.dirty_sales(spark, d)).groupBy("Store", "Discount").agg(F.count(F.lit(1)).alias("n"))


@query(
    "F2_C3_required_date_and_target",
    f"""WITH {S.DIRTY} SELECT TRY_CAST(trim(Date) AS DATE) AS Date, TRY_CAST(trim(Sales) AS DOUBLE) AS Sales, Row_ID, Line_ID
        FROM dirty_sales WHERE TRY_CAST(trim(Date) AS DATE) IS NOT NULL AND TRY_CAST(trim(Sales) AS DOUBLE) IS NOT NULL""",
)
def _(spark, d):
    rows = clean.parse_and_require_date(views.dirty_sales(spark, d), "Date")
    return clean.require_target(rows, "Sales").select("Date", "Sales", "Row_ID", "Line_ID")


_NUMBERS = "SELECT TRY_CAST(Sales AS DOUBLE) AS Sales, Units, Row_ID, Line_ID FROM dirty_sales WHERE TRY_CAST(Sales AS DOUBLE) IS NOT NULL"


@query("F3_negatives_clipped", f"WITH {S.DIRTY}, v AS ({_NUMBERS}) SELECT greatest(Sales, 0.0) AS Sales, Row_ID, Line_ID FROM v")
def _(spark, d):
    rows = clean.require_target(views.dirty_sales(spark, d), "Sales")
    return clean.treat_negatives(rows, "Sales", clean.CLIP).select("Sales", "Row_ID", "Line_ID")


@query(
    "F3_negatives_dropped",
    f"WITH {S.DIRTY}, v AS ({_NUMBERS}) SELECT Sales, Units, Row_ID, Line_ID FROM v WHERE Sales >= 0 AND (Units IS NULL OR Units >= 0)",
)
def _(spark, d):
    rows = clean.require_target(views.dirty_sales(spark, d), "Sales")
    rows = clean.treat_negatives(rows, "Sales", clean.DROP)
    return clean.treat_negatives(rows, "Units", clean.DROP, keep_null=True).select("Sales", "Units", "Row_ID", "Line_ID")


@query(
    "F6_complete_rows",
    f"WITH {S.DIRTY} SELECT Row_ID, Line_ID, Units, Discount FROM dirty_sales WHERE Units IS NOT NULL AND Discount IS NOT NULL",
)
def _(spark, d):
    return views.dirty_sales(spark, d).dropna(subset=["Units", "Discount"]).select("Row_ID", "Line_ID", "Units", "Discount")


def _flags_sql() -> str:
    def words(ws):
        return "(" + ", ".join(f"'{w}'" for w in ws) + ")"

    return f"""WITH {S.SALES_FACT}, t AS (SELECT Store, lower(trim(Discount)) AS dd, lower(trim(CAST(Holiday AS VARCHAR))) AS hh FROM sales_fact)
      SELECT Store, COUNT(CASE WHEN dd IN {words(fc.FEATURE_DISCOUNT_WORDS)} THEN 1 END) AS feature_discount,
             COUNT(CASE WHEN hh IN {words(fc.FEATURE_HOLIDAY_WORDS)} THEN 1 END) AS feature_holiday,
             COUNT(CASE WHEN dd IN {words(fc.ANALYSIS_DISCOUNT_WORDS)} THEN 1 END) AS analysis_discount,
             COUNT(CASE WHEN hh IN {words(fc.TEST_HOLIDAY_WORDS)} THEN 1 END) AS test_holiday
      FROM t GROUP BY Store"""


@query("F8_text_flags", _flags_sql())
def _(spark, d):
    on = lambda c, words, name: F.count_if(fc.is_truthy(F.col(c), words)).alias(name)
    return views.sales_fact(spark, d).groupBy("Store").agg(
        on("Discount", fc.FEATURE_DISCOUNT_WORDS, "feature_discount"),
        on("Holiday", fc.FEATURE_HOLIDAY_WORDS, "feature_holiday"),
        on("Discount", fc.ANALYSIS_DISCOUNT_WORDS, "analysis_discount"),
        on("Holiday", fc.TEST_HOLIDAY_WORDS, "test_holiday"),
    )


# --- joins ---------------------------------------------------------------------------------------


@query(
    "J1_threshold_on_all_rows",
    f"""WITH {S.SALES_FACT}, m AS (SELECT MAX(Date) AS newest, AVG(Sales) AS mean FROM sales_fact)
        SELECT Store, COUNT(*) AS n FROM sales_fact, m WHERE Sales > mean AND Date > newest - INTERVAL 365 DAY GROUP BY Store""",
)
def _(spark, d):
    f = views.sales_fact(spark, d)
    m = f.agg(F.max("Date").alias("newest"), F.avg("Sales").alias("mean"))
    kept = f.crossJoin(F.broadcast(m)).where((F.col("Sales") > F.col("mean")) & (F.col("Date") > F.date_sub("newest", 365)))
    return kept.groupBy("Store").agg(F.count(F.lit(1)).alias("n"))


@query(
    "J2_conditional_aggregation",
    f"""WITH {S.SALES_FACT} SELECT Region, {rnd("AVG(CASE WHEN Discount = 'Yes' THEN Sales END)", 4)} AS promo_mean,
        {rnd("AVG(CASE WHEN Discount <> 'Yes' THEN Sales END)", 4)} AS regular_mean FROM sales_fact GROUP BY Region""",
)
def _(spark, d):
    promo = fc.is_truthy(F.col("Discount"), fc.ANALYSIS_DISCOUNT_WORDS)
    return rounded(
        views.sales_fact(spark, d).groupBy("Region").agg(
            F.avg(F.when(promo, F.col("Sales"))).alias("promo_mean"), F.avg(F.when(~promo, F.col("Sales"))).alias("regular_mean")
        )
    )


@query(
    "J3_group_median_back_to_rows",
    f"""WITH {S.STORE_DAY}, m AS (SELECT Store, median(Sales) AS med FROM store_day GROUP BY Store)
        SELECT s.Store, Date, {rnd('Sales - med', 4)} AS gap FROM store_day s JOIN m ON s.Store = m.Store""",
)
def _(spark, d):
    s = views.store_day(spark, d)
    med = agg_with_quantiles(s, ["Store"], [], {"med": ("Sales", 0.5)})
    return rounded(join_salted(s, med, "Store", "Date").select("Store", "Date", (F.col("Sales") - F.col("med")).alias("gap")))


@query(
    "J5_fact_view",
    f"""WITH {S.SALES_FACT} SELECT Store, Product, {rnd('SUM(Sales)', 2)} AS Sales, COUNT(*) AS n FROM sales_fact GROUP BY Store, Product""",
)
def _(spark, d):
    f = views.sales_fact(spark, d)
    return rounded(f.groupBy("Store", "Product").agg(F.sum("Sales").alias("Sales"), F.count(F.lit(1)).alias("n")), 2)


@query(
    "J5_orders_view",
    f"WITH {S.ORDERS_FACT} SELECT Segment, Priority, {rnd('SUM(Sales)', 2)} AS Sales, COUNT(*) AS n FROM orders_fact GROUP BY Segment, Priority",
)
def _(spark, d):
    f = views.orders_fact(spark, d)
    return rounded(f.groupBy("Segment", "Priority").agg(F.sum("Sales").alias("Sales"), F.count(F.lit(1)).alias("n")), 2)


# --- cleaning ------------------------------------------------------------------------------------


@query("C1_distinct_rows", f"WITH {S.TRIMMED} SELECT * FROM trimmed")
def _(spark, d):
    return clean.drop_exact_duplicates(clean.trim_strings(views.dirty_sales(spark, d)))


@query("C2_ordered_sink", f"WITH {S.TYPED} SELECT Store, COUNT(*) AS n, MIN(Date) AS first_date, MAX(Date) AS last_date FROM typed GROUP BY Store")
def _(spark, d):
    path = csv.write_parquet(typed_dirty(spark, d), scratch(spark, "ordered"), None, ("Store", "Date"))
    return spark.read.parquet(path).groupBy("Store").agg(
        F.count(F.lit(1)).alias("n"), F.min("Date").alias("first_date"), F.max("Date").alias("last_date")
    )


@query(
    "C4_outliers_capped",
    f"""WITH {S.STORE_DAY}, {S.bounds('store_day', 'Sales')}
        SELECT Store, Date, {rnd('greatest(least(Sales, upper_bound), lower_bound)', 4)} AS Sales FROM store_day, b""",
)
def _(spark, d):
    return rounded(clean.treat_outliers(views.store_day(spark, d).select("Store", "Date", "Sales"), "Sales", clean.CAP))


@query(
    "C5_outliers_removed",
    f"""WITH {S.STORE_DAY}, {S.bounds('store_day', 'Sales')}
        SELECT Store, Date, {rnd('Sales', 4)} AS Sales FROM store_day, b WHERE Sales BETWEEN extreme_lower AND extreme_upper""",
)
def _(spark, d):
    return rounded(clean.treat_outliers(views.store_day(spark, d).select("Store", "Date", "Sales"), "Sales", clean.REMOVE))


@query("C6_W9_filled_numbers", f"WITH {S.FILLED} SELECT Store, Date, Row_ID, Line_ID, Sales, Units FROM filled")
def _(spark, d):
    rows = clean.impute_numeric(typed_dirty(spark, d), ["Units"], ["Store"], "Date", TYPED.tie)
    return rows.select("Store", "Date", "Row_ID", "Line_ID", "Sales", "Units")


@query("C7_filled_categories", f"WITH {S.FILLED} SELECT Row_ID, Line_ID, Sales, Discount FROM filled")
def _(spark, d):
    return clean.impute_categories(typed_dirty(spark, d), ["Discount"]).select("Row_ID", "Line_ID", "Sales", "Discount")


@query("C8_whole_cleaner", f"WITH {S.FILLED} SELECT * FROM filled")
def _(spark, d):
    return clean.clean_dataset(views.dirty_sales(spark, d), TYPED).data


@query(
    "A23_before_after_audit",
    f"""WITH {S.FILLED}, {S.bounds('typed', 'Sales')},
      r AS (SELECT COUNT(*) AS n, SUM((Date IS NULL)::INT + (Store IS NULL)::INT + (Sales IS NULL)::INT + (Units IS NULL)::INT + (Discount IS NULL)::INT) AS miss FROM dirty_sales),
      dr AS (SELECT (SELECT COUNT(*) FROM dirty_sales) - COUNT(*) AS dup FROM (SELECT DISTINCT * FROM dirty_sales)),
      dt AS (SELECT (SELECT COUNT(*) FROM dirty_sales) - COUNT(*) AS dup FROM trimmed),
      a AS (SELECT COUNT(*) AS n, SUM((Units IS NULL)::INT + (Discount IS NULL)::INT) AS miss FROM filled),
      o AS (SELECT COUNT(CASE WHEN Sales < lower_bound OR Sales > upper_bound THEN 1 END) AS c FROM typed, b)
    SELECT 'Total Rows' AS Metric, r.n AS Before_Cleaning, a.n AS After_Cleaning, a.n - r.n AS Change FROM r, a
    UNION ALL SELECT 'Duplicate Rows', dup, 0, -dup FROM dr UNION ALL SELECT 'Duplicate Rows (trimmed)', dup, 0, -dup FROM dt
    UNION ALL SELECT 'Missing Cells', r.miss, a.miss, a.miss - r.miss FROM r, a UNION ALL SELECT 'Total Columns', 8, 8, 0
    UNION ALL SELECT 'Potential Outliers', c, c, 0 FROM o""",
)
def _(spark, d):
    return clean.clean_dataset(views.dirty_sales(spark, d), TYPED).audit.drop("pos")


# --- profile -------------------------------------------------------------------------------------


@query(
    "A11_profile_structure",
    f"""WITH {S.DIRTY} SELECT COUNT(*) AS total_rows, 8 AS total_cols,
        COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dirty_sales)) AS duplicate_rows FROM dirty_sales""",
)
def _(spark, d):
    return profile.structure(views.dirty_sales(spark, d))


@query(
    "A12_profile_dates",
    f"""WITH {S.SALES_FACT} SELECT MIN(Date) AS min_date, MAX(Date) AS max_date, COUNT(DISTINCT Date) AS unique_dates,
        date_diff('day', MIN(Date), MAX(Date)) + 1 AS span_days FROM sales_fact""",
)
def _(spark, d):
    return profile.date_profile(views.sales_fact(spark, d), "Date")


_DIRTY_TYPES = {"Date": "string", "Store": "string", "Sales": "string", "Units": "double", "Discount": "string", "Row_ID": "bigint", "Line_ID": "int", "Constant_Zero": "int"}


@query(
    "A13_profile_missing",
    f"WITH {S.DIRTY} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "Column", '{t}' AS Type, COUNT(*) - COUNT({c}) AS Missing_Count,
            {rnd_plain(f'(COUNT(*) - COUNT({c})) * 100.0 / COUNT(*)', 2)} AS Missing_Pct,
            COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS Unique_Values FROM dirty_sales"""
        for c, t in _DIRTY_TYPES.items()
    ),
)
def _(spark, d):
    return profile.missing_profile(views.dirty_sales(spark, d))


_STORE_DAY_NUMBERS = ("Sales", "Units", "Holiday", "Tax")


@query(
    "A14_profile_numbers",
    f"WITH {S.STORE_DAY} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "Column", {rnd_plain('m', 2)} AS Mean, {rnd_plain('s', 2)} AS Std, {rnd_plain('lo', 2)} AS Min, {rnd_plain('med', 2)} AS Median,
            {rnd_plain('hi', 2)} AS Max, {rnd_plain('q3 - q1', 2)} AS IQR, k AS Potential_Outliers, {rnd_plain('k * 100.0 / n', 2)} AS Outlier_Pct
            FROM (SELECT *, (SELECT COUNT(*) FROM store_day WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS k
                  FROM (SELECT AVG({c}) AS m, stddev_samp({c}) AS s, MIN({c}) AS lo, MAX({c}) AS hi, median({c}) AS med, COUNT({c}) AS n,
                        quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM store_day))"""
        for c in _STORE_DAY_NUMBERS
    ),
)
def _(spark, d):
    return profile.numeric_profile(views.store_day(spark, d))


@query(
    "A15_profile_categories",
    f"WITH {S.DIRTY} "
    + " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS "Column", (SELECT COUNT(DISTINCT {c}) FROM dirty_sales) AS Unique_Classes, {c} AS Top_Value,
            COUNT(*) AS Top_Frequency FROM dirty_sales WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)"""
        for c in ("Store", "Sales", "Discount")
    ),
)
def _(spark, d):
    return profile.categorical_profile(views.dirty_sales(spark, d), "Date")


@query(
    "A22_incomplete_entities",
    f"""WITH {S.SALES_FACT} SELECT Store, COUNT(DISTINCT Date) AS unique_counts FROM sales_fact GROUP BY Store
        HAVING COUNT(DISTINCT Date) <> (SELECT COUNT(DISTINCT Date) FROM sales_fact)""",
)
def _(spark, d):
    return profile.incomplete_entities(views.sales_fact(spark, d), "Store", "Date")


@query(
    "A22_attribute_varies",
    f"WITH {S.SALES_FACT} SELECT Store, COUNT(DISTINCT Region) AS unique_counts FROM sales_fact GROUP BY Store HAVING COUNT(DISTINCT Region) <> 1",
)
def _(spark, d):
    return profile.varying_attribute(views.sales_fact(spark, d), ["Store"], "Region")


@query(
    "A22_flag_differs_within_date",
    f"WITH {S.SALES_FACT} SELECT Date, COUNT(DISTINCT Holiday) AS unique_counts FROM sales_fact GROUP BY Date HAVING COUNT(DISTINCT Holiday) <> 1",
)
def _(spark, d):
    return profile.varying_attribute(views.sales_fact(spark, d), ["Date"], "Holiday")


@query(
    "A22_discount_mixed_within_group",
    f"""WITH {S.SALES_FACT} SELECT Date, Region, Category, COUNT(DISTINCT Discount) AS unique_counts FROM sales_fact
        GROUP BY Date, Region, Category HAVING COUNT(DISTINCT Discount) > 1""",
)
def _(spark, d):
    return profile.mixed_within(views.sales_fact(spark, d), ["Date", "Region", "Category"], "Discount")
