"""Queries on the cleaned table: trend, ranges, seasonality, ranking, uplift, outliers, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdemand.functions import columns as fc
from sparkdemand.operators import eda, order, outliers, report, stats
from sparkdemand.plans import sql as S
from sparkdemand.plans.registry import query, rounded
from sparkdemand.plans.sql import rnd, rnd_plain
from sparkdemand.sources import views

_STATS4 = f"{rnd('AVG(Sales)', 4)} AS Mean_Sales, {rnd('SUM(Sales)', 2)} AS Total_Sales, COUNT(Sales) AS %s, {rnd('median(Sales)', 4)} AS Median_Sales"


def cents(df, *cols):
    """Round the named columns to the cent and the other floating ones to four digits."""
    exact = {c: F.round(F.col(c) + F.signum(c) * 3e-6, 2) for c in cols}
    rest = [c for c in df.columns if c not in cols]
    four = rounded(df.select(*rest, *[F.col(c).cast("decimal(38,10)").alias(c) for c in cols]), 4)
    return four.withColumns({c: F.col(c).cast("double") for c in cols}).withColumns(exact)


# --- series --------------------------------------------------------------------------------------


@query(
    "A1_series_by_date",
    f"""WITH {S.SALES_FACT} SELECT Date, {rnd('SUM(Sales)', 2)} AS Total_Sales, {rnd('AVG(Sales)', 4)} AS Average_Sales,
        COUNT(Sales) AS Record_Count, {rnd('median(Sales)', 4)} AS Median_Sales FROM sales_fact GROUP BY Date""",
)
def _(spark, d):
    return cents(eda.series_by_date(views.sales_fact(spark, d)), "Total_Sales")


def _rolling_sql(ctes: str, source: str, fast: int, slow: int, labels: tuple[str, str]) -> str:
    mean = lambda w: rnd(f"AVG(Sales) OVER (ORDER BY Date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)", 4)
    return f"""WITH {ctes} SELECT Date, {rnd('Sales', 2)} AS Sales, {mean(fast)} AS Rolling_Mean_Fast, {mean(slow)} AS Rolling_Mean_Slow,
        '{labels[0]}' AS Rolling_Fast_Label, '{labels[1]}' AS Rolling_Slow_Label FROM {source}"""


@query("W2_rolling_means_daily", _rolling_sql(S.SCOPE_DAY, "scope_day", 7, 30, ("7-Day", "30-Day")))
def _(spark, d):
    return cents(eda.with_rolling_means(views.scope_day(spark, d).select("Date", "Sales"), "Date", "Sales"), "Sales")


@query("W2_rolling_means_weekly", _rolling_sql(S.SCOPE_WEEK, "scope_week", 4, 12, ("4-Week", "12-Week")))
def _(spark, d):
    return cents(eda.with_rolling_means(views.scope_week(spark, d).select("Date", "Sales"), "Date", "Sales", "Weekly"), "Sales")


@query("W2_rolling_means_monthly", _rolling_sql(S.SCOPE_MONTH, "scope_month", 3, 6, ("3-Month", "6-Month")))
def _(spark, d):
    return cents(eda.with_rolling_means(views.scope_month(spark, d).select("Date", "Sales"), "Date", "Sales", "Monthly"), "Sales")


@query(
    "W2_rolling_means_short_history",
    _rolling_sql(
        S.SALES_FACT + ", yearly AS (SELECT CAST(date_trunc('year', Date) AS DATE) AS Date, SUM(Sales) AS Sales FROM sales_fact GROUP BY 1)",
        "yearly", 2, 3, ("7-Day", "30-Day"),
    ),
)
def _(spark, d):
    yearly = views.sales_fact(spark, d).groupBy(F.trunc("Date", "year").alias("Date")).agg(F.sum("Sales").alias("Sales"))
    return cents(eda.with_rolling_means(yearly, "Date", "Sales"), "Sales")


@query(
    "W3_trend_line",
    f"""WITH {S.SCOPE_DAY}, p AS (SELECT Date, Sales, row_number() OVER (ORDER BY Date) - 1 AS i FROM scope_day),
        l AS (SELECT regr_slope(Sales, i) AS a, regr_intercept(Sales, i) AS b FROM p)
        SELECT Date, {rnd('b + a * i', 3)} AS Trend_Line FROM p, l""",
)
def _(spark, d):
    return rounded(eda.with_trend(views.scope_day(spark, d).select("Date", "Sales"), "Date", "Sales").drop("Sales"), 3)


@query(
    "A21_peak_and_low",
    f"""WITH {S.SCOPE_DAY} SELECT (SELECT Date FROM scope_day ORDER BY Sales DESC, Date LIMIT 1) AS peak_date, {rnd('MAX(Sales)', 2)} AS peak_value,
        (SELECT Date FROM scope_day ORDER BY Sales, Date LIMIT 1) AS low_date, {rnd('MIN(Sales)', 2)} AS low_value FROM scope_day""",
)
def _(spark, d):
    return rounded(eda.peak_and_low(views.scope_day(spark, d), "Date", "Sales"), 2)


# --- ranges ---------------------------------------------------------------------------------------


def _register_range(key: str, months: int) -> None:
    @query(
        f"F4_range_{key.lower()}",
        f"""WITH {S.SALES_FACT} SELECT OrderKey, LineNo, Date, Sales FROM sales_fact
            WHERE Date >= (SELECT MAX(Date) - INTERVAL {months} MONTH FROM sales_fact)""",
    )
    def _(spark, d):
        return eda.filter_by_range(views.sales_fact(spark, d), "Date", key).select("OrderKey", "LineNo", "Date", "Sales")


for _key, _months in (("1M", 1), ("3M", 3), ("6M", 6)):
    _register_range(_key, _months)


@query(
    "F4_range_fallback_rows",
    f"""WITH {S.SALES_FACT}, y AS (SELECT CAST(date_trunc('quarter', Date) AS DATE) AS Date, SUM(Sales) AS Sales FROM sales_fact GROUP BY 1)
        SELECT Date, {rnd('Sales', 2)} AS Sales FROM y ORDER BY Date DESC LIMIT 5""",
)
def _(spark, d):
    f = views.sales_fact(spark, d)
    q = f.groupBy(F.date_trunc("quarter", "Date").cast("date").alias("Date")).agg(F.sum("Sales").alias("Sales"))
    return rounded(eda.filter_by_range(q, "Date", "1 MONTH"), 2)


@query(
    "A2_history_kpis",
    f"""WITH {S.SALES_FACT} SELECT {rnd('SUM(Sales)', 2)} AS total_sales, {rnd('AVG(Sales)', 4)} AS avg_sales, MIN(Sales) AS min_sales,
        MAX(Sales) AS max_sales, COUNT(Sales) AS observations, MIN(Date) AS first_date, MAX(Date) AS last_date,
        {rnd('median(Sales)', 4)} AS median_sales, 'Daily' AS frequency FROM sales_fact""",
)
def _(spark, d):
    return cents(eda.summary_kpis(views.sales_fact(spark, d)), "total_sales")


@query(
    "A3_period_summaries",
    f"""WITH {S.SALES_FACT}, m AS (SELECT MAX(Date) AS newest FROM sales_fact),
        p AS (SELECT 'LAST 1 MONTH' AS Period, newest - INTERVAL 1 MONTH AS since FROM m UNION ALL SELECT 'LAST 3 MONTHS', newest - INTERVAL 3 MONTH FROM m
              UNION ALL SELECT 'LAST 6 MONTHS', newest - INTERVAL 6 MONTH FROM m UNION ALL SELECT 'OVERALL', TIMESTAMP '1900-01-01')
        SELECT Period, {rnd('SUM(Sales)', 2)} AS Total_Sales, {rnd('AVG(Sales)', 4)} AS Average_Sales, {rnd('median(Sales)', 4)} AS Median_Sales,
               COUNT(*) AS Observations, MIN(Date) AS Start_Date, MAX(Date) AS End_Date
        FROM sales_fact JOIN p ON Date >= since GROUP BY Period""",
)
def _(spark, d):
    return cents(eda.period_summaries(views.sales_fact(spark, d)).drop("pos"), "Total_Sales")


@query(
    "A20_recent_month",
    f"""WITH {S.SALES_FACT} SELECT {rnd('SUM(Sales)', 2)} AS recent_sales FROM sales_fact
        WHERE Date >= (SELECT MAX(Date) - INTERVAL 1 MONTH FROM sales_fact)""",
)
def _(spark, d):
    return rounded(eda.recent_month_sales(views.sales_fact(spark, d)), 2)


@query(
    "F5_text_search",
    f"""WITH {S.SALES_FACT} SELECT OrderKey, LineNo, Store, Product, Region FROM sales_fact
        WHERE regexp_matches(Store, 'nation_2[0-3]|east', 'i') OR regexp_matches(Product, 'nation_2[0-3]|east', 'i')
           OR regexp_matches(Region, 'nation_2[0-3]|east', 'i')""",
)
def _(spark, d):
    f = views.sales_fact(spark, d).select("OrderKey", "LineNo", "Store", "Product", "Region")
    return eda.search_rows(f, "nation_2[0-3]|east", None)


@query(
    "F5_K2_text_search_first_100",
    f"""WITH {S.SALES_FACT} SELECT OrderKey, LineNo, Sales, Store FROM sales_fact WHERE regexp_matches(Store, 'NATION_1$', 'i')
        ORDER BY OrderKey, LineNo, Sales LIMIT 100""",
)
def _(spark, d):
    f = views.sales_fact(spark, d).select("OrderKey", "LineNo", "Sales", "Store")
    return eda.search_rows(f, "nation_1$", 100, ("OrderKey", "LineNo", "Sales"))


# --- seasonality and entities -----------------------------------------------------------------------


@query(
    "A4_by_weekday",
    f"WITH {S.SALES_FACT} SELECT isodow(Date) - 1 AS pos, dayname(Date) AS Day_of_Week, {_STATS4 % 'Record_Count'} FROM sales_fact GROUP BY 1, 2",
)
def _(spark, d):
    return cents(eda.by_weekday(views.sales_fact(spark, d)), "Total_Sales")


@query(
    "A5_by_month",
    f"WITH {S.SALES_FACT} SELECT month(Date) AS pos, monthname(Date) AS Month_Name, {_STATS4 % 'Record_Count'} FROM sales_fact GROUP BY 1, 2",
)
def _(spark, d):
    return cents(eda.by_month(views.sales_fact(spark, d)), "Total_Sales")


@query(
    "A6_by_quarter_with_share",
    f"""WITH {S.SALES_FACT} SELECT quarter(Date) AS pos, concat('Q', quarter(Date)) AS Quarter, {_STATS4 % 'Record_Count'},
        {rnd('SUM(Sales) * 100.0 / (SELECT SUM(Sales) FROM sales_fact)', 4)} AS Share_Pct FROM sales_fact GROUP BY 1, 2""",
)
def _(spark, d):
    return cents(eda.by_quarter(views.sales_fact(spark, d)), "Total_Sales")


def _entity_sql(entity: str, direction: str) -> str:
    return f"""WITH {S.SALES_FACT} SELECT {entity}, {_STATS4 % 'Records'}, {rnd('SUM(Sales) * 100.0 / (SELECT SUM(Sales) FROM sales_fact)', 4)} AS Sales_Share_Pct
        FROM sales_fact GROUP BY {entity} ORDER BY SUM(Sales) {direction}, {entity} LIMIT 10"""


@query("A7_K1_top_stores", _entity_sql("Store", "DESC"))
def _(spark, d):
    return cents(eda.top_entities(views.sales_fact(spark, d), "Store"), "Total_Sales")


@query("A7_K1_bottom_products", _entity_sql("Product", "ASC"))
def _(spark, d):
    return cents(eda.bottom_entities(views.sales_fact(spark, d), "Product"), "Total_Sales")


@query(
    "A7_entity_overview",
    f"WITH {S.SALES_FACT} SELECT COUNT(DISTINCT Product) AS total_entities, {rnd('SUM(Sales)', 2)} AS total_sales FROM sales_fact",
)
def _(spark, d):
    return rounded(eda.entity_overview(views.sales_fact(spark, d), "Product"), 2)


# --- association and uplift ---------------------------------------------------------------------------

_RANKS = """r AS (SELECT Sales, Units, rank() OVER (ORDER BY Sales) + (COUNT(*) OVER (PARTITION BY Sales) - 1) / 2.0 AS rs,
                         rank() OVER (ORDER BY Units) + (COUNT(*) OVER (PARTITION BY Units) - 1) / 2.0 AS ru FROM %s)"""


@query(
    "A8_order_sales_association",
    f"""WITH {S.STORE_DAY}, {_RANKS % 'store_day'}
        SELECT {rnd_plain('corr(Sales, Units)', 4)} AS pearson_corr, {rnd_plain('corr(rs, ru)', 4)} AS spearman_corr,
               {rnd_plain('regr_slope(Sales, Units)', 2)} AS slope, {rnd_plain('regr_intercept(Sales, Units)', 2)} AS intercept,
               COUNT(*) AS total_paired_records FROM r""",
)
def _(spark, d):
    return eda.correlation(views.store_day(spark, d), "Sales", "Units")


@query(
    "A8_scatter_sample",
    f"""WITH {S.SALES_FACT} SELECT OrderKey, LineNo, Sales, Units FROM sales_fact WHERE Sales >= 0 AND Units >= 0
        ORDER BY md5(concat_ws('|', OrderKey, LineNo, CAST(Sales AS VARCHAR))), OrderKey, LineNo, Sales LIMIT 2000""",
)
def _(spark, d):
    return eda.scatter_sample(views.sales_fact(spark, d), ["OrderKey", "LineNo", "Sales"], "Sales", "Units")


@query(
    "F7_valid_pairs",
    f"WITH {S.DIRTY} SELECT Row_ID, Line_ID, Units FROM dirty_sales WHERE TRY_CAST(Sales AS DOUBLE) >= 0 AND Units >= 0",
)
def _(spark, d):
    return eda.valid_pairs(views.dirty_sales(spark, d), "Sales", "Units").select("Row_ID", "Line_ID", "Units")


def _uplift_sql(flag: str, prefix: str) -> str:
    on = lambda f: f"{f}(CASE WHEN {flag} THEN Sales END)"
    off = lambda f: f"{f}(CASE WHEN NOT {flag} THEN Sales END)"
    diff = lambda f: rnd_plain(f"({on(f)} - {off(f)}) / greatest({off(f)}, 1e-5) * 100.0", 2)
    return f"""WITH {S.SALES_FACT} SELECT {rnd(on('AVG'), 4)} AS {prefix}_mean, {rnd(off('AVG'), 4)} AS regular_mean,
        {rnd(on('median'), 4)} AS {prefix}_median, {rnd(off('median'), 4)} AS regular_median, {on('COUNT')} AS {prefix}_n, {off('COUNT')} AS regular_n,
        {diff('AVG')} AS mean_diff_pct, {diff('median')} AS median_diff_pct FROM sales_fact"""


@query("A9_promotion_uplift", _uplift_sql("(Discount = 'Yes')", "promo"))
def _(spark, d):
    return rounded(eda.discount_uplift(views.sales_fact(spark, d), "Discount"))


@query("A10_holiday_uplift", _uplift_sql("(Holiday = 1)", "holiday"))
def _(spark, d):
    return rounded(eda.holiday_uplift(views.sales_fact(spark, d), "Holiday"))


@query(
    "A9_promotion_sides",
    f"""WITH {S.SALES_FACT} SELECT Discount = 'Yes' AS is_on, {rnd('AVG(Sales)', 4)} AS mean, COUNT(Sales) AS n,
        {rnd('median(Sales)', 4)} AS median FROM sales_fact GROUP BY 1""",
)
def _(spark, d):
    return rounded(eda.uplift_by_flag(views.sales_fact(spark, d), fc.is_truthy(F.col("Discount"), fc.ANALYSIS_DISCOUNT_WORDS)))


# --- outliers -------------------------------------------------------------------------------------------

_B = S.bounds("store_day", "Sales")
_EXPLAINED = f"""o AS (SELECT s.*, {rnd_plain('CASE WHEN Sales > upper_bound THEN Sales - upper_bound ELSE lower_bound - Sales END', 2)} AS Deviation_From_Normal,
    CASE WHEN Sales > extreme_upper THEN '{outliers.EXTREME_SPIKE}' WHEN Sales > upper_bound THEN '{outliers.MODERATE_SPIKE}' ELSE '{outliers.LOW_DROP}' END AS Outlier_Type,
    CASE WHEN Sales > upper_bound THEN '{outliers.HIGH_TEXT}' ELSE '{outliers.LOW_TEXT}' END AS Domain_Interpretation
    FROM store_day s, b WHERE Sales < lower_bound OR Sales > upper_bound)"""


@query(
    "A17_outlier_thresholds",
    f"""WITH {S.STORE_DAY}, {_B}, k AS (SELECT COUNT(*) AS c FROM store_day, b WHERE Sales < lower_bound OR Sales > upper_bound)
        SELECT c > 0 AS has_outliers, n AS total_records, {rnd_plain('q1', 2)} AS q1, {rnd_plain('med', 2)} AS median, {rnd_plain('q3', 2)} AS q3,
               {rnd_plain('iqr', 2)} AS iqr, {rnd_plain('lower_bound', 2)} AS lower_bound, {rnd_plain('upper_bound', 2)} AS upper_bound,
               {rnd_plain('extreme_upper', 2)} AS extreme_upper, c AS outlier_count, {rnd_plain('c * 100.0 / n', 2)} AS outlier_pct FROM b, k""",
)
def _(spark, d):
    return outliers.outlier_summary(views.store_day(spark, d))


@query("O1_O2_explained_outliers", f"WITH {S.STORE_DAY}, {_B}, {_EXPLAINED} SELECT Store, Date, {rnd('Sales', 2)} AS Sales, Deviation_From_Normal, Outlier_Type, Domain_Interpretation FROM o")
def _(spark, d):
    out = outliers.outlier_rows(views.store_day(spark, d))
    return rounded(out.select("Store", "Date", "Sales", "Deviation_From_Normal", "Outlier_Type", "Domain_Interpretation"), 2)


@query(
    "O3_top_outliers",
    f"""WITH {S.STORE_DAY}, {_B}, {_EXPLAINED} SELECT Date, Store, {rnd('Sales', 2)} AS Sales, Holiday, Discount, Deviation_From_Normal, Outlier_Type, Domain_Interpretation
        FROM o ORDER BY Deviation_From_Normal DESC, Date, Store LIMIT 10""",
)
def _(spark, d):
    return rounded(outliers.top_outliers(views.store_day(spark, d), store="Store", tie=("Store",)), 2)


@query("O4_all_outliers", f"WITH {S.STORE_DAY}, {_B}, {_EXPLAINED} SELECT Date, {rnd('Sales', 2)} AS Sales, Deviation_From_Normal, Outlier_Type FROM o")
def _(spark, d):
    return rounded(outliers.all_outliers(views.store_day(spark, d)), 2)


@query(
    "O5_series_spikes",
    f"""WITH {S.SCOPE_DAY}, {S.bounds('scope_day', 'Sales')}
        SELECT Date, {rnd('Sales', 2)} AS Total_Sales, {rnd('upper_bound', 2)} AS upper_bound FROM scope_day, b WHERE Sales > upper_bound""",
)
def _(spark, d):
    series = views.scope_day(spark, d).select("Date", F.col("Sales").alias("Total_Sales"))
    return rounded(outliers.series_spikes(series), 2)


def _histogram_sql(ctes: str, source: str, column: str, bins: int) -> str:
    return f"""WITH {ctes}, s AS (SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {source}),
        h AS (SELECT CAST(least(floor(({column} - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INT) AS bin, lo, hi FROM {source}, s)
        SELECT bin, {rnd(f'lo + bin * ((hi - lo) / {bins})', 4)} AS bin_start, {rnd(f'lo + (bin + 1) * ((hi - lo) / {bins})', 4)} AS bin_end, COUNT(*) AS n
        FROM h GROUP BY bin, lo, hi"""


@query("A18_sales_histogram", _histogram_sql(S.SALES_FACT, "sales_fact", "Sales", 45))
def _(spark, d):
    return rounded(outliers.histogram(views.sales_fact(spark, d), "Sales", 45))


@query(
    "A19_box_numbers",
    f"""WITH {S.STORE_DAY} SELECT {rnd('MIN(Sales)', 4)} AS minimum, {rnd('MAX(Sales)', 4)} AS maximum, {rnd('quantile_cont(Sales, 0.25)', 4)} AS q1,
        {rnd('median(Sales)', 4)} AS median, {rnd('quantile_cont(Sales, 0.75)', 4)} AS q3 FROM store_day""",
)
def _(spark, d):
    return rounded(outliers.box_numbers(views.store_day(spark, d), "Sales"))


# --- the scale forms of the order statistics --------------------------------------------------------------


@query(
    "A7_medians_by_value_ranges",
    f"""WITH {S.SALES_FACT} SELECT Store, {rnd('median(Sales)', 4)} AS median_sales, {rnd('quantile_cont(Sales, 0.25)', 4)} AS q1,
        {rnd('median(Units)', 4)} AS median_units, COUNT(*) AS n FROM sales_fact GROUP BY Store""",
)
def _(spark, d):
    f = views.sales_fact(spark, d)
    wanted = {"median_sales": ("Sales", 0.5), "q1": ("Sales", 0.25), "median_units": ("Units", 0.5)}
    return rounded(order.agg_with_quantiles(f, ["Store"], [F.count(F.lit(1)).alias("n")], wanted))


@query(
    "W11_row_positions",
    f"""WITH {S.SALES_FACT} SELECT OrderKey, LineNo, Sales, row_number() OVER (ORDER BY Date, OrderKey, LineNo, Sales) - 1 AS row_index FROM sales_fact""",
)
def _(spark, d):
    f = views.sales_fact(spark, d)
    return order.with_row_index(f, "Date", ["OrderKey", "LineNo", "Sales"]).select("OrderKey", "LineNo", "Sales", "row_index")


@query(
    "T8_mid_ranks",
    f"""WITH {S.SALES_FACT} SELECT DISTINCT Units AS value, rank() OVER (ORDER BY Units) + (COUNT(*) OVER (PARTITION BY Units) - 1) / 2.0 AS rank,
        COUNT(*) OVER (PARTITION BY Units) AS n FROM sales_fact""",
)
def _(spark, d):
    r = order.mid_ranks(views.sales_fact(spark, d), "Units")
    return r.select(F.col("_v").alias("value"), "rank", F.col("_c").alias("n"))


# --- hypothesis tests --------------------------------------------------------------------------------------


def _two_group_sql(flag: str) -> str:
    return f"""WITH {S.SALES_FACT}, a AS (SELECT COUNT(*) AS n1, AVG(Sales) AS m1, var_samp(Sales) AS v1 FROM sales_fact WHERE {flag}),
        z AS (SELECT COUNT(*) AS n0, AVG(Sales) AS m0, var_samp(Sales) AS v0 FROM sales_fact WHERE NOT ({flag}))
        SELECT n1 AS n_on, n0 AS n_off, {rnd('m1', 4)} AS mean_on, {rnd('m0', 4)} AS mean_off, {rnd('v1', 1)} AS var_on, {rnd('v0', 1)} AS var_off,
               {rnd('(m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0))', 6)} AS t_student,
               CAST(n1 + n0 - 2 AS DOUBLE) AS df_student, {rnd('(m1 - m0) / sqrt(v1 / n1 + v0 / n0)', 6)} AS t_welch,
               {rnd('pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1))', 4)} AS df_welch,
               {rnd('(m1 - m0) / m0 * 100.0', 4)} AS diff_pct FROM a, z"""


def _two_group(df, flag):
    t = stats.two_group_statistics(df, flag, "Sales")
    fix = lambda c, k: F.round(F.col(c) + F.signum(c) * 3 * 10.0 ** -(k + 4), k).alias(c)
    digits = {"mean_on": 4, "mean_off": 4, "var_on": 1, "var_off": 1, "t_student": 6, "df_student": 4, "t_welch": 6, "df_welch": 4, "diff_pct": 4}
    return t.select("n_on", "n_off", *[fix(c, k) for c, k in digits.items()])


@query("T1_promotion_t_statistics", _two_group_sql("Discount = 'Yes'"))
def _(spark, d):
    return _two_group(views.sales_fact(spark, d), fc.is_truthy(F.col("Discount"), fc.ANALYSIS_DISCOUNT_WORDS))


@query("T2_T3_holiday_t_statistics", _two_group_sql("Holiday = 1"))
def _(spark, d):
    return _two_group(views.sales_fact(spark, d), fc.is_truthy(F.col("Holiday"), fc.TEST_HOLIDAY_WORDS))


def _f_sql(ctes: str, source: str, g: str, x: str) -> str:
    return f"""WITH {ctes}, p AS (SELECT {g} AS g, COUNT({x}) AS n, AVG({x}) AS m, var_pop({x}) AS v FROM {source} GROUP BY {g}),
        gm AS (SELECT SUM(n * m) / SUM(n) AS grand FROM p),
        s AS (SELECT COUNT(*) AS k, CAST(SUM(n) AS BIGINT) AS n, SUM(n * (m - grand) * (m - grand)) AS b, SUM(n * v) AS w FROM p, gm)
        SELECT k, n, {rnd('(b / (k - 1)) / (w / (n - k))', 6)} AS f, CAST(k - 1 AS DOUBLE) AS df_between, CAST(n - k AS DOUBLE) AS df_within FROM s"""


@query(
    "T4_levene_promotion",
    _f_sql(
        S.SALES_FACT
        + """, md AS (SELECT Discount, median(Sales) AS med FROM sales_fact GROUP BY Discount),
              dev AS (SELECT s.Discount, abs(Sales - med) AS x FROM sales_fact s JOIN md ON s.Discount = md.Discount)""",
        "dev", "Discount", "x",
    ),
)
def _(spark, d):
    return rounded(stats.levene(views.sales_fact(spark, d), fc.is_truthy(F.col("Discount"), fc.ANALYSIS_DISCOUNT_WORDS), "Sales"), 6)


@query("T5_anova_stores", _f_sql(S.SALES_FACT, "sales_fact", "Store", "Sales"))
def _(spark, d):
    return rounded(stats.anova(views.sales_fact(spark, d), "Store", "Sales"), 6)


@query(
    "T6_kruskal_wallis_regions",
    f"""WITH {S.SALES_FACT}, r AS (SELECT Region, Sales, rank() OVER (ORDER BY Sales) + (COUNT(*) OVER (PARTITION BY Sales) - 1) / 2.0 AS k FROM sales_fact),
        g AS (SELECT Region, COUNT(*) AS n, AVG(k) AS mr FROM r GROUP BY Region), t AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM r),
        ties AS (SELECT SUM(c * c * c - c) AS s FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS c FROM r GROUP BY Sales)),
        h AS (SELECT COUNT(*) AS k, CAST(SUM(g.n) AS BIGINT) AS n, SUM(12.0 / (t.n * (t.n + 1)) * g.n * (mr - (t.n + 1) / 2) * (mr - (t.n + 1) / 2)) AS raw,
                     MAX(1 - s / (t.n * t.n * t.n - t.n)) AS corr FROM g, t, ties)
        SELECT k, n, {rnd('raw / corr', 6)} AS h, CAST(k - 1 AS DOUBLE) AS df FROM h""",
)
def _(spark, d):
    return rounded(stats.kruskal(views.sales_fact(spark, d), "Region", "Sales"), 6)


@query(
    "T7_normality_by_region",
    f"""WITH {S.STORE_DAY}, m AS (SELECT Region, AVG(Sales) AS mu FROM store_day GROUP BY Region),
        c AS (SELECT s.Region, COUNT(*) AS n, AVG(pow(Sales - mu, 2)) AS m2, AVG(pow(Sales - mu, 3)) AS m3, AVG(pow(Sales - mu, 4)) AS m4
              FROM store_day s JOIN m ON s.Region = m.Region GROUP BY s.Region),
        j AS (SELECT Region AS g, n, n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM c)
        SELECT g, n, {rnd('jb', 4)} AS jb, {rnd('exp(-jb / 2)', 4)} AS p FROM j""",
)
def _(spark, d):
    return rounded(stats.normality(views.store_day(spark, d), F.col("Region"), "Sales"), 4)


@query(
    "T8_correlations",
    f"""WITH {S.STORE_DAY}, {_RANKS % 'store_day'} SELECT COUNT(*) AS n, {rnd('corr(Sales, Units)', 6)} AS pearson, {rnd('corr(rs, ru)', 6)} AS spearman FROM r""",
)
def _(spark, d):
    return rounded(stats.correlation_statistics(views.store_day(spark, d), "Units", "Sales"), 6)


@query(
    "T7_T9_normality_verdicts",
    f"""WITH {S.STORE_DAY}, m AS (SELECT Store, AVG(Sales) AS mu FROM store_day GROUP BY Store),
        c AS (SELECT s.Store, COUNT(*) AS n, AVG(pow(Sales - mu, 2)) AS m2, AVG(pow(Sales - mu, 3)) AS m3, AVG(pow(Sales - mu, 4)) AS m4
              FROM store_day s JOIN m ON s.Store = m.Store GROUP BY s.Store)
        SELECT Store, CASE WHEN exp(-(n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4)) / 2) < 0.05
                           THEN '{stats.SIGNIFICANT}' ELSE '{stats.NOT_SIGNIFICANT}' END AS verdict FROM c WHERE n >= 8""",
)
def _(spark, d):
    per = stats.normality(views.store_day(spark, d), F.col("Store"), "Sales")
    return per.select(F.col("g").alias("Store"), stats.verdict_column(F.col("p")).alias("verdict"))


@query("T1_to_T9_test_report")
def _(spark, d):
    return stats.run_tests(views.sales_fact(spark, d), "Sales", "Units", "Discount", "Holiday", ["Store", "Region"])


@query(
    "A24_takeaway_numbers",
    f"""WITH {S.SALES_FACT}, t AS (SELECT COUNT(Sales) AS n, SUM(Sales) AS total, AVG(Sales) AS mean, AVG(CASE WHEN Discount = 'Yes' THEN Sales END) AS p1,
        AVG(CASE WHEN Discount <> 'Yes' THEN Sales END) AS p0, AVG(CASE WHEN Holiday = 1 THEN Sales END) AS h1, AVG(CASE WHEN Holiday = 0 THEN Sales END) AS h0 FROM sales_fact)
        SELECT n, {rnd('total', 2)} AS total, {rnd('mean', 4)} AS mean, {rnd('p1', 4)} AS promo_on, {rnd('p0', 4)} AS promo_off, {rnd('h1', 4)} AS holiday_on,
               {rnd('h0', 4)} AS holiday_off, {rnd('(p1 - p0) / p0 * 100.0', 4)} AS promo_diff_pct, {rnd('(h1 - h0) / h0 * 100.0', 4)} AS holiday_diff_pct FROM t""",
)
def _(spark, d):
    return cents(report.takeaway_numbers(views.sales_fact(spark, d), "Sales", "Discount", "Holiday"), "total")


@query("A24_business_takeaways")
def _(spark, d):
    return report.business_takeaways(views.sales_fact(spark, d), None, "Sales", "Discount", "Holiday")


@query(
    "A21_display_texts",
    f"""WITH {S.SCOPE_DAY} SELECT Date, strftime(Date, '%b %d, %Y') AS shown_date,
        concat('$', CASE WHEN Sales >= 1e9 THEN concat(printf('%.2f', Sales / 1e9), 'B')
            WHEN Sales >= 1e6 THEN concat(printf('%.1f', Sales / 1e6), 'M')
            WHEN Sales >= 1e3 THEN concat(printf('%.0f', Sales / 1e3), 'K')
            ELSE printf('%.2f', Sales) END) AS shown_sales
        FROM scope_day""",
)
def _(spark, d):
    s = views.scope_day(spark, d)
    return s.select("Date", fc.readable_date(F.col("Date")).alias("shown_date"), fc.currency_text(F.col("Sales")).alias("shown_sales"))
