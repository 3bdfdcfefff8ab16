"""SQL text pieces of the DuckDB side: the same views as common table expressions."""

from __future__ import annotations

SALES_FACT = """sales_fact AS (
  SELECT l_orderkey AS OrderKey, l_linenumber AS LineNo, CAST(l_shipdate AS DATE) AS Date, n_name AS Store,
         p_brand AS Product, p_type AS Category, r_name AS Region, l_extendedprice AS Sales, l_quantity AS Units,
         CASE WHEN l_discount >= 0.05 THEN 'Yes' ELSE 'No' END AS Discount,
         CASE WHEN (month(l_shipdate) = 12 AND day(l_shipdate) >= 20)
                OR (month(l_shipdate) = 11 AND day(l_shipdate) BETWEEN 22 AND 28) THEN 1 ELSE 0 END AS Holiday,
         l_tax AS Tax
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""

STORE_DAY = SALES_FACT + """, store_day AS (
  SELECT Store, Region, Date, SUM(Sales) AS Sales, SUM(Units) AS Units, MAX(Holiday) AS Holiday,
         MAX(Discount) AS Discount, AVG(Tax) AS Tax
  FROM sales_fact GROUP BY Store, Region, Date)"""

SCOPE_DAY = SALES_FACT + """, scope_day AS (
  SELECT Date, SUM(Sales) AS Sales, SUM(Units) AS Units, MAX(Holiday) AS Holiday, AVG(Tax) AS Tax
  FROM sales_fact GROUP BY Date)"""


def _scope(name: str, part: str) -> str:
    return SALES_FACT + f""", {name} AS (
  SELECT CAST(date_trunc('{part}', Date) AS DATE) AS Date, SUM(Sales) AS Sales, SUM(Units) AS Units, MAX(Holiday) AS Holiday
  FROM sales_fact GROUP BY CAST(date_trunc('{part}', Date) AS DATE))"""


SCOPE_WEEK = _scope("scope_week", "week")
SCOPE_MONTH = _scope("scope_month", "month")

ORDERS_FACT = """orders_fact AS (
  SELECT o_orderkey AS OrderKey, CAST(o_orderdate AS DATE) AS Date, c_mktsegment AS Segment,
         o_orderpriority AS Priority, o_totalprice AS Sales
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

EVENTS_DAY = """events_day AS (
  SELECT CAST(ts AS DATE) AS Date, event_type AS Product, SUM(value) AS Sales, COUNT(*) AS Units
  FROM events GROUP BY CAST(ts AS DATE), event_type)"""

EVENTS_TOTAL = EVENTS_DAY + ", events_total AS (SELECT Date, SUM(Sales) AS Total_Sales FROM events_day GROUP BY Date)"

EVENTS_STAMP = """events_stamp AS (
  SELECT ts AS Stamp, event_id AS Event, CASE WHEN user_id % 10 < 8 THEN 'main' ELSE concat('shop_', user_id % 10) END AS Store,
         value AS Sales, CAST(CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS DOUBLE) AS Units FROM events)"""

DIRTY = """dirty_sales AS (
  SELECT CASE WHEN l_orderkey % 101 = 0 THEN 'not-a-date' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS Date,
         CASE WHEN l_orderkey % 7 = 0 THEN concat('  ', n_name, ' ') ELSE n_name END AS Store,
         CASE WHEN l_orderkey % 97 = 0 THEN 'n/a' WHEN l_orderkey % 89 = 0 THEN CAST(-l_extendedprice AS VARCHAR)
              ELSE CAST(l_extendedprice AS VARCHAR) END AS Sales,
         CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_quantity END AS Units,
         CASE WHEN l_orderkey % 43 = 0 THEN NULL WHEN l_discount >= 0.05 THEN 'Yes' ELSE 'No' END AS Discount,
         l_orderkey AS Row_ID, l_linenumber AS Line_ID, 0 AS Constant_Zero
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k) d
  WHERE k = 1 OR l_orderkey % 53 = 0)"""

TRIMMED = DIRTY + """, trimmed AS (
  SELECT DISTINCT trim(Date) AS Date, trim(Store) AS Store, trim(Sales) AS Sales, Units, trim(Discount) AS Discount,
         Row_ID, Line_ID, Constant_Zero FROM dirty_sales)"""

TYPED = TRIMMED + """, typed AS (
  SELECT TRY_CAST(Date AS DATE) AS Date, Store, greatest(TRY_CAST(Sales AS DOUBLE), 0.0) AS Sales,
         CASE WHEN Units < 0 THEN 0 ELSE Units END AS Units, Discount, Row_ID, Line_ID, Constant_Zero
  FROM trimmed WHERE TRY_CAST(Date AS DATE) IS NOT NULL AND TRY_CAST(Sales AS DOUBLE) IS NOT NULL)"""

FILLED = TYPED + """, along AS (
  SELECT * EXCLUDE (Units), coalesce(Units,
           last_value(Units IGNORE NULLS) OVER (PARTITION BY Store ORDER BY Date, Row_ID, Line_ID, Sales
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(Units IGNORE NULLS) OVER (PARTITION BY Store ORDER BY Date, Row_ID, Line_ID, Sales
                                                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS Units
  FROM typed),
  top AS (SELECT Discount AS m FROM typed WHERE Discount IS NOT NULL GROUP BY Discount ORDER BY COUNT(*) DESC, Discount LIMIT 1),
  filled AS (
  SELECT Date, Store, Sales, coalesce(Units, (SELECT median(Units) FROM along), 0) AS Units,
         coalesce(Discount, (SELECT m FROM top), 'Unknown') AS Discount, Row_ID, Line_ID, Constant_Zero FROM along)"""


def rnd_plain(expr: str, digits: int) -> str:
    """Round half away from zero on the decimal value, as Spark's ``round`` does."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def rnd(expr: str, digits: int) -> str:
    """Twin of ``registry.rounded``: a nudge far below the last digit settles ties the same way on both sides,
    whatever order the terms of a sum were added in."""
    return rnd_plain(f"({expr}) + sign({expr}) * {3 * 10.0 ** -(digits + 4):.10f}", digits)


def bounds(source: str, column: str) -> str:
    """Common table expressions ``q`` and ``b``: quartiles and range bounds of a column."""
    return f"""q AS (SELECT COUNT({column}) AS n, quantile_cont({column}, 0.25) AS q1, median({column}) AS med,
                     quantile_cont({column}, 0.75) AS q3 FROM {source}),
    b AS (SELECT n, q1, med, q3, q3 - q1 AS iqr, greatest(0.0, q1 - 1.5 * (q3 - q1)) AS lower_bound,
                 q3 + 1.5 * (q3 - q1) AS upper_bound, greatest(0.0, q1 - 3.0 * (q3 - q1)) AS extreme_lower,
                 q3 + 3.0 * (q3 - q1) AS extreme_upper FROM q)"""
