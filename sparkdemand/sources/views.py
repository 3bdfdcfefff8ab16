"""Sales-shaped views over the star schema (the inputs of the registered queries).

No broadcast hints: the dimension tables may grow with the facts, so the choice is left to Spark's
size check (``autoBroadcastJoinThreshold``) and AQE's skew-join splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SCHEMAS: dict[str, StructType] = {}


#: Session setting: deal the fact table's rows into so many pieces after the scan.  Unset (the default, and right for tables of
#: many files) nothing is dealt; it is for a fact table that is one row group, which otherwise is one task.
PIECES = "spark.sparkdemand.factPieces"


def _facts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pieces = spark.conf.get(PIECES, None)
    rows = table(spark, sf_dir, name)
    return rows.repartition(int(pieces)) if pieces else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the star schema.  Its schema is read from the footers once per path, not once per query."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _with_store(lines: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add Store and Region through the supplier.

    A left-deep chain: the small tables are independent of each other, so their broadcasts run side by side
    instead of one waiting for the next.
    """
    return (
        lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumnsRenamed({"n_name": "Store", "r_name": "Region"})
    )


def sales_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with sales, units, store, product and the two event flags."""
    ship = F.col("l_shipdate").cast("date")
    m, d = F.month(ship), F.dayofmonth(ship)
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("Product"), F.col("p_type").alias("Category")
    )
    lines = _facts(spark, sf_dir, "lineitem")
    return (
        _with_store(lines, spark, sf_dir)
        .join(part, "l_partkey")
        .select(
            F.col("l_orderkey").alias("OrderKey"),
            F.col("l_linenumber").alias("LineNo"),
            ship.alias("Date"),
            "Store",
            "Product",
            "Category",
            "Region",
            F.col("l_extendedprice").alias("Sales"),
            F.col("l_quantity").alias("Units"),
            F.when(F.col("l_discount") >= 0.05, "Yes").otherwise("No").alias("Discount"),
            F.when(((m == 12) & (d >= 20)) | ((m == 11) & d.between(22, 28)), 1).otherwise(0).alias("Holiday"),
            F.col("l_tax").alias("Tax"),
        )
    )


def store_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity scope: one row per store and date."""
    return (
        sales_fact(spark, sf_dir)
        .groupBy("Store", "Region", "Date")
        .agg(
            F.sum("Sales").alias("Sales"),
            F.sum("Units").alias("Units"),
            F.max("Holiday").alias("Holiday"),
            F.max("Discount").alias("Discount"),
            F.avg("Tax").alias("Tax"),
        )
    )


def _scope(spark: SparkSession, sf_dir: str, date) -> DataFrame:
    return (
        sales_fact(spark, sf_dir)
        .groupBy(date.alias("Date"))
        .agg(F.sum("Sales").alias("Sales"), F.sum("Units").alias("Units"), F.max("Holiday").alias("Holiday"))
    )


def scope_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset scope, daily."""
    return (
        sales_fact(spark, sf_dir)
        .groupBy("Date")
        .agg(
            F.sum("Sales").alias("Sales"),
            F.sum("Units").alias("Units"),
            F.max("Holiday").alias("Holiday"),
            F.avg("Tax").alias("Tax"),
        )
    )


def scope_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset scope, weekly (weeks start on Monday)."""
    return _scope(spark, sf_dir, F.trunc("Date", "week"))


def scope_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset scope, monthly."""
    return _scope(spark, sf_dir, F.trunc("Date", "month"))


def orders_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second fact without a units column."""
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("Segment")
    )
    return (
        table(spark, sf_dir, "orders")
        .join(customer, "o_custkey")
        .select(
            F.col("o_orderkey").alias("OrderKey"),
            F.col("o_orderdate").cast("date").alias("Date"),
            "Segment",
            F.col("o_orderpriority").alias("Priority"),
            F.col("o_totalprice").alias("Sales"),
        )
    )


def events_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short history: 30 days by event type."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("ts").cast("date").alias("Date"), F.col("event_type").alias("Product"))
        .agg(F.sum("value").alias("Sales"), F.count(F.lit(1)).alias("Units"))
    )


def events_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long series: one row per time stamp, store and event.  One store holds most of the rows."""
    shop = F.col("user_id") % 10
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("Stamp"),
        F.col("event_id").alias("Event"),
        F.when(shop < 8, "main").otherwise(F.concat(F.lit("shop_"), shop.cast("string"))).alias("Store"),
        F.col("value").alias("Sales"),
        F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("user_id")).cast("double").alias("Units"),
    )


def dirty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with bad dates, text targets, negatives, padded names, nulls and exact copies."""
    key = F.col("l_orderkey")
    copies = F.when(key % 53 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    price = F.col("l_extendedprice")
    lines = _facts(spark, sf_dir, "lineitem")
    return (
        _with_store(lines, spark, sf_dir)
        .withColumn("k", F.explode(copies))
        .select(
            F.when(key % 101 == 0, "not-a-date").otherwise(F.col("l_shipdate").cast("date").cast("string")).alias("Date"),
            F.when(key % 7 == 0, F.concat(F.lit("  "), F.col("Store"), F.lit(" "))).otherwise(F.col("Store")).alias("Store"),
            F.when(key % 97 == 0, "n/a")
            .when(key % 89 == 0, (-price).cast("string"))
            .otherwise(price.cast("string"))
            .alias("Sales"),
            F.when(key % 31 == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("Units"),
            F.when(key % 43 == 0, F.lit(None))
            .when(F.col("l_discount") >= 0.05, "Yes")
            .otherwise("No")
            .alias("Discount"),
            key.alias("Row_ID"),
            F.col("l_linenumber").alias("Line_ID"),
            F.lit(0).alias("Constant_Zero"),
        )
    )
