"""The ordinary relational surface over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.session import table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(price), 2).alias("sum_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"),
        F.count("*").alias("n"),
    )


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-way join; the dimension sides are small enough for Spark to broadcast by size."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    met = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return met.groupBy("r_name", "n_name").agg(F.round(F.sum("price"), 2).alias("revenue"))


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


def segment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return met.rollup("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def part_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").cube("p_brand", "p_size").agg(F.count("*").alias("n"))


def top_orders_per_customer(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place")).filter(F.col("place") <= k)


def running_order_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(frame), 2).alias("running"), F.lag("o_orderkey").over(w).alias("before"))


def brand_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of small parts that no large part has, and those of both."""
    part = table(spark, sf_dir, "part")
    small, large = part.filter("p_size < 10").select("p_brand", "p_type"), part.filter("p_size > 40").select("p_brand", "p_type")
    only = small.exceptAll(large).distinct().withColumn("side", F.lit("except"))
    both = small.intersect(large).withColumn("side", F.lit("intersect"))
    return only.unionByName(both)


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


def last_order_before_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: the newest order of the same key at or before each purchase.

    Both sides go through one sort by key and time, and the last order is carried on.
    """
    first = F.lit("2024-01-01").cast("timestamp")
    left = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("k"), "ts", "event_id", F.lit(None).cast("long").alias("o_orderkey"), F.lit(1).alias("side"))
    day = F.timestamp_add("DAY", (F.col("o_orderkey") % 30).cast("int"), first)
    right = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), day.alias("ts"), F.lit(None).cast("long").alias("event_id"), "o_orderkey", F.lit(0).alias("side"))
    w = Window.partitionBy("k").orderBy("ts", "side", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = left.unionByName(right).withColumn("last_order", F.last("o_orderkey", ignorenulls=True).over(w))
    return met.filter("side = 1").select("event_id", "last_order")


def distinct_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))
