"""Parquet sources and the test panels built from the driver's tables.

The driver's tables hold no hospitality data, so the operators are exercised on
panels derived from them (survey §7.2):

* P1  ``events`` → hourly open-hour panel, no key
* P1k the same panel keyed by ``event_type``
* P2  ``orders`` ⋈ ``customer`` → daily panel keyed by ``c_mktsegment``
* P3  ``lineitem`` → daily panel keyed by ``l_suppkey`` (the bench panel)

Each panel has ``timestamp_hour`` (naive), ``orders_count``,
``food_tickets_count`` and ``sales_total``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftcast.operators.panel import hourly_rollup

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def panel_p1(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    """events → hourly panel; a purchase counts as a food ticket."""
    ev = read_table(spark, sf_dir, "events")
    keys = ["event_type"] if keyed else []
    return hourly_rollup(ev, "ts", flag=(F.col("event_type") == "purchase"), keys=keys,
                         sums={"sales_total": "value"}) \
        .withColumn("sales_total", F.round("sales_total", 4))


def panel_p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders by day and market segment; urgent/high priority = 'food' column."""
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return (o.join(c, "o_custkey")
            .groupBy("c_mktsegment", F.col("o_orderdate").alias("timestamp_hour"))
            .agg(F.count(F.lit(1)).alias("orders_count"),
                 F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("food_tickets_count"),
                 F.round(F.sum("o_totalprice"), 2).alias("sales_total")))


def panel_p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem by ship day and supplier: lines, quantity, revenue."""
    li = read_table(spark, sf_dir, "lineitem")
    return (li.groupBy("l_suppkey", F.col("l_shipdate").alias("timestamp_hour"))
            .agg(F.count(F.lit(1)).alias("orders_count"),
                 F.sum("l_quantity").cast("long").alias("food_tickets_count"),
                 F.round(F.sum("l_extendedprice"), 2).alias("sales_total")))
