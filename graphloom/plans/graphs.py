"""Graphs that the relational tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

#: Added to part numbers where orders or suppliers are vertices too.
PART_OFFSET = 1_000_000_000
#: Added to order numbers where customers are vertices too, and to the vertices of a second copy of a graph.
ORDER_OFFSET, COPY_OFFSET = 2_000_000_000, 4_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src supplier, dst part, weight 1), an edge for each line item."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PART_OFFSET).alias("dst"), F.lit(1).cast("long").alias("weight"))


def order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of orders and parts: distinct edges of weight 1, from all line items."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + PART_OFFSET).alias("dst"), F.lit(1).cast("long").alias("weight")).distinct()


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src customer, dst order, weight 1): a graph of many components, a star for each customer with orders."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").cast("long").alias("src"), (F.col("o_orderkey") + ORDER_OFFSET).alias("dst"), F.lit(1).cast("long").alias("weight"))


def linked_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two copies of the supplier-part graph, joined by an edge of weight 1 for each region, between the copies of the supplier of the region's number plus 1: a planted cut."""
    whole = supplier_parts(spark, sf_dir)
    copy = whole.select((F.col("src") + COPY_OFFSET).alias("src"), (F.col("dst") + COPY_OFFSET).alias("dst"), "weight")
    number = F.col("r_regionkey").cast("long") + 1
    bridges = table(spark, sf_dir, "region").select(number.alias("src"), (number + COPY_OFFSET).alias("dst"), F.lit(1).cast("long").alias("weight"))
    return whole.union(copy).union(bridges)


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src supplier nation, dst customer nation, weight 1), an edge for each line item.

    Line items are counted by supplier and order before the joins, so that less is shuffled; nations are few.
    """
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    by_nation = items.join(suppliers, items["l_suppkey"] == suppliers["s_suppkey"]).groupBy("l_orderkey", "s_nationkey").agg(F.count("*").alias("n"))
    joined = by_nation.join(orders, by_nation["l_orderkey"] == orders["o_orderkey"]).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.sum("n").alias("weight"))


def nation_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(old nation, new region)."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("old"), F.col("n_regionkey").cast("long").alias("new"))
