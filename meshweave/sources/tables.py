"""Graphs from the tables of orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshweave.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_arcs(spark: SparkSession, sf_dir: str, partners: int = 3) -> DataFrame:
    """Rows (src, dst, weight): each supplier's partners that it shares most orders with."""
    of = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    met = of.join(of.withColumnRenamed("l_suppkey", "other"), "l_orderkey").where("l_suppkey <> other").groupBy("l_suppkey", "other").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("l_suppkey").orderBy(F.desc("n"), "other"))
    return met.withColumn("r", rank).where(F.col("r") <= partners).select(F.col("l_suppkey").cast("string").alias("src"), F.col("other").cast("string").alias("dst"), F.col("n").cast("double").alias("weight"))


def suppliers(spark: SparkSession, sf_dir: str, directed: bool = False, weighted: bool = False) -> Graph:
    """Suppliers and their main partners; without directions, an edge if either says so,
    its weight the orders that both are in."""
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    arcs = supplier_arcs(spark, sf_dir)
    if not directed:
        arcs = arcs.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))
    return Graph.of(nodes, arcs if weighted else arcs.drop("weight"), directed, weighted, check=False).stashed()


def users(spark: SparkSession, sf_dir: str, weighted: bool = False) -> Graph:
    """An arc from each purchaser to the next one in time; its weight how often. Purchases
    are ordered day by day, and each day's last is tied to the next day's first."""
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.to_date("ts").alias("day"))
    order = W.partitionBy("day").orderBy("ts", "event_id")
    inside = bought.withColumn("next", F.lead("user_id").over(order))
    key = F.struct("ts", "event_id", "user_id")
    ends = bought.groupBy("day").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    over = ends.select(F.col("hi.user_id").alias("user_id"), F.lead("lo.user_id").over(W.orderBy("day")).alias("next"))  # a row per day
    arcs = inside.select("user_id", "next").unionByName(over).where("next is not null and user_id <> next").groupBy(F.col("user_id").cast("string").alias("src"), F.col("next").cast("string").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    nodes = bought.select(F.col("user_id").cast("string").alias("id")).distinct()
    return Graph.of(nodes, arcs if weighted else arcs.drop("weight"), True, weighted, check=False).stashed()


def nations(spark: SparkSession, sf_dir: str) -> Graph:
    """An arc from a supplier's nation to a customer's; its weight the line items."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("src"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("dst"))
    arcs = items.join(s, "l_suppkey").join(o, "l_orderkey").join(c, "c_custkey").groupBy("src", "dst").agg(F.sum("n").cast("double").alias("weight"))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"))
    return Graph.of(nodes, arcs, True, True, check=False).stashed()


def links(spark: SparkSession, sf_dir: str) -> Graph:
    """Pages and what they link to."""
    arcs = table(spark, sf_dir, "pages").select(F.col("url").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))).alias("dst")).where("dst <> ''").distinct()
    nodes = arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Graph.of(nodes, arcs, True, False, check=False).stashed()
