"""Graphs that the driver's tables hold, each with the SQL of its vertices and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..sources.shared import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order and the same customer's next."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(order).alias("dst"))
    return orders.filter("dst IS NOT NULL")


def order_chains(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.with_vertices(order_edges(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))


def part_supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))


def parts_and_suppliers(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts (even ids) and suppliers (odd ids), an edge for each line item; undirected."""
    return Graph.from_edges(part_supplier_edges(spark, sf_dir), directed=False)


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's user and the next event's; the edge value is the event's value."""
    # One sequence over all events: ranges of it are sorted by themselves, and each one's last event meets the next one's first.
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", "value")
    path = scratch(spark, "events")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events.repartitionByRange(n, "ts", "event_id").withColumn("part", F.spark_partition_id()).write.parquet(path)
    events = spark.read.parquet(path)
    within = events.withColumn("next", F.lead("user_id").over(Window.partitionBy("part").orderBy("ts", "event_id")))
    firsts = events.groupBy("part").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    following = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("then"))  # a row for each range
    joined = within.join(F.broadcast(following), "part").withColumn("dst", F.coalesce("next", "then"))
    return joined.filter("dst IS NOT NULL").select(F.col("user_id").alias("src"), "dst", F.col("value").alias("e"))


def users(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.from_edges(user_edges(spark, sf_dir))


def geography(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers to their nations to their regions; ids are offset for each table."""
    up = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).alias("src"), (F.col("c_nationkey") + 100).cast("long").alias("dst"))
    top = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    return Graph.from_edges(up.unionByName(top))


ORDERS_SQL = """
    e AS (SELECT * FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL),
    v AS (SELECT o_orderkey AS id FROM orders)"""
PARTS_SQL = """
    one AS (SELECT 2 * l_partkey AS src, 2 * l_suppkey + 1 AS dst FROM lineitem),
    e AS (SELECT src, dst FROM one UNION ALL SELECT dst, src FROM one),
    v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"""
USERS_SQL = """
    e AS (SELECT * FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, value AS e FROM events) WHERE dst IS NOT NULL),
    v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"""
GEO_SQL = """
    e AS (SELECT c_custkey + 1000 AS src, (c_nationkey + 100)::BIGINT AS dst FROM customer UNION ALL SELECT (n_nationkey + 100)::BIGINT, n_regionkey::BIGINT FROM nation),
    v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"""
