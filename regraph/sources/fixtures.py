"""Voxel grids, region graphs and body tables derived from the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """voxels(x, y, z, p0, p1, seg, gt): coordinates from line items, segments in blocks with background and inclusions."""
    items = load(spark, sf_dir, "lineitem")
    cells = items.groupBy((F.col("l_orderkey") % 24).cast("int").alias("x"), (F.col("l_partkey") % 24).cast("int").alias("y"), F.col("l_linenumber").cast("int").alias("z")).agg(
        F.min("l_suppkey").alias("s"),
        F.round(F.least(F.lit(1.0), F.avg("l_discount") * 10), 6).alias("p0"),
        F.round(F.least(F.lit(1.0), F.avg("l_tax") * 10), 6).alias("p1"),
    )
    part = lambda c, n: F.floor(F.col(c) / n).cast("int")
    seg = F.when(F.col("s") % 9 == 4, 0).when(F.col("s") % 9 == 7, 101 + part("x", 12)).otherwise(1 + part("x", 6) + 4 * part("y", 6))
    return cells.select("x", "y", "z", "p0", "p1", seg.cast("int").alias("seg"), (1 + part("x", 12) + 2 * part("y", 8)).cast("int").alias("gt"))


VOX_SQL = """
g AS (
  SELECT CAST(l_orderkey % 24 AS INT) x, CAST(l_partkey % 24 AS INT) y, CAST(l_linenumber AS INT) z,
         min(l_suppkey) s, least(1.0, avg(l_discount) * 10) p0, least(1.0, avg(l_tax) * 10) p1
  FROM lineitem GROUP BY 1, 2, 3
), vox AS (
  SELECT x, y, z, round(p0, 6) p0, round(p1, 6) p1,
    CASE WHEN s % 9 = 4 THEN 0 WHEN s % 9 = 7 THEN 101 + CAST(floor(x / 12.0) AS INT)
         ELSE 1 + CAST(floor(x / 6.0) AS INT) + 4 * CAST(floor(y / 6.0) AS INT) END seg,
    1 + CAST(floor(x / 12.0) AS INT) + 2 * CAST(floor(y / 8.0) AS INT) gt
  FROM g
)"""


def grown_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """voxels(x, y, z, p0, p1, seg, gt) whose x side grows with the line items: a cell per order and line, 64 orders a plane."""
    items = load(spark, sf_dir, "lineitem")
    cells = items.groupBy(F.floor(F.col("l_orderkey") / 64).cast("long").alias("x"), (F.col("l_orderkey") % 64).alias("y"), F.col("l_linenumber").cast("long").alias("z")).agg(
        F.min("l_suppkey").alias("s"), *(F.round(F.least(F.lit(1.0), F.max(c) * 10), 6).alias(p) for c, p in (("l_discount", "p0"), ("l_tax", "p1")))
    )
    block = lambda a, b: 1 + F.floor(F.col("x") / a) * 16 + F.floor(F.col("y") / b)
    seg = F.when(F.col("s") % 9 == 4, 0).when(F.col("s") % 27 == 7, -1 - F.floor(F.col("x") / 24)).otherwise(block(6, 6))
    return cells.select("x", "y", "z", "p0", "p1", seg.cast("long").alias("seg"), block(12, 8).cast("long").alias("gt"))


GROWN_SQL = """
g AS (
  SELECT l_orderkey // 64 x, l_orderkey % 64 y, CAST(l_linenumber AS BIGINT) z, min(l_suppkey) s,
         round(least(1.0, max(l_discount) * 10), 6) p0, round(least(1.0, max(l_tax) * 10), 6) p1
  FROM lineitem GROUP BY 1, 2, 3
), vox AS MATERIALIZED (
  SELECT x, y, z, p0, p1, CASE WHEN s % 9 = 4 THEN 0 WHEN s % 27 = 7 THEN -1 - x // 24 ELSE 1 + x // 6 * 16 + y // 6 END seg,
    1 + x // 12 * 16 + y // 8 gt
  FROM g
)"""


#: Line items of a task of the part graph; an item makes some two edges (fixed value).
TASK_ITEMS = 100_000


def part_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that the part graph's edges are dealt to: they grow with the line items, so that a task's memory does not."""
    return max(spark.sparkContext.defaultParallelism, -(-load(spark, sf_dir, "lineitem").count() // TASK_ITEMS))


def part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, size, boundary_size), edges(node1, node2, edge_size, weight)): parts bought together."""
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") + 1).alias("id"), "l_linenumber")
    tasks = part_tasks(spark, sf_dir)
    nodes = items.groupBy("id").agg(F.count(F.lit(1)).alias("size"), F.sum(F.when(F.col("l_linenumber") == 7, 1).otherwise(0)).alias("boundary_size"))
    own = items.select("l_orderkey", "id").repartition(tasks, "l_orderkey").distinct()
    pairs = own.select("l_orderkey", F.col("id").alias("node1")).join(own.select("l_orderkey", F.col("id").alias("node2")), "l_orderkey").where("node1 < node2")
    weight = ((F.col("node1") * 31 + F.col("node2") * 17) % 100).cast("double") / F.lit(100.0)
    return nodes, pairs.repartition(tasks, "node1", "node2").groupBy("node1", "node2").agg(F.count(F.lit(1)).alias("edge_size")).withColumn("weight", weight)


RAG_SQL = """
i AS (SELECT l_orderkey o, l_partkey + 1 id, l_linenumber n FROM lineitem
), nodes AS (SELECT id, count(*) size, CAST(sum(CASE WHEN n = 7 THEN 1 ELSE 0 END) AS BIGINT) boundary_size FROM i GROUP BY id
), d AS (SELECT DISTINCT o, id FROM i
), edges AS (
  SELECT a.id node1, b.id node2, count(*) edge_size, CAST((a.id * 31 + b.id * 17) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) weight
  FROM d a JOIN d b ON a.o = b.o AND a.id < b.id GROUP BY 1, 2
)"""


def synapse_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """synapses(syn, pos, x, y, z): orders as synapses, their first line the T-bar and the others its partners."""
    items = load(spark, sf_dir, "lineitem")
    rows = items.groupBy(F.col("l_orderkey").alias("syn"), F.col("l_linenumber").cast("int").alias("pos")).agg(F.min("l_partkey").alias("p"))
    return rows.select("syn", "pos", (F.col("syn") % 24).cast("int").alias("x"), (F.col("p") % 24).cast("int").alias("y"), F.col("pos").alias("z"))


SYN_SQL = """
syn AS (
  SELECT l_orderkey syn, CAST(l_linenumber AS INT) pos, CAST(l_orderkey % 24 AS INT) x, CAST(min(l_partkey) % 24 AS INT) y, CAST(l_linenumber AS INT) z
  FROM lineitem GROUP BY l_orderkey, l_linenumber
)"""
