"""Graph, synapse, exclusion and recipe documents in JSON, and edge lists as text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH_SCHEMA = (
    "edge_list array<struct<node1: long, node2: long, size1: long, size2: long, weight: double, edge_size: long, preserve: boolean, false_edge: boolean, location: array<int>>>,"
    "orphan_bodies array<long>, synapse_bodies array<array<long>>"
)
SYNAPSE_SCHEMA = (
    "data array<struct<`T-bar`: struct<status: string, confidence: double, `body ID`: long, location: array<int>>,"
    "partners: array<struct<confidence: double, `body ID`: long, location: array<int>>>>>"
)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph documents; missing keys take their defaults, the first mention of a node or edge wins.

    A node listed as an orphan has no boundary; all others get a boundary of one.
    """
    doc = spark.read.schema(GRAPH_SCHEMA).json(path, multiLine=True).withColumn("_file", F.input_file_name())
    rows = doc.select("_file", F.posexplode("edge_list").alias("pos", "e"))
    default = {"size1": 1, "size2": 1, "weight": 0.0, "edge_size": 5, "preserve": False, "false_edge": False}
    e = rows.select("_file", "pos", "e.*").fillna(default)
    first = lambda keys, cols: F.min(F.struct("_file", "pos", *cols)).alias("_r")
    pairs = e.withColumns({"a": F.least("node1", "node2"), "b": F.greatest("node1", "node2")})
    kept = ["weight", "edge_size", "preserve", "false_edge", "location"]
    edges = pairs.groupBy("a", "b").agg(first(None, kept)).select(F.col("a").alias("node1"), F.col("b").alias("node2"), *[F.col(f"_r.{c}") for c in kept])
    ends = e.select("_file", (F.col("pos") * 2).alias("pos"), F.col("node1").alias("id"), F.col("size1").alias("size")).unionAll(e.select("_file", F.col("pos") * 2 + 1, "node2", "size2"))
    nodes = ends.groupBy("id").agg(first(None, ["size"])).select("id", F.col("_r.size").alias("size"))
    orphans = doc.select(F.explode("orphan_bodies").alias("id")).distinct().withColumn("_o", F.lit(0))
    return nodes.join(orphans, "id", "left").select("id", "size", F.coalesce("_o", F.lit(1)).cast("long").alias("boundary_size")), edges


def edge_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): one JSON object an edge, with both sizes; absent values are left out. One line an edge scales to any graph."""
    one = nodes.select(F.col("id").alias("node1"), F.col("size").alias("size1"))
    two = nodes.select(F.col("id").alias("node2"), F.col("size").alias("size2"))
    return edges.join(one, "node1").join(two, "node2").select(F.to_json(F.struct("node1", "node2", "size1", "size2", *[c for c in edges.columns if c not in ("node1", "node2")])).alias("value"))


def write_edges(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    edge_documents(nodes, edges).write.mode("overwrite").text(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges that write_edges wrote."""
    item = "node1 long, node2 long, size1 long, size2 long, weight double, edge_size long, preserve boolean, false_edge boolean, location array<int>"
    return spark.read.schema(item).json(path)


def edge_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): lines `node1 node2 size1 size2 weight edge_size`."""
    one = nodes.select(F.col("id").alias("node1"), F.col("size").alias("size1"))
    two = nodes.select(F.col("id").alias("node2"), F.col("size").alias("size2"))
    return edges.join(one, "node1").join(two, "node2").select(F.concat_ws(" ", "node1", "node2", "size1", "size2", "weight", "edge_size").alias("value"))


def labelled_edges(edges: DataFrame, text: DataFrame) -> DataFrame:
    """edges with the label of lines `u v label` in text(value), whichever way round they name an edge."""
    part = F.split(F.trim("value"), r"\s+")
    rows = text.where(F.size(part) >= 3).select(F.least(part[0].cast("long"), part[1].cast("long")).alias("node1"), F.greatest(part[0].cast("long"), part[1].cast("long")).alias("node2"), part[2].cast("int").alias("label"))
    return edges.join(rows, ["node1", "node2"])


def read_synapses(spark: SparkSession, path: str, y_size: int | None = None, offset: tuple[int, int, int] = (0, 0, 0), roi: tuple[int, int, int] | None = None) -> DataFrame:
    """(syn, pos, x, y, z): T-bar (pos 0) and partners; y is flipped where y_size is given; points outside the ROI go."""
    doc = spark.read.schema(SYNAPSE_SCHEMA).json(path, multiLine=True).withColumn("_file", F.input_file_name())
    rows = doc.select("_file", F.posexplode("data").alias("n", "s")).select(F.concat_ws("#", "_file", "n").alias("syn"), F.posexplode(F.concat(F.array("s.`T-bar`.location"), F.transform(F.col("s.partners"), lambda p: p["location"]))).alias("pos", "l"))
    at = rows.select("syn", "pos", *[(F.col("l")[i] - offset[i]).alias(c) for i, c in enumerate("xyz")])
    if y_size is not None:
        at = at.withColumn("y", F.lit(y_size) - F.col("y") - 1)
    for c, top in zip("xyz", roi or ()):
        at = at.where((F.col(c) > 0) & (F.col(c) < top))
    return at


def read_ids(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(id) of a document {key: [ids]}, such as exclusions or body lists."""
    return spark.read.schema(f"`{key}` array<long>").json(path, multiLine=True).select(F.explode(key).alias("id"))


#: Defaults of recipe steps (fixed values).
RECIPE_DEFAULTS = {
    "body": {"threshold": 25000.0, "upper-prob": 0.99, "path-length": 0},
    "synapse": {"threshold": 0.1, "upper-prob": 0.99, "path-length": 0},
    "edge": {"lower-prob": 0.0, "upper-prob": 0.9, "starting-prob": 0.0},
    "orphan": {"threshold": 25000.0},
}


def recipe_steps(text: str) -> list[dict]:
    """The steps of a recipe, a small driver-side document, with defaults filled in."""
    steps = json.loads(text)["recipe"]
    for s in steps:
        if s["type"] not in RECIPE_DEFAULTS:
            raise ValueError(f"unknown step {s['type']}")
    return [{**RECIPE_DEFAULTS[s["type"]], **s} for s in steps]
