"""Inclusions: regions that reach the volume's boundary only through one other region.

With the outside as one further node, the graph falls into blocks that meet in single nodes. A block
without the outside is enclosed by the node that it hangs on, and merges into it.

Blocks are found by ears. Nodes at the root are settled; trees grow from these, one layer a join; an
edge between two trees closes a path between two settled nodes, so all nodes on it are in the root's
block and settled too. When no such edge is left, what a tree still holds hangs on its settled node,
which is the root of the next level. Layers look back at two layers only and are added to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, endpoints, relabelled
from .tables import kept


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grown(near: DataFrame, settled: DataFrame) -> DataFrame:
    """(id, start, parent) of all that near(id, other) links with settled(id), by layers of equal distance."""
    layers = [kept(settled.select("id", F.col("id").alias("start"), F.col("id").alias("parent")))]
    while True:
        step = layers[-1].select(F.col("id").alias("parent"), "start").join(near.select(F.col("id").alias("parent"), F.col("other").alias("id")), "parent")
        new = step.join(_all(layers[-2:]).select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("start", "parent")).alias("m"))
        front = kept(new.select("id", "m.start", "m.parent"))
        if front.isEmpty():
            return _all(layers)
        layers.append(front)


def root_block(near: DataFrame, settled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled, hanging(id, start)): settled(id) with all that is in one block with the root, and what hangs on it."""
    near = kept(near)
    while True:
        tree = kept(grown(near, settled))
        start = tree.select("id", "start")
        ends = near.where("id < other").join(start, "id").join(start.toDF("other", "start2"), "other").where("start != start2")
        front = ends.select(F.explode(F.array("id", "other")).alias("id")).distinct()
        marks = []
        while True:  # up the trees, until settled nodes are met
            front = kept(front.join(tree.where("id != parent"), "id").select("id", "parent"))
            if front.isEmpty():
                break
            marks.append(front.select("id"))
            front = front.select(F.col("parent").alias("id")).distinct()
        if not marks:
            return settled, tree.where("id != start").select("id", "start")
        settled = kept(settled.unionByName(_all(marks)).distinct())


def inclusions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """mapping(old, new) that merges every enclosed block of nodes(id, boundary_size) into the node it hangs on.

    Edges(node1, node2) may bring preserve and false_edge: false ones do not count, and a block of which a
    node other than the one it hangs on has a preserved edge stays. Parts of the graph without any
    boundary stay as they are, as nothing encloses them. Blocks in merged blocks go with these. Nulls in
    boundary_size count as 0; an edge given twice is one; an empty graph gives no rows.
    """
    own = nodes.select("id", F.coalesce("boundary_size", F.lit(0)).alias("boundary_size"))
    true = edges.where(~F.coalesce("false_edge", F.lit(False))) if "false_edge" in edges.columns else edges
    near = kept(endpoints(true).where("id != other").distinct())
    _, hanging = root_block(near, kept(own.where("boundary_size > 0").select("id")))
    hanging = kept(hanging)
    guarded = None
    if "preserve" in edges.columns:
        guarded = kept(endpoints(edges.where("preserve")).select("id").join(hanging, "id", "left_semi").distinct())
    if guarded is None or guarded.isEmpty():
        return hanging.select(F.col("id").alias("old"), F.col("start").alias("new"))
    mapping = nodes.sparkSession.createDataFrame([], "old long, new long")
    while not hanging.isEmpty():
        group = hanging.select("id", F.col("start").alias("root"))
        inside = kept(near.join(group, "id").join(group.toDF("other", "root2"), "other").where("root = root2").select("id", "other"))
        first = kept(group.join(near, "id").where("other = root").select("id").distinct())
        settled, deeper = root_block(inside, first)
        part = components(inside.select(F.col("id").alias("node1"), F.col("other").alias("node2"))).toDF("id", "part")
        block = settled.join(group, "id").join(part, "id", "left").select("id", "root", F.coalesce("part", "id").alias("part"))
        block = kept(block)
        stays = block.join(guarded, "id", "left_semi").select("part").distinct()
        merged = block.join(stays, "part", "left_anti").select(F.col("id").alias("old"), F.col("root").alias("new"))
        mapping = kept(mapping.unionByName(relabelled(merged, mapping, "new")))
        hanging = kept(deeper)
    return mapping
