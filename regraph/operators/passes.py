"""Passes around agglomeration: mitochondria into their neighbours, two thresholds, random and greedy orders."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import mito_ratio
from .agglomeration import agglomerated
from .graph import canonical, contracted, degrees, endpoints, relabelled
from .inclusions import inclusions
from .tables import kept


def mito_keys(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(mito, other, key): edges of a mitochondrion (mito_type 2) with a region (1) no smaller; key is 1 less its share of the border."""
    border = degrees(nodes, edges).select("id", "border")
    both = endpoints(edges, "edge_size").join(nodes.select("id", "size", "mito_type").where("mito_type = 2").join(border, "id"), "id")
    other = nodes.select(F.col("id").alias("other"), F.col("size").alias("size2"), F.col("mito_type").alias("type2")).where("type2 = 1")
    ratio = mito_ratio(F.col("edge_size"), F.col("border"), F.col("mito_type"), F.col("type2"), F.col("size"), F.col("size2"))
    return both.join(other, "other").select(F.col("id").alias("mito"), "other", (1 - ratio).alias("key")).where("key < 1")


def mito_merged(nodes: DataFrame, edges: DataFrame, threshold: float = 0.8) -> DataFrame:
    """mapping(old, new): mitochondria merged into the neighbour of smallest key below the threshold.

    In each round every mitochondrion takes its smallest (key, other); all are merged at once, regions
    stay regions, borders are summed anew, and rounds end when no key is below the threshold. A queue
    would score neighbours of a mitochondrion after each merge; here that is after each round.
    nodes(id, size, boundary_size, mito_type), edges(node1, node2, edge_size).
    """
    nodes = kept(nodes.select("id", "size", "boundary_size", "mito_type"))
    edges = kept(edges.select("node1", "node2", "edge_size"))
    mapping = nodes.sparkSession.createDataFrame([], "old long, new long")
    while True:
        pick = mito_keys(nodes, edges).where(F.col("key") < threshold).groupBy("mito").agg(F.min(F.struct("key", "other")).alias("m"))
        step = kept(pick.select(F.col("mito").alias("old"), F.col("m.other").alias("new")))
        if step.isEmpty():
            return mapping
        mapping = kept(relabelled(mapping, step, "new").unionByName(step))
        nodes = kept(relabelled(nodes, step, "id").groupBy("id").agg(F.sum("size").alias("size"), F.sum("boundary_size").alias("boundary_size"), F.min("mito_type").alias("mito_type")))
        moved = canonical(relabelled(edges, step, "node1", "node2")).where("node1 != node2")
        edges = kept(moved.groupBy("node1", "node2").agg(F.sum("edge_size").alias("edge_size")))


def composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """mapping(old, new) of two mappings, one after the other."""
    return relabelled(first, then, "new").unionByName(then.join(first.select("old"), "old", "left_anti"))


def two_step(nodes: DataFrame, edges: DataFrame, threshold: float, score: Callable[[DataFrame, DataFrame], DataFrame] | None = None, first: float = 0.06) -> DataFrame:
    """mapping(old, new): agglomerated at `first`, inclusions removed, open edges scored anew, agglomerated at the threshold.

    score(nodes, edges) returns edges with new weights; without it the merged weights go on. A threshold
    of 0 leaves all as it is.
    """
    if threshold == 0:
        return nodes.sparkSession.createDataFrame([], "old long, new long")
    less, merged, mapping = agglomerated(nodes, edges, first)
    merged = kept(merged)
    inside = kept(inclusions(less, merged))
    less, merged = contracted(less, merged, inside)
    mapping = composed(mapping, inside)
    less, merged = kept(less), kept(score(less, merged) if score else merged)
    return kept(composed(mapping, agglomerated(less, merged, threshold)[2]))


def random_priority(edges: DataFrame, threshold: float, seed: int = 1) -> DataFrame:
    """(node1, node2, priority): edges up to the threshold with an even draw from [0, threshold) of their ends and the seed."""
    draw = F.conv(F.substring(F.md5(F.concat_ws("-", "node1", "node2", F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32)
    return edges.where(F.col("weight") <= threshold).select("node1", "node2", (draw * threshold).alias("priority"))


def greedy_seeds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): nodes by descending (degree, then ascending id), each taken unless a neighbour was.

    In each round a node is taken if it comes before all its open neighbours, and these are closed: the
    same set as one by one. Pairs with a closed node go, so rounds have ever fewer pairs. Nodes without
    edges are all taken.
    """
    pairs = kept(canonical(edges.select("node1", "node2")).where("node1 != node2").distinct())
    degree = endpoints(pairs).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    rank = kept(nodes.select("id").distinct().join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree")))
    both = pairs.join(rank.toDF("node1", "degree1"), "node1").join(rank.toDF("node2", "degree2"), "node2")
    ends = F.when(F.col("degree1") >= F.col("degree2"), F.struct(F.col("node2").alias("id"), F.col("node1").alias("other"))).otherwise(F.struct(F.col("node1").alias("id"), F.col("node2").alias("other")))
    before = kept(both.select(ends.alias("_e")).select("_e.*"))  # other comes before id; only pairs of open nodes stay
    taken, open_ = [], rank.select("id")
    while not open_.isEmpty():
        taken.append(kept(open_.join(before.select("id").distinct(), "id", "left_anti")))
        gone = kept(before.join(taken[-1].toDF("other"), "other", "left_semi").select("id").distinct())
        open_ = kept(open_.join(taken[-1].unionByName(gone), "id", "left_anti"))
        before = kept(before.join(gone, "id", "left_anti").join(gone.toDF("other"), "other", "left_anti"))
    return rank.join(reduce(DataFrame.unionByName, taken), "id", "left_semi") if taken else rank.limit(0)


def small_segments(paths: DataFrame, large: DataFrame, small: DataFrame, gt: DataFrame, depth: int = 2) -> DataFrame:
    """One row: how often the best paths from small to large bodies are right.

    paths(head, id, prob) that join one of large(id) and one of small(id, size), best first; each small
    body is looked at `depth` times at most. Both ends need a label in gt(id, gt): equal labels are
    correct, a label that no large body has is an orphan, others are incorrect. `left` counts the small
    bodies less the correct ones.
    """
    big = large.select("id").distinct()
    rest = small.select("id", "size").join(big, "id", "left_anti")
    ends = paths.select("head", "id", "prob", F.explode(F.array(F.struct(F.col("head").alias("frag"), F.col("id").alias("body")), F.struct(F.col("id").alias("frag"), F.col("head").alias("body")))).alias("e")).select("head", "id", "prob", "e.*")
    rows = ends.join(rest.toDF("frag", "size"), "frag").join(big.toDF("body"), "body", "left_semi")
    w = Window.partitionBy("frag").orderBy(F.desc("prob"), F.desc("head"), F.desc("id"))
    rows = rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= depth)
    known = gt.join(big, "id", "left_semi").select(F.col("gt").alias("gt1")).distinct().withColumn("covered", F.lit(True))
    rows = rows.join(gt.toDF("frag", "gt1"), "frag").join(gt.toDF("body", "gt2"), "body").join(known, "gt1", "left")
    kind = F.when(F.col("gt1") == F.col("gt2"), "correct").when(F.col("covered"), "incorrect").otherwise("orphan")
    parts = [f for k in ("correct", "incorrect", "orphan") for f in (F.sum((F.col("kind") == k).cast("long")).alias(k), F.sum(F.when(F.col("kind") == k, F.col("size")).otherwise(0)).alias(f"{k}_size"))]
    sums = rows.withColumn("kind", kind).agg(*parts).na.fill(0)
    return sums.join(rest.agg(F.count(F.lit(1)).alias("n"))).withColumn("left", F.col("n") - F.col("correct")).drop("n")  # two single rows


def second_locations(locations: DataFrame, voxels: DataFrame, label: str = "seg") -> DataFrame:
    """(node1, node2, x1, y1, z1, x2, y2, z2): a voxel of node1 and the neighbour on node2 of each edge's location.

    Of the located voxel's neighbours +x, +y, -x, -y, -z the first on the other node is taken, else +z.
    """
    steps = [(1, 0, 0), (0, 1, 0), (-1, 0, 0), (0, -1, 0), (0, 0, -1)]
    at = voxels.select("x", "y", "z", F.col(label).cast("long").alias("own"))
    rows = locations.select("node1", "node2", "x", "y", "z").join(at, ["x", "y", "z"])
    rows = rows.withColumn("other", F.when(F.col("node2") == F.col("own"), F.col("node1")).otherwise(F.col("node2")))
    tries = F.array(*[F.struct(F.lit(i).alias("turn"), *[(F.col(c) + d).alias(f"n{c}") for c, d in zip("xyz", s)]) for i, s in enumerate(steps)])
    there = rows.select("node1", "node2", "other", F.explode(tries).alias("t")).select("node1", "node2", "other", "t.*")
    near = at.toDF("nx", "ny", "nz", "other")
    first = there.join(near, ["nx", "ny", "nz", "other"]).groupBy("node1", "node2").agg(F.min(F.struct("turn", "nx", "ny", "nz")).alias("m"))
    both = rows.join(first, ["node1", "node2"], "left")
    here, above = F.struct("x", "y", "z"), F.struct("x", "y", (F.col("z") + 1).alias("z"))
    found = F.when(F.col("m").isNull(), above).otherwise(F.struct(F.col("m.nx").alias("x"), F.col("m.ny").alias("y"), F.col("m.nz").alias("z")))
    one, two = F.when(F.col("own") == F.col("node2"), found).otherwise(here), F.when(F.col("own") == F.col("node2"), here).otherwise(found)
    out = both.select("node1", "node2", one.alias("p"), two.alias("q"))
    return out.select("node1", "node2", *[F.col(f"{s}.{c}").alias(f"{c}{i}") for s, i in (("p", 1), ("q", 2)) for c in "xyz"])


def combined_states(one: DataFrame, two: DataFrame, at: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Edge states(node1, node2, weight, *at, sums) of two blocks, merged: sums add, the place of the larger weight stays, the first's where equal."""
    keys, place = ("node1", "node2"), F.struct(*at)
    rows = one.withColumn("_p", F.lit(0)).unionByName(two.withColumn("_p", F.lit(-1)))
    rest = [c for c in one.columns if c not in (*keys, *at)]
    out = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rest], F.max_by(place, F.struct("weight", "_p")).alias("_at"))
    return out.select(*keys, *rest, *[F.col(f"_at.{c}").alias(c) for c in at])


def saved_probs(edges: DataFrame) -> DataFrame:
    """edges with orig_prob set to save_prob."""
    return edges.withColumn("orig_prob", F.col("save_prob"))
