"""Labels with a history: merges and splits as event tables, read back as of any step.

merges(step, remove, keep) put the body of `remove` into that of `keep`; splits(step, label, head) take
single labels out of their bodies and into a new body named by their head, which is among them. Steps
are not negative; at one step splits come before merges.

A body has a version: -1 until it is first the head of a split, then the step of its last split. A label
belongs to the body it was last split into, and whole bodies move by merges: these form a forest over
(body, version), along which steps grow, so the label at step t is where the edges up to t end. Nothing is
rewritten, and undoing is reading an earlier step. Ends are found by pointer doubling, in as many rounds
as the logarithm of the longest chain.

Odd input: merges of a body with itself and rows with a null are left out; of several merges of the
same body (its label was gone after the first) the first counts, then that with the smallest keep; a
label split twice at a step takes the largest head; repeated rows count once; labels that no event
names stay as they are; merges in a circle raise ValueError.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept

NEVER = -1


def with_version(rows: DataFrame, heads: DataFrame, name: str) -> DataFrame:
    """rows(step, name, ...) with name_version: the last of heads(label, step) of that label up to the row's step.

    A running maximum over the order of (label, step): ranges of the order are read in their own tasks, so
    no label has to fit into one; only one row a range meets in one task.
    """
    every = rows.select(*rows.columns, F.col(name).alias("_label"), F.col("step").alias("_step"), F.lit(1).alias("_kind"))
    marks = heads.select(F.col("label").alias("_label"), F.col("step").alias("_step"), F.lit(0).alias("_kind"))
    order = ("_label", "_step", "_kind")
    mark = F.when(F.col("_kind") == 0, F.struct("_label", "_step"))
    dealt = kept(every.unionByName(marks, allowMissingColumns=True).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    last = dealt.groupBy("_range").agg(F.max(mark).alias("_last"))
    ahead = last.select("_range", F.max("_last").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_ahead"))  # one row a range
    inside = F.max(mark).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn("_in", inside).join(kept(ahead), "_range").where("_kind = 1")
    latest = F.coalesce("_in", "_ahead")
    version = F.when(latest["_label"] == F.col("_label"), latest["_step"]).otherwise(F.lit(NEVER))
    return out.select(*rows.columns, version.cast("long").alias(f"{name}_version"))


def forest(merges: DataFrame, splits: DataFrame) -> DataFrame:
    """(label, version, step, to, to_version): where each merged body went."""
    rows = merges.select(F.col("step").cast("long").alias("step"), *(F.col(c).cast("long").alias(c) for c in ("remove", "keep"))).where("remove != keep and step is not null")
    heads = splits.where("label is not null and head is not null").select(F.col("head").cast("long").alias("label"), F.col("step").cast("long").alias("step")).distinct()
    both = with_version(with_version(rows, heads, "remove"), heads, "keep")
    first = both.groupBy("remove", "remove_version").agg(F.min(F.struct("step", "keep", "keep_version")).alias("_e"))
    return first.select(F.col("remove").alias("label"), F.col("remove_version").alias("version"), "_e.step", F.col("_e.keep").alias("to"), F.col("_e.keep_version").alias("to_version"))


def ends(edges: DataFrame) -> DataFrame:
    """(label, version, to, to_version) of edges of the same columns: where each chain ends."""
    up = kept(edges.select("label", "version", "to", "to_version"))
    for _ in range(up.count().bit_length() + 1):
        step = up.select(F.col("label").alias("to"), F.col("version").alias("to_version"), F.col("to").alias("_to"), F.col("to_version").alias("_version"))
        up = kept(up.select("label", "version", "to", "to_version").join(step, ["to", "to_version"], "left").select("label", "version", F.coalesce("_to", "to").alias("to"), F.coalesce("_version", "to_version").alias("to_version"), F.col("_to").isNotNull().alias("moved")))
        if up.where("moved").isEmpty():
            return up.drop("moved")
    raise ValueError("the merges run in a circle")


def labels_at(labels: DataFrame, merges: DataFrame, splits: DataFrame, step: int | None = None) -> DataFrame:
    """(label, body) of labels(label) after all events up to `step`, or after all events."""
    upto = F.lit(True) if step is None else F.col("step") <= step
    up = ends(forest(merges, splits).where(upto))
    named = splits.where(upto).select(*(F.col(c).cast("long").alias(c) for c in ("label", "head", "step"))).where("label is not null and head is not null")
    named = named.union(named.select(F.col("head").alias("label"), "head", "step"))  # a head is in its own body
    last = named.groupBy("label").agg(F.max(F.struct("step", (F.col("label") == F.col("head")).alias("own"), "head")).alias("_s"))
    last = last.select("label", F.col("_s.head").alias("head"), F.col("_s.step").alias("from"))
    own = labels.select(F.col("label").cast("long").alias("label")).where("label is not null").distinct().join(last, "label", "left")
    own = own.select(F.col("label").alias("_base"), F.coalesce("head", "label").alias("label"), F.coalesce("from", F.lit(NEVER)).alias("version"))
    return own.join(up, ["label", "version"], "left").select(F.col("_base").alias("label"), F.coalesce("to", "label").alias("body"))


def members(at: DataFrame, body: int) -> DataFrame:
    """(label): the other labels of a body, of a table that labels_at gave."""
    return at.where((F.col("body") == body) & (F.col("label") != body)).select("label")


def assigned(table: DataFrame) -> DataFrame:
    """(seg, gt, count): each label's largest overlap of table(seg, gt, count); ties go to the smallest gt."""
    sums = table.groupBy("seg", "gt").agg(F.sum("count").alias("count"))
    best = sums.groupBy("seg").agg(F.max(F.struct("count", (-F.col("gt")).alias("_gt"))).alias("_b"))
    return best.select("seg", (-F.col("_b._gt")).alias("gt"), F.col("_b.count").alias("count"))


def assigned_after(table: DataFrame, merges: DataFrame) -> DataFrame:
    """(seg, gt, count) of the labels of table(seg, gt, count) that remain after merges(step, remove, keep).

    Of a removed label only its overlap with the gt label it is assigned to moves on, as in an
    interactive session; the rest of its overlaps is forgotten (`labels_at` and a grouping give the
    whole table). A label that has no overlap passes nothing on. One round of joins per level of the forest.
    """
    none = merges.sparkSession.createDataFrame([], "step long, label long, head long")
    left = kept(forest(merges, none).select(F.col("label").alias("remove"), F.col("to").alias("keep")))
    gone, parts = left, [table.select("seg", "gt", "count")]
    while not left.isEmpty():
        ready = kept(left.join(left.select(F.col("keep").alias("remove")).distinct(), "remove", "left_anti"))
        if ready.isEmpty():
            raise ValueError("the merges run in a circle")
        counts = parts[0]
        for p in parts[1:]:
            counts = counts.union(p)
        own = counts.join(ready.select(F.col("remove").alias("seg")), "seg", "left_semi")
        moved = assigned(own).join(ready.select(F.col("remove").alias("seg"), "keep"), "seg")
        parts.append(kept(moved.select(F.col("keep").alias("seg"), "gt", "count")))
        left = kept(left.join(ready.select("remove"), "remove", "left_anti"))
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.union(p)
    return assigned(counts.join(gone.select(F.col("remove").alias("seg")), "seg", "left_anti"))
