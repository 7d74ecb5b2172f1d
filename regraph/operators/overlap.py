"""Two labellings of the same voxels: contingency, assignment, matches and variation of information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import running_before


def contingency(rows: DataFrame, seg: str = "seg", gt: str = "gt", weight: str | None = None) -> DataFrame:
    """(seg, gt, count) over rows in which neither label is 0."""
    both = rows.where((F.col(seg) != 0) & (F.col(gt) != 0))
    return both.groupBy(F.col(seg).cast("long").alias("seg"), F.col(gt).cast("long").alias("gt")).agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("long").alias("count"))


def with_totals(table: DataFrame) -> DataFrame:
    """The contingency with both margins and the total; only the margins are joined, each a row a label."""
    segs = table.groupBy("seg").agg(F.sum("count").alias("seg_size"))
    gts = table.groupBy("gt").agg(F.sum("count").alias("gt_size"))
    total = table.agg(F.sum("count").alias("total"))
    return table.join(segs, "seg").join(gts, "gt").join(F.broadcast(total))  # one row


def vi_terms(table: DataFrame) -> DataFrame:
    p = F.col("count") / F.col("total")
    return with_totals(table).withColumns({"merge": p * F.log2(F.col("seg_size") / F.col("count")), "split": p * F.log2(F.col("gt_size") / F.col("count"))})


def variation_of_information(table: DataFrame) -> DataFrame:
    """One row: merge = H(gt | seg), split = H(seg | gt), in bits."""
    return vi_terms(table).agg(F.round(F.sum("merge"), 6).alias("merge"), F.round(F.sum("split"), 6).alias("split"))


def vi_by_label(table: DataFrame, label: str) -> DataFrame:
    """(id, vi): each label's share of merge (label seg) or split (label gt)."""
    return vi_terms(table).groupBy(F.col(label).alias("id")).agg(F.round(F.sum("merge" if label == "seg" else "split"), 6).alias("vi"))


def assignment(table: DataFrame) -> DataFrame:
    """(seg, gt, count): the ground-truth label with the largest overlap; ties to the smaller label."""
    best = table.groupBy("seg").agg(F.max(F.struct("count", (-F.col("gt")).alias("n"))).alias("b"))
    return best.select("seg", (-F.col("b.n")).alias("gt"), F.col("b.count").alias("count"))


def segments_of_gt(assigned: DataFrame) -> DataFrame:
    """(gt, segs, n): the segments assigned to each ground-truth label, in order, as text."""
    return assigned.groupBy("gt").agg(F.array_join(F.array_sort(F.collect_list("seg")), ",").alias("segs"), F.count(F.lit(1)).alias("n"))


def overlap_matches(table: DataFrame, least: float = 0.5) -> DataFrame:
    """(seg, gt, by): pairs whose overlap is over `least` of the ground-truth label, else of the segment."""
    t = with_totals(table)
    by = F.when(F.col("count") / F.col("gt_size") > least, F.lit("gt")).when(F.col("count") / F.col("seg_size") > least, F.lit("seg"))
    return t.withColumn("by", by).where("by is not null").select("seg", "gt", "count", "by")


def vi_report(by_label: DataFrame, threshold: float) -> DataFrame:
    """Labels in descending share while what remains is at least threshold."""
    total = by_label.agg(F.sum("vi").alias("_t"))
    rows = running_before(by_label, "vi", F.desc("vi"), F.col("id")).join(F.broadcast(total))  # one row
    return rows.withColumn("left", F.round(F.col("_t") - F.col("before"), 6)).where(F.col("left") >= threshold).select("id", "vi", "left")


def unmerged_pairs(assigned: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """(gt, bodies, pairs): pairs of large bodies that share a ground-truth label."""
    large = assigned.join(sizes.where(F.col("size") > least), F.col("seg") == F.col("id"))
    return large.groupBy("gt").agg(F.count(F.lit(1)).alias("bodies")).withColumn("pairs", F.expr("bodies * (bodies - 1) div 2"))


def match_counts(matches: DataFrame) -> DataFrame:
    """One row of overlap_matches: pairs, distinct segments and distinct ground-truth labels matched."""
    return matches.agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("seg").alias("segs"), F.countDistinct("gt").alias("gts"))


def synapse_violations(points: DataFrame) -> DataFrame:
    """One row on points(syn, pos, body, gt): pairs of one synapse that share a body, of these the ones of different gt, pairs that share a gt,
    points, synapses and synapses with a pair that shares a body but not a gt. Background counts as a body."""
    other = points.toDF(*[f"{c}2" for c in points.columns])
    pairs = points.join(other, F.col("syn") == F.col("syn2")).where("pos < pos2")  # a synapse has few points
    shared, one_gt = F.col("body") == F.col("body2"), F.col("gt") == F.col("gt2")
    sums = pairs.agg(F.count_if(shared).alias("violations"), F.count_if(shared & ~one_gt).alias("true_violations"), F.count_if(one_gt).alias("gt_merges"), F.countDistinct(F.when(shared & ~one_gt, F.col("syn"))).alias("violated_synapses"))
    return sums.join(points.agg(F.count(F.lit(1)).alias("points"), F.countDistinct("syn").alias("synapses")))  # two single rows
