"""Region statistics from mergeable partial sums, and scalar functions of the toolkit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(n: str | Column, sums: list[str | Column]) -> list[Column]:
    """mean and central moments 2 to 4 (not standardised) from a count and power sums."""
    e1, e2, e3, e4 = ((F.col(s) if isinstance(s, str) else s) / (F.col(n) if isinstance(n, str) else n) for s in sums)
    return [e1, e2 - e1**2, e3 - 3 * e1 * e2 + 2 * e1**3, e4 - 4 * e1 * e3 + 6 * e1**2 * e2 - 3 * e1**4]


def histogram(rows: DataFrame, key: str, value: str, bins: int) -> DataFrame:
    """(key, bin, count): value 1 falls in the last bin."""
    at = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(F.col(key).cast("long").alias(key), at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def percentiles(hist: DataFrame, key: str, bins: int, thresholds: list[float]) -> DataFrame:
    """(key, threshold, value): interpolated in the first bin whose cumulative count reaches the share."""
    w = Window.partitionBy(key).orderBy("bin")
    cum = hist.withColumns({"cum": F.sum("count").over(w), "total": F.sum("count").over(Window.partitionBy(key))})
    asked = cum.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    need = F.col("threshold") * F.col("total")
    hit = asked.where((F.col("cum") >= need) & (F.col("cum") - F.col("count") < need))
    return hit.select(key, "threshold", F.round((F.col("bin") + (need - (F.col("cum") - F.col("count"))) / F.col("count")) / bins, 6).alias("value"))


def inclusiveness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, largest_share, second_share) of a node's distinct contact lengths, its open boundary among them."""
    from ..operators.graph import endpoints

    lengths = endpoints(edges, "edge_size").select("id", F.col("edge_size").alias("length")).unionByName(nodes.where("boundary_size > 0").select("id", F.col("boundary_size").alias("length")))
    total = lengths.groupBy("id").agg(F.sum("length").alias("total"))
    ranked = lengths.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("length"))))
    top = ranked.where("rank <= 2").groupBy("id").agg(F.max("length").alias("one"), F.max(F.when(F.col("rank") == 2, F.col("length"))).alias("two"))
    return top.join(total, "id").select("id", F.round(F.col("one") / F.col("total"), 6).alias("largest_share"), F.round(F.col("two") / F.col("one"), 6).alias("second_share"))


def voi_change(s1: Column, s2: Column, total: float | Column) -> Column:
    """How much a merge of two regions changes the variation of information."""
    total = F.lit(float(total)) if isinstance(total, (int, float)) else total
    part = lambda s: s / total * F.log2(s / total)
    return -(part(s1) + part(s2) - part(s1 + s2))


def mito_ratio(edge_size: Column, border: Column, mito: Column, other: Column, mito_size: Column, other_size: Column) -> Column:
    """The share of a mitochondrion's border that an edge makes up; 0 where the pair does not fit or it is over 1."""
    ratio = edge_size / border
    return F.when((mito == 2) & (other == 1) & (mito_size <= other_size) & (ratio <= 1), ratio).otherwise(0.0)


def merge_cost(p: Column, threshold: float) -> Column:
    return F.when(p > threshold, 1.0).otherwise(p)


def keep_cost(p: Column, threshold: float) -> Column:
    return F.when(p > threshold, 0.0).otherwise(1 - p)


def composed_id(z: Column, label: Column, start: int = 0, span: int = 200_000) -> Column:
    return (z + start) * span + label


def risk(p: Column, propagated: Column) -> Column:
    """Disagreement of a classifier's and a propagated belief; both clipped to [-1, 1]."""
    return 2 * (p - 0.5) * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), propagated))


def gaussian(distance: Column, threshold: float) -> Column:
    return F.exp(-distance * distance / (0.5 * threshold**2))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def logistic(f: Column) -> Column:
    return 1 / (1 + F.exp(-f))


#: Vectors of a block, and of a tile of the products of two blocks (fixed values).
BLOCK, TILE = 16_384, 1024


def close_rows(a: np.ndarray, b: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, distance) of all pairs within radius, some 65,536 candidates at a time.

    Products of tiles leave candidates, with room for rounding; their distances are added up component
    by component, as `distance` does.
    """
    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            sums = a2[i : i + TILE, None] + b2[None, j : j + TILE]
            apart = sums - 2 * (a[i : i + TILE] @ b[j : j + TILE].T)
            left, right = np.nonzero(~(apart > radius * radius * (1 + 1e-9) + 1e-9 * sums))  # what overflows stays a candidate
            for k in range(0, len(left), 65_536):
                x, y = left[k : k + 65_536] + i, right[k : k + 65_536] + j
                off = a[x] - b[y]
                far = np.sqrt(np.add.accumulate(off * off, axis=1)[:, -1]) if off.shape[1] else np.zeros(len(x))
                near = far < radius
                yield x[near], y[near], far[near]


def similar_pairs(vectors: DataFrame, radius: float) -> DataFrame:
    """(id1, id2, distance) of vectors(id, v) within radius, id1 < id2, by an exact comparison of all pairs.

    Rows are dealt to blocks of some BLOCK, and each pair of blocks is compared in its own task, a tile of
    products at a time: work grows with the square of the rows, as no bound on norms or components parts
    vectors of one length, but a task's memory does not. Nulls and components that are null or not
    finite are within no radius of anything; neither are vectors of different numbers of components.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    rows = vectors.select("id", F.col("v").cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    blocks = max(8, -(-vectors.count() // BLOCK))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).select("*", other.alias("_o"))
    dealt = rows.select("id", "v", "block", F.least("block", "_o").alias("one"), F.greatest("block", "_o").alias("two"))

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = (k.as_py() for k in key)
        rows = pa.Table.from_batches(list(batches))
        block, size = rows.column("block").to_numpy(), pc.list_value_length(rows.column("v")).to_numpy()
        for n in np.unique(size):
            sides = []
            for b in (one, two) if one < two else (one,):
                part = rows.filter(pa.array((block == b) & (size == n)))
                values = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
                sides.append((part.column("id").combine_chunks(), values.reshape(part.num_rows, n)))
            (id1, a), (id2, b) = sides[0], sides[-1]
            for x, y, far in close_rows(a, b, radius):
                x, y = id1.take(pa.array(x)), id2.take(pa.array(y))
                less = pc.less(x, y)
                keep = less if one == two else pc.not_equal(x, y)
                found = [pc.if_else(less, x, y), pc.if_else(less, y, x), pa.array(far)]
                yield pa.RecordBatch.from_arrays(found, names=["id1", "id2", "distance"]).filter(keep)

    pairs = dealt.repartition(min(blocks * (blocks + 1) // 2, 10_000), "one", "two").groupBy("one", "two").applyInArrow(compare, f"id1 {kind}, id2 {kind}, distance double")
    return pairs.select("id1", "id2", F.round("distance", 6).alias("distance"))


def feature_screen(rows: DataFrame, columns: list[str], least: float = 0.001) -> DataFrame:
    """(feature, deviation, useless): columns that hardly vary."""
    stats = rows.agg(*[F.stddev_pop(c).alias(c) for c in columns])
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.col(c), 6).alias("deviation")) for c in columns])
    return stats.select(F.explode(parts).alias("r")).select("r.feature", "r.deviation", (F.col("r.deviation") < least).alias("useless"))


