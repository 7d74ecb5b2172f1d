"""Region adjacency graphs from voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stencil import in_box, neighbours, shifted


def power_sums(channels: tuple[str, ...], n: int = 4) -> list:
    """Partial sums of powers, which merge by addition."""
    return [F.sum(F.pow(c, k) if k > 1 else F.col(c)).alias(f"{c}_s{k}") for c in channels for k in range(1, n + 1)]


def pair(a: str = "label", b: str = "nbr"):
    return [F.least(a, b).cast("long").alias("node1"), F.greatest(a, b).cast("long").alias("node2")]


def rag_nodes(voxels: DataFrame, channels: tuple[str, ...] = (), label: str = "seg") -> DataFrame:
    """nodes(id, size, boundary_size, sums): boundary voxels have a face on background or outside."""
    near = neighbours(voxels.where(F.col(label) != 0), label)
    open_ = near.groupBy("x", "y", "z").agg(F.max("label").alias("id"), F.max((F.col("nbr") == 0).cast("long")).alias("edge"))
    boundary = open_.groupBy("id").agg(F.sum("edge").alias("boundary_size"))
    sizes = voxels.where(F.col(label) != 0).groupBy(F.col(label).alias("id")).agg(F.count(F.lit(1)).alias("size"), *power_sums(channels))
    return sizes.join(boundary, "id").select(F.col("id").cast("long").alias("id"), "size", "boundary_size", *[c for c in sizes.columns if c not in ("id", "size")])


def rag_edges(voxels: DataFrame, channels: tuple[str, ...] = (), label: str = "seg") -> DataFrame:
    """edges(node1, node2, edge_size, sums): each voxel counts once for each distinct neighbouring label."""
    near = neighbours(voxels, label, channels).where("label != 0 and nbr != 0 and nbr != label").distinct()
    return near.groupBy(*pair()).agg(F.count(F.lit(1)).alias("edge_size"), *power_sums(channels))


def batch_edges(voxels: DataFrame, low, high, label: str = "seg") -> DataFrame:
    """edges of a block: border voxels are only neighbours; a face counts from the larger label's side."""
    inner = (F.col("x").between(low[0], high[0])) & F.col("y").between(low[1], high[1]) & F.col("z").between(low[2], high[2])
    near = neighbours(voxels, label).where(inner & (F.col("label") != 0) & (F.col("nbr") != 0) & (F.col("label") != F.col("nbr")))
    return near.groupBy(*pair()).agg(F.sum((F.col("label") > F.col("nbr")).cast("long")).alias("edge_size"))


def batch_nodes(voxels: DataFrame, low, high, label: str = "seg") -> DataFrame:
    """nodes of a block; labels that only touch it from outside have size 0."""
    sizes = in_box(voxels, low, high).where(F.col(label) != 0).groupBy(F.col(label).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("size"))
    edges = batch_edges(voxels, low, high, label)
    seen = edges.select(F.explode(F.array("node1", "node2")).alias("id"), F.lit(0).cast("long").alias("size"))
    return sizes.unionByName(seen).groupBy("id").agg(F.sum("size").alias("size"))


def merged_blocks(*parts: DataFrame, keys=("node1", "node2")) -> DataFrame:
    """Additive states of blocks, merged: sums of every other column."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in out.columns if c not in keys])


def mito_nodes(voxels: DataFrame, channel: str = "p1", least: float = 0.35, label: str = "seg") -> DataFrame:
    """nodes with mito_type: 2 where the channel's mean reaches `least`, else 1."""
    own = voxels.where(F.col(label) != 0).groupBy(F.col(label).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("size"), F.round(F.avg(channel), 6).alias("fraction"))
    return own.withColumn("mito_type", F.when(F.col("fraction") >= least, 2).otherwise(1))


def unpadded(voxels: DataFrame, low, high) -> DataFrame:
    """Voxels without a border of padding, rebased to 0."""
    return shifted(in_box(voxels, low, high), tuple(-v for v in low))


def border_graph(voxels: DataFrame, one: str = "seg", two: str = "gt") -> DataFrame:
    """edges between two co-registered labellings; equal labels give an edge to node 0."""
    both = voxels.where((F.col(one) != 0) & (F.col(two) != 0))
    near = F.when(F.col(one) == F.col(two), 0).otherwise(F.col(one))
    return both.select(F.least(near, two).cast("long").alias("node1"), F.greatest(near, two).cast("long").alias("node2")).groupBy("node1", "node2").agg(F.count(F.lit(1)).alias("edge_size"))


def edge_locations(voxels: DataFrame, channel: str | None = None, label: str = "seg") -> DataFrame:
    """(node1, node2, x, y, z, strength): the plane with the most (or least membrane-like) faces, its last voxel in scan order."""
    keep = (channel,) if channel else ()
    near = neighbours(voxels, label, keep).where("label != 0 and nbr != 0 and nbr != label")
    worth = 1 - F.col(channel) if channel else F.lit(1.0)
    planes = near.groupBy(*pair(), "z").agg(F.round(F.sum(worth), 6).alias("strength"), F.max(F.struct("y", "x")).alias("at"))
    best = planes.groupBy("node1", "node2").agg(F.max(F.struct("strength", (-F.col("z")).alias("nz"), "at")).alias("b"))
    return best.select("node1", "node2", F.col("b.at.x").alias("x"), F.col("b.at.y").alias("y"), (-F.col("b.nz")).cast("int").alias("z"), F.col("b.strength").alias("strength"))


def boundary_cut(voxels: DataFrame, label: str = "seg") -> DataFrame:
    """voxels with label 0 where a face touches another non-zero label."""
    near = neighbours(voxels, label).groupBy("x", "y", "z").agg(F.max("label").alias("own"), F.max(((F.col("nbr") != 0) & (F.col("nbr") != F.col("label"))).cast("int")).alias("touch"))
    return near.select("x", "y", "z", F.when(F.col("touch") == 1, 0).otherwise(F.col("own")).cast("int").alias(label))


def dilated_edges(voxels: DataFrame, disc: int, label: str = "seg") -> DataFrame:
    """boundary_cut, then for disc > 1 labels erode within a ball of radius disc - 1."""
    if disc <= 0:
        raise ValueError("the disc must be positive")
    cut = boundary_cut(voxels, label)
    r = disc - 1
    if r == 0:
        return cut
    ball = [(a, b, c) for a in range(-r, r + 1) for b in range(-r, r + 1) for c in range(-r, r + 1) if 0 < a * a + b * b + c * c <= r * r]
    holes = cut.where(F.col(label) == 0).select(*[F.col(c).alias(f"_{c}") for c in "xyz"])
    steps = F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip(o, ("dx", "dy", "dz"))]) for o in ball])
    hit = holes.select("*", F.explode(steps).alias("d")).select(*[(F.col(f"_{c}") + F.col(f"d.d{c}")).alias(c) for c in "xyz"]).distinct().withColumn("_hit", F.lit(1))
    return cut.join(hit, ["x", "y", "z"], "left").select("x", "y", "z", F.when(F.col("_hit") == 1, 0).otherwise(F.col(label)).cast("int").alias(label))


def without_small(voxels: DataFrame, least: int, keep: DataFrame | None = None, label: str = "seg") -> DataFrame:
    """voxels with labels of fewer than `least` voxels set to 0, but for those in keep(id)."""
    small = voxels.groupBy(F.col(label).alias("_id")).count().where(F.col("count") < least)
    if keep is not None:
        small = small.join(keep.select(F.col("id").alias("_id")), "_id", "left_anti")
    return voxels.join(small.select("_id"), F.col(label) == F.col("_id"), "left").withColumn(label, F.when(F.col("_id").isNotNull(), 0).otherwise(F.col(label)).cast("int")).drop("_id")


def bodies_at(voxels: DataFrame, points: DataFrame, y_size: int, label: str = "seg") -> DataFrame:
    """points(x, y, z, ...) with the body there: points count from the unpadded volume with y upwards, voxels are padded by one with y downwards.

    Points outside have no body and are left out.
    """
    at = voxels.select((F.col("x") - 1).alias("x"), (F.lit(y_size - 2) - F.col("y")).alias("y"), (F.col("z") - 1).alias("z"), F.col(label).cast("long").alias("body"))
    return points.join(at, ["x", "y", "z"])


def unpadded_locations(locations: DataFrame) -> DataFrame:
    """Edge locations of a volume padded by one, counted from the unpadded one."""
    return locations.withColumns({c: F.col(c) - 1 for c in "xyz"})
