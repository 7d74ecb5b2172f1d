"""The face-neighbour stencil: a voxel table joined with itself on shifted coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The six face neighbours (fixed values).
FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def neighbours(voxels: DataFrame, label: str = "seg", keep: tuple[str, ...] = (), offsets=FACES) -> DataFrame:
    """(x, y, z, label, *keep, nbr): a row for each voxel and offset; nbr is 0 outside the table.

    One equi-join on the coordinates: both sides hash on (x, y, z), so the shuffle is even for any
    shape of regions.
    """
    steps = F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip(o, ("dx", "dy", "dz"))]) for o in offsets])
    left = voxels.select("x", "y", "z", F.col(label).alias("label"), *keep, F.explode(steps).alias("d"))
    left = left.select("*", *[(F.col(c) + F.col(f"d.d{c}")).alias(f"n{c}") for c in "xyz"]).drop("d")
    right = voxels.select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("nz"), F.col(label).alias("nbr"))
    return left.join(right, ["nx", "ny", "nz"], "left").select("x", "y", "z", "label", *keep, F.coalesce("nbr", F.lit(0)).alias("nbr"))


def in_box(voxels: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """Voxels with low <= (x, y, z) <= high."""
    for c, a, b in zip("xyz", low, high):
        voxels = voxels.where(F.col(c).between(a, b))
    return voxels


def shifted(voxels: DataFrame, by: tuple[int, int, int]) -> DataFrame:
    return voxels.withColumns({c: (F.col(c) + d).cast("int") for c, d in zip("xyz", by)})


def cropped(voxels: DataFrame, size: int, dim: int) -> DataFrame:
    """A symmetric crop of each axis from dim to size, rebased to 0."""
    if size > dim:
        raise ValueError(f"cannot crop {dim} to {size}")
    edge = (dim - size) // 2
    return shifted(in_box(voxels, (edge,) * 3, (edge + size - 1,) * 3), (-edge,) * 3)
