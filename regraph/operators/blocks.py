"""Region graphs by blocks with a halo: node and edge states of a volume in one pass.

Each voxel goes to its block of SIDE voxels a side, and as halo to the blocks that its faces touch; that
is the one shuffle of voxels. A block is at most (SIDE + 2) ** 3 voxels, whatever the regions' sizes,
and is solved in its own task. Its partial states then add up by region and by pair of regions.

Coordinates are keys: of voxels with equal coordinates one is taken. Voxels without coordinates are left
out, a null label is background, as is all outside the table; null channel values count as 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.states import POWERS, FeatureSet, merged_states
from .stencil import FACES
from .tables import kept

SIDE = 32
PARTIAL = "node1 long, node2 long, size long, boundary_size long, sums array<double>, hist array<long>"


def dealt(voxels: DataFrame, channels: tuple[str, ...], label: str, side: int) -> DataFrame:
    """(bx, by, bz, x, y, z, label, channels): voxels with the blocks they belong to, as own or as halo."""
    numbers = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(channels)]
    rows = voxels.where("x is not null and y is not null and z is not null").select(*(F.col(c).cast("long").alias(c) for c in "xyz"), F.coalesce(F.col(label).cast("long"), F.lit(0)).alias("label"), *numbers)
    at = lambda d: F.struct(*(F.floor((F.col(c) + k) / side).alias("b" + c) for c, k in zip("xyz", d)))
    places = F.array_distinct(F.array(at((0, 0, 0)), *map(at, FACES)))
    return rows.withColumn("_b", F.explode(places)).select("_b.*", *rows.columns)


def added(inverse: np.ndarray, many: int, columns: list[np.ndarray], features: FeatureSet) -> tuple[np.ndarray, np.ndarray]:
    """sums and hist of `many` groups, inverse being each row's group."""
    sums, hist = [], []
    for v in columns:
        power = np.ones_like(v)
        for _ in range(POWERS):
            power = power * v
            sums.append(np.bincount(inverse, power, many))
        for b in features.bins:
            slot = np.clip((v * b).astype(np.int64), 0, b)
            hist.append(np.bincount(inverse * (b + 1) + slot, minlength=many * (b + 1)).reshape(many, b + 1))
    return np.stack(sums, 1) if sums else np.zeros((many, 0)), np.concatenate(hist, 1) if hist else np.zeros((many, 0), np.int64)


def block_states(rows: pa.Table, features: FeatureSet, side: int) -> pa.Table:
    """Partial states of one block's rows; a node's row has no node2."""
    x, y, z, label = (rows.column(c).to_numpy() for c in ("x", "y", "z", "label"))
    low = [rows.column("b" + c)[0].as_py() * side for c in "xyz"]
    place = np.stack([x - low[0], y - low[1], z - low[2]], 1)
    own = ((place >= 0) & (place < side)).all(1)
    _, once = np.unique(place, axis=0, return_index=True)
    dense = np.zeros((side + 2,) * 3, np.int64)
    dense[tuple(place[once].T + 1)] = label[once]
    take = once[own[once] & (label[once] != 0)]
    at, mine = place[take] + 1, label[take]
    near = np.stack([dense[tuple((at + np.array(d)).T)] for d in FACES], 1) if len(take) else np.zeros((0, len(FACES)), np.int64)
    columns = [rows.column(f"v{i}").to_numpy()[take] for i in range(len(features.channels))]
    ids, inverse = np.unique(mine, return_inverse=True)
    open_ = np.bincount(inverse, (near == 0).any(1), len(ids)).astype(np.int64)
    sums, hist = added(inverse, len(ids), columns, features)
    parts = [(ids, None, np.bincount(inverse, minlength=len(ids)), open_, sums, hist)]
    near = np.sort(near, 1)  # a voxel counts once for each other region that it touches
    new = np.concatenate([np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]], 1) & (near != 0) & (near != mine[:, None])
    voxel, _ = np.nonzero(new)
    ends = np.stack([np.minimum(mine[voxel], near[new]), np.maximum(mine[voxel], near[new])], 1)
    pairs, inverse = np.unique(ends, axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    sums, hist = added(inverse, len(pairs), [v[voxel] for v in columns], features)
    parts.append((pairs[:, 0], pairs[:, 1], np.bincount(inverse, minlength=len(pairs)), np.zeros(len(pairs), np.int64), sums, hist))

    def lists(a: np.ndarray, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(np.ascontiguousarray(a).reshape(-1), kind))

    names = [c.split()[0] for c in PARTIAL.split(", ")]
    tables = []
    for one, two, size, edge, s, h in parts:
        end = pa.nulls(len(one), pa.int64()) if two is None else pa.array(two, pa.int64())
        tables.append(pa.table([pa.array(one, pa.int64()), end, pa.array(size, pa.int64()), pa.array(edge, pa.int64()), lists(s, pa.float64()), lists(h, pa.int64())], names=names))
    return pa.concat_tables(tables)


def region_states(voxels: DataFrame, features: FeatureSet, label: str = "seg", side: int = SIDE) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, size, boundary_size, sums, hist), edges(node1, node2, size, sums, hist)) of voxels(x, y, z, label, channels).

    Sizes are those of `rag_nodes` and `rag_edges`: boundary voxels have a face on background or outside,
    and a voxel counts once for each other region that it touches.
    """

    def solve(rows: pa.Table) -> pa.Table:
        return block_states(rows, features, side)

    partial = dealt(voxels, features.channels, label, side).groupBy("bx", "by", "bz").applyInArrow(solve, PARTIAL)
    states = kept(merged_states(partial, ["node1", "node2"], features))
    nodes = states.where("node2 is null").select(F.col("node1").alias("id"), "size", "boundary_size", "sums", "hist")
    return nodes, states.where("node2 is not null").drop("boundary_size")
