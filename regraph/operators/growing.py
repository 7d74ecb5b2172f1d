"""Seeded growing: voxels of label 0 are flooded from the labelled ones, lowest boundary values first.

A voxel's key is (level, steps, label). Labelled voxels are seeds of key (-inf, 0, label). Over a face, a
key (level, steps, label) reaches a voxel of value p as (p, 0, label) if p > level, else as
(level, steps + 1, label), and each voxel takes the smallest key that its neighbours' keys give. So it goes to
the label that reaches it over the lowest values; at equal height to the nearest by steps on that
level, then to the smallest label. A key is larger than the one it comes from, so these rules have one
solution, which a heap over the whole volume finds as well.

Volumes are flooded by blocks of `side` voxels a side, each in its own task, from its seeds and the keys of
its neighbours' faces. Blocks whose faces have news flood again, until there are none; what is written
each round are keys of faces. Heights, steps and labels settle in this order, so rounds end: they are
as many as blocks that a label crosses.

Of voxels with equal coordinates one is taken, labelled ones and large labels first; voxels without
coordinates are left out; null labels are 0, null values 0; voxels that no seed reaches stay 0.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SIDE
from .rag import without_small
from .stencil import FACES
from .tables import kept

BLOCK, PLACE = ["bx", "by", "bz"], ["x", "y", "z"]
FACE_KEYS = "sx long, sy long, sz long, bx long, by long, bz long, x long, y long, z long, level double, steps long, label long"


def flooded(rows: pa.Table, side: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """(block, places of the block's own voxels, key by place) of one block's own rows and its neighbours' keys; places count from the halo's corner."""
    block = np.array([rows.column(c)[0].as_py() for c in BLOCK])
    place = np.stack([rows.column(c).to_numpy() for c in PLACE], 1) - block * side + 1
    level, steps, label, value, own = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("level", "steps", "label", "value", "own"))
    wide = side + 2
    flat = place @ np.array([wide * wide, wide, 1])
    known = label != 0
    keys = {i: k for i, *k in zip(flat[known].tolist(), level[known].tolist(), steps[known].tolist(), label[known].tolist())}
    keys = {i: tuple(k) for i, k in keys.items()}
    open_ = dict(zip(flat[own & ~known].tolist(), value[own & ~known].tolist()))
    near = [(np.array(d) @ np.array([wide * wide, wide, 1])).item() for d in FACES]
    heap: list = []

    def spread(i: int) -> None:
        height, far, name = keys[i]
        for d in near:
            p = open_.get(i + d)
            if p is not None:
                heapq.heappush(heap, (p, 0, name, i + d) if p > height else (height, far + 1, name, i + d))

    for i in list(keys):
        spread(i)
    while heap:
        *key, i = heapq.heappop(heap)
        if open_.pop(i, None) is not None:
            keys[i] = tuple(key)
            spread(i)
    return block, flat[own], keys


def places_of(flat: np.ndarray, block: np.ndarray, side: int) -> np.ndarray:
    wide = side + 2
    return np.stack([flat // (wide * wide), flat // wide % wide, flat % wide], 1) - 1 + block * side


def grown(voxels: DataFrame, channel: str, label: str = "seg", side: int = SIDE) -> DataFrame:
    """(x, y, z, label as long): voxels(x, y, z, label, channel) with label 0 filled from the labelled ones."""
    value = F.coalesce(F.nanvl(F.col(channel).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = voxels.where("x is not null and y is not null and z is not null").select(*(F.col(c).cast("long").alias(c) for c in PLACE), F.coalesce(F.col(label).cast("long"), F.lit(0)).alias("label"), value.alias("value"))
    rows = rows.groupBy(*PLACE).agg(F.max(F.struct((F.col("label") != 0).alias("seed"), "label", "value")).alias("_v"))
    own = kept(rows.select(*(F.floor(F.col(c) / side).alias(b) for b, c in zip(BLOCK, PLACE)), *PLACE, "_v.label", "_v.value"))

    def keys_of_faces(rows: pa.Table) -> pa.Table:
        block, flat, keys = flooded(rows, side)
        flat = np.array([i for i in flat.tolist() if i in keys], np.int64)
        place = places_of(flat, block, side)
        parts = []
        for d in FACES:
            to = (place + np.array(d)) // side
            out = (to != block).any(1)
            parts.append((to[out], place[out], flat[out]))
        to, place, flat = (np.concatenate(p) for p in zip(*parts))
        found = [keys[i] for i in flat.tolist()]
        source = np.broadcast_to(block, to.shape)
        columns = [pa.array(np.ascontiguousarray(a[:, i]), pa.int64()) for a in (source, to, place) for i in range(3)]
        columns += [pa.array([k[i] for k in found], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
        return pa.table(columns, names=[c.split()[0] for c in FACE_KEYS.split(", ")])

    def labels(rows: pa.Table) -> pa.Table:
        block, flat, keys = flooded(rows, side)
        place = places_of(flat, block, side)
        return pa.table([*(pa.array(np.ascontiguousarray(place[:, i]), pa.int64()) for i in range(3)), pa.array([keys[i][2] if i in keys else 0 for i in flat.tolist()], pa.int64())], names=[*PLACE, label])

    def inputs(blocks: DataFrame, faces: DataFrame | None) -> DataFrame:
        """Own voxels and neighbours' keys of some blocks."""
        seeds = own.join(blocks, BLOCK, "left_semi").select(*BLOCK, *PLACE, F.lit(float("-inf")).alias("level"), F.lit(0).cast("long").alias("steps"), "label", "value", F.lit(True).alias("own"))
        if faces is None:
            return seeds
        return seeds.union(faces.join(blocks, BLOCK, "left_semi").select(*BLOCK, *PLACE, "level", "steps", "label", F.lit(0.0), F.lit(False)))

    every = kept(own.select(*BLOCK).distinct())
    active, faces = every, None
    while True:
        new = kept(inputs(active, faces).groupBy(*BLOCK).applyInArrow(keys_of_faces, FACE_KEYS))
        if faces is None:
            faces, changed = new, new
        else:
            source = active.toDF("sx", "sy", "sz")
            changed = new.join(faces, new.columns, "left_anti")
            faces = kept(faces.join(source, ["sx", "sy", "sz"], "left_anti").union(new))
        active = kept(changed.select(*BLOCK).distinct().join(every, BLOCK, "left_semi"))
        if active.isEmpty():
            return inputs(every, faces).groupBy(*BLOCK).applyInArrow(labels, f"x long, y long, z long, `{label}` long")


def absorbed(voxels: DataFrame, channel: str, least: int, keep: DataFrame | None = None, label: str = "seg", side: int = SIDE) -> DataFrame:
    """voxels' labels after those of fewer than `least` voxels, but for keep(id), are taken away and what is 0 is grown over."""
    return grown(without_small(voxels, least, keep, label), channel, label, side)
