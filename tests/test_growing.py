import heapq
import random

import pytest

from regraph.operators.growing import absorbed, grown

FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
SCHEMA = "x int, y int, z int, seg int, p0 double"


def heap_flood(voxels):
    """{place: label} of {place: (label, value)}, by one heap over the whole volume."""
    done, heap = {}, [(float("-inf"), 0, s, at) for at, (s, _) in voxels.items() if s]
    heapq.heapify(heap)
    while heap:
        level, steps, s, at = heapq.heappop(heap)
        if at in done:
            continue
        done[at] = s
        for d in FACES:
            to = tuple(a + b for a, b in zip(at, d))
            if to in voxels and to not in done and not voxels[to][0]:
                p = voxels[to][1] or 0.0
                heapq.heappush(heap, (p, 0, s, to) if p > level else (level, steps + 1, s, to))
    return {at: done.get(at, 0) for at in voxels}


@pytest.mark.parametrize("seed, values", [(1, 3), (2, 1)])
def test_growing_equals_a_heap_flood(spark, seed, values):
    """Few values give plateaus and ties; a winding wall and lonely voxels leave paths over many blocks."""
    r = random.Random(seed)
    voxels = {(x, y, z): (r.randrange(1, 9) if r.random() < 0.03 else 0, r.randrange(values) / 4) for x in range(-3, 11) for y in range(9) for z in range(3) if (x % 4 != 1 or y == (0 if x % 8 == 1 else 8))}
    voxels[50, 50, 50] = (0, 0.5)
    rows = [(*at, s, p) for at, (s, p) in voxels.items()]
    got = grown(spark.createDataFrame(rows, SCHEMA), "p0", side=4)
    assert {(v.x, v.y, v.z): v.seg for v in got.collect()} == heap_flood(voxels)


def test_absorbing_small_regions_and_odd_voxels(spark):
    rows = [(x, 0, 0, 7 if x < 4 else 5 if x == 4 else 3, None if x == 4 else 0.5) for x in range(8)] + [(0, 0, 0, 0, 0.1), (None, 0, 0, 1, 0.1), (4, 1, 0, None, 0.2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(v.x, v.y): v.seg for v in absorbed(df, "p0", 2, side=4).collect()}
    assert got[4, 0] == 3 and got[4, 1] == 3 and got[0, 0] == 7 and len(got) == 9
    keep = spark.createDataFrame([(5,)], "id int")
    assert {(v.x, v.y): v.seg for v in absorbed(df, "p0", 2, keep, side=4).collect()}[4, 1] == 5
    assert grown(df.limit(0), "p0").count() == 0
