import random

import pytest

from regraph.functions import states as fs
from regraph.operators.blocks import region_states
from regraph.operators.graph import canonical, relabelled
from regraph.operators.rag import rag_edges, rag_nodes

FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def volume(seed, n=260, span=8, labels=5, channels=2):
    r = random.Random(seed)
    cells = {}
    while len(cells) < n:
        cells[tuple(r.randrange(-span // 2, span) for _ in range(3))] = (r.randrange(labels + 1), *(r.choice([0.0, 1.0, r.random()]) for _ in range(channels)))
    return cells


def table(spark, cells, channels=2):
    schema = "x int, y int, z int, seg int, " + ", ".join(f"p{i} double" for i in range(channels))
    return spark.createDataFrame([(*k, *v) for k, v in cells.items()], schema)


def brute(cells):
    """Values of each region and each touching pair."""
    nodes, edges = {}, {}
    for (x, y, z), (label, *v) in cells.items():
        if not label:
            continue
        near = [cells.get((x + a, y + b, z + c), (0,))[0] for a, b, c in FACES]
        nodes.setdefault(label, []).append((v, 0 in near))
        for other in set(near) - {0, label}:
            edges.setdefault((min(label, other), max(label, other)), []).append(v)
    return nodes, edges


def features_of(rows, channels, bins=25, thresholds=(0.1, 0.3, 0.5, 0.7, 0.9)):
    out, n = [float(len(rows))], len(rows)
    for c in range(channels):
        v = [r[c] for r in rows]
        e = [sum(x**k for x in v) / n for k in (1, 2, 3, 4)]
        out += [e[0], e[1] - e[0] ** 2, e[2] - 3 * e[0] * e[1] + 2 * e[0] ** 3, e[3] - 4 * e[0] * e[2] + 6 * e[0] ** 2 * e[1] - 3 * e[0] ** 4]
        hist = [sum(min(int(x * bins), bins - 1) == b for x in v) for b in range(bins)]
        for t in thresholds:
            before = 0
            for b, k in enumerate(hist):
                if before + k >= t * n:
                    out.append((b + (t * n - before) / k) / bins)
                    break
                before += k
    return out


@pytest.mark.parametrize("side", [1, 3, 32])
def test_blocks_equal_brute_force_and_the_joined_stencil(spark, side):
    cells = volume(side)
    v = table(spark, cells).cache()
    nodes, edges = region_states(v, fs.basic(("p0", "p1")), side=side)
    want_nodes, want_edges = brute(cells)
    got = {r.id: r for r in nodes.collect()}
    assert {k: (r["size"], r.boundary_size) for k, r in got.items()} == {k: (len(x), sum(o for _, o in x)) for k, x in want_nodes.items()}
    assert {r.id: (r["size"], r.boundary_size) for r in rag_nodes(v).collect()} == {k: (r["size"], r.boundary_size) for k, r in got.items()}
    found = {(r.node1, r.node2): r for r in edges.collect()}
    assert {k: r["size"] for k, r in found.items()} == {k: len(x) for k, x in want_edges.items()} == {(r.node1, r.node2): r.edge_size for r in rag_edges(v).collect()}
    for k, r in found.items():
        assert r.sums[4] == pytest.approx(sum(x[1] for x in want_edges[k]))
        assert sum(r.hist[:26]) == r["size"] and r.hist[25] == sum(x[0] == 1.0 for x in want_edges[k])


def test_vectors_of_six_channels(spark):
    cells = volume(11, 150, 6, 4, 6)
    names = tuple(f"p{i}" for i in range(6))
    features = fs.basic(names)
    got = {(r.node1, r.node2): r.features for r in fs.edge_vectors(*region_states(table(spark, cells, 6), features), features).collect()}
    nodes, edges = brute(cells)
    assert set(got) == set(edges) and {len(f) for f in got.values()} == {190}
    for (a, b), f in got.items():
        if len(nodes[a]) > len(nodes[b]):
            a, b = b, a
        one, two = (features_of([v for v, _ in nodes[k]], 6) for k in (a, b))
        keep = [0] + [1 + 9 * c + k for c in range(6) for k in range(4)]
        want = one + two + features_of(edges[min(a, b), max(a, b)], 6) + [abs(one[k] - two[k]) for k in keep]
        assert f == pytest.approx(want, abs=1e-9)


def test_states_of_merged_regions_add_up(spark):
    """Merging regions' states equals the states of the merged labels, but for edges, whose contacts are kept apart."""
    cells, features = volume(5), fs.basic(("p0", "p1"))
    nodes, edges = region_states(table(spark, cells), features)
    step = spark.createDataFrame([(4, 2), (5, 2)], "old long, new long")
    merged = {r.id: r for r in fs.merged_states(relabelled(nodes, step, "id"), ["id"], features).collect()}
    joined = {k: ({4: 2, 5: 2}.get(v[0], v[0]), *v[1:]) for k, v in cells.items()}
    whole = {r.id: r for r in region_states(table(spark, joined), features)[0].collect()}
    for k, r in whole.items():
        assert merged[k]["size"] == r["size"] and merged[k].hist == r.hist and merged[k].sums == pytest.approx(r.sums)
    moved = canonical(relabelled(edges, step, "node1", "node2")).where("node1 != node2")
    sizes = {(r.node1, r.node2): r["size"] for r in fs.merged_states(moved, ["node1", "node2"], features).collect()}
    want = {}
    for r in edges.collect():
        a, b = sorted({4: 2, 5: 2}.get(k, k) for k in (r.node1, r.node2))
        if a != b:
            want[a, b] = want.get((a, b), 0) + r["size"]
    assert sizes == want


def test_modes_order_and_median(spark):
    cells = volume(9)
    v = table(spark, cells)
    features = fs.FeatureSet(("p0", "p1")).add_hist(10, (0.5,)).add_moments(2, False)
    states = region_states(v, features)
    plain = {(r.node1, r.node2): r.features for r in fs.edge_vectors(*states, features).collect()}
    ordered = {(r.node1, r.node2): r.features for r in fs.edge_vectors(*states, features, by_mode=True).collect()}
    for k, f in plain.items():  # [median, count, m1, m2] of p0, [median, m1, m2] of p1; then by feature
        block = lambda i: f[7 * i : 7 * i + 7]
        assert len(f) == 21 + 5
        assert ordered[k] == [x for i in range(3) for x in (lambda b: [b[0], b[4], b[1], b[2], b[3], b[5], b[6]])(block(i))]
    median = fs.FeatureSet(("p0",)).add_median()
    got = {(r.node1, r.node2): r.features for r in fs.edge_vectors(*region_states(v, median), median, by_mode=True).collect()}
    _, edges = brute(cells)
    assert got == {k: pytest.approx(features_of(x, 1, 100, (0.5,))[5:]) for k, x in edges.items()}
    with pytest.raises(ValueError):
        median.add_channel("p1")
    with pytest.raises(ValueError):
        fs.FeatureSet(("p0", "p1")).add_median()


def test_nulls_and_empty_volumes(spark):
    features = fs.basic(("p0",))
    schema = "x int, y int, z int, seg int, p0 double, size string"
    rows = [(0, 0, 0, 1, None, "a"), (1, 0, 0, 2, float("nan"), "b"), (2, 0, 0, None, 0.5, "c"), (None, 0, 0, 3, 0.5, "d"), (3, 0, 0, 4, -3.0, "e"), (4, 0, 0, 4, 7.0, "f")]
    nodes, edges = region_states(spark.createDataFrame(rows, schema), features)
    got = {r.id: r for r in nodes.collect()}
    assert {k: (r["size"], r.sums[0]) for k, r in got.items()} == {1: (1, 0.0), 2: (1, 0.0), 4: (2, 4.0)}
    assert got[4].hist[0] == 1 and got[4].hist[25] == 1
    assert [(r.node1, r.node2, r["size"]) for r in edges.collect()] == [(1, 2, 2)]
    empty = region_states(spark.createDataFrame([], schema), features)
    assert fs.edge_vectors(*empty, features).count() == 0 and empty[0].count() == 0


class MeanDifference:
    """A model whose weight is the difference of the first channel's means (one channel, basic set)."""

    def transform(self, df):
        from pyspark.ml.functions import array_to_vector
        from pyspark.sql import functions as F

        w = F.col("features")[31]
        return df.withColumn("probability", array_to_vector(F.array(1 - w, w)))


def test_api_agglomeration_scores_merged_edges_again_and_skips_mitochondria(spark):
    from regraph import api

    # slabs along x: label -> (length, p0, p1)
    slabs = {1: (1, 0.10, 0.0), 2: (2, 0.18, 0.0), 3: (2, 0.23, 0.0), 4: (1, 0.60, 0.0), 5: (1, 0.61, 1.0), 6: (1, 0.90, 0.0), 7: (1, 0.91, 0.0)}
    rows, x = [], 0
    for label, (n, p0, p1) in slabs.items():
        for _ in range(n):
            rows += [(x, y, 0, label, p0, p1) for y in range(2 if label == 4 else 3)]
            x += 1
    v = spark.createDataFrame(rows, "x int, y int, z int, seg int, p0 double, p1 double")

    def regions(**options):
        got = {}
        for r in api.agglomerate(v, ("p0",), MeanDifference(), 0.09, **options).collect():
            got.setdefault(r.seg, set()).add(r.x)
        return sorted(map(sorted, got.values()))

    # 2 and 3 merge to a mean of 0.205, so 1 (first at 0.08) is now at 0.105
    assert regions() == [[0], [1, 2, 3, 4], [5, 6], [7, 8]]
    # a mitochondrion is left out of the contraction and then takes the one neighbour that is large enough
    assert regions(mito_channel="p1") == [[0], [1, 2, 3, 4], [5], [6, 7, 8]]
