import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from regraph.functions import codecs
from regraph.functions import features as ft
from regraph.operators import agglomeration as ag
from regraph.operators import graph as gr
from regraph.operators import overlap as ov
from regraph.operators import rag as rg
from regraph.sources import graph_json as gj
from regraph.sources import volumes


@pytest.fixture
def triangle(spark):
    nodes = spark.createDataFrame([(5, 1, 0), (6, 10, 0), (7, 0, 0)], "id long, size long, boundary_size long")
    edges = spark.createDataFrame([(6, 7, 1, 0.1), (5, 7, 1, 0.2), (5, 6, 1, 0.3)], "node1 long, node2 long, edge_size long, weight double")
    return nodes, edges


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_join_nodes(spark, triangle):
    nodes, edges = triangle
    n, e = gr.contracted(nodes, edges, spark.createDataFrame([(5, 6)], "old long, new long"))
    assert rows(n, "id", "size") == [(6, 11), (7, 0)]
    assert rows(e, "node1", "node2", "edge_size", "weight") == [(6, 7, 2, 0.1)]


def test_confirmed_boundary_survives(spark, triangle):
    nodes, edges = triangle
    edges = edges.withColumn("weight", F.when(F.col("node1") == 5, gr.CONFIRMED).otherwise(F.col("weight")))
    _, e = gr.contracted(nodes, edges, spark.createDataFrame([(5, 6)], "old long, new long"))
    assert rows(e, "weight") == [(1.2,)]


def test_json_graph(spark, tmp_path):
    doc = {"edge_list": [{"node1": 5, "node2": 9, "size1": 2000, "size2": 1500, "weight": 0.3}, {"node1": 5, "node2": 19, "size1": 7, "size2": 3500, "weight": 0.5}, {"node1": 9, "node2": 5, "weight": 0.9}], "orphan_bodies": [19]}
    path = tmp_path / "g.json"
    path.write_text(json.dumps(doc))
    nodes, edges = gj.read_graph(spark, str(path))
    assert rows(nodes, "id", "size", "boundary_size") == [(5, 2000, 1), (9, 1500, 1), (19, 3500, 0)]
    assert rows(edges, "node1", "node2", "weight", "edge_size") == [(5, 9, 0.3, 5), (5, 19, 0.5, 5)]
    gj.write_edges(nodes, edges, str(tmp_path / "out"))
    assert rows(gj.read_edges(spark, str(tmp_path / "out")), "node1", "node2", "size2", "weight") == [(5, 9, 1500, 0.3), (5, 19, 3500, 0.5)]
    assert "5 9 2000 1500 0.3 5" in [r.value for r in gj.edge_text(nodes, edges).collect()]


def test_synapses(spark, tmp_path):
    doc = {"data": [{"T-bar": {"location": [1, 2, 3]}, "partners": [{"location": [4, 5, 6]}, {"location": [7, 8, 9]}]}]}
    path = tmp_path / "s.json"
    path.write_text(json.dumps(doc))
    assert rows(gj.read_synapses(spark, str(path), y_size=10), "pos", "x", "y", "z") == [(0, 1, 7, 3), (1, 4, 4, 6), (2, 7, 1, 9)]
    assert rows(gj.read_synapses(spark, str(path), roi=(5, 9, 9)), "pos") == [(0,), (1,)]
    assert gj.recipe_steps('{"recipe": [{"type": "edge"}]}')[0]["upper-prob"] == 0.9


def brute_rag(v):
    size, boundary, edges = {}, {}, {}
    for (x, y, z), s in v.items():
        if s == 0:
            continue
        size[s] = size.get(s, 0) + 1
        near = [v.get((x + a, y + b, z + c), 0) for a, b, c in [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]]
        boundary[s] = boundary.get(s, 0) + (0 in near)
        for t in set(near) - {0, s}:
            k = (min(s, t), max(s, t))
            edges[k] = edges.get(k, 0) + 1
    return size, boundary, edges


def test_rag_against_brute_force(spark):
    labels = np.random.default_rng(3).integers(0, 5, (4, 5, 6))
    v = {(x, y, z): int(labels[z, y, x]) for z in range(4) for y in range(5) for x in range(6)}
    df = volumes.from_array(spark, labels).withColumnRenamed("label", "seg")
    size, boundary, edges = brute_rag(v)
    assert rows(rg.rag_nodes(df), "id", "size", "boundary_size") == sorted((k, size[k], boundary[k]) for k in size)
    assert rows(rg.rag_edges(df), "node1", "node2", "edge_size") == sorted((*k, n) for k, n in edges.items())


def test_components_and_agglomeration(spark):
    edges = spark.createDataFrame([(i, i + 1, 1, 0.1) for i in range(1, 40)] + [(100, 101, 1, 0.9), (40, 100, 1, 0.8)], "node1 long, node2 long, edge_size long, weight double")
    nodes = spark.createDataFrame([(i, 1) for i in [*range(1, 41), 100, 101]], "id long, size long")
    assert {r.new for r in gr.flat_merge(edges, 0.2).collect()} == {1}
    n, e, m = ag.agglomerated(nodes, edges, 0.2)
    assert rows(n, "id", "size") == [(1, 40), (100, 1), (101, 1)]
    assert m.count() == 39


def test_agglomeration_of_a_hub_leaves_no_mergeable_edge(spark):
    edges = spark.createDataFrame([(1, i, 1, 0.001 * i) for i in range(2, 65)] + [(1, 65, 1, 0.9)], "node1 long, node2 long, edge_size long, weight double")
    nodes = spark.createDataFrame([(i, 1) for i in range(1, 66)], "id long, size long")
    n, e, m = ag.agglomerated(nodes, edges, 0.2)
    assert rows(n, "id", "size") == [(1, 64), (65, 1)]
    assert rows(e, "node1", "node2", "weight") == [(1, 65, 0.9)]
    assert rows(m, "old", "new") == [(i, 1) for i in range(2, 65)]


def test_agglomeration_stops_at_confirmed_boundaries(spark):
    """A boundary of weight over 1, a preserved and a false edge stay apart, also after their ends have met other bodies."""
    nodes = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4, 5)], "id long, size long")
    edges = spark.createDataFrame([(1, 2, 10, 1.2), (1, 3, 1, 0.05), (2, 3, 90, 0.1)], "node1 long, node2 long, edge_size long, weight double")
    n, e, _ = ag.agglomerated(nodes.where("id < 4"), edges, 0.3)
    assert rows(n, "id", "size") == [(1, 2), (2, 1)] and rows(e, "node1", "node2", "weight") == [(1, 2, 1.2)]
    marked = spark.createDataFrame([(1, 2, 10, 0.1, True, False), (1, 3, 1, 0.05, False, False), (2, 3, 90, 0.1, False, False), (4, 5, 0, 0.0, False, True)], "node1 long, node2 long, edge_size long, weight double, preserve boolean, false_edge boolean")
    n, e, _ = ag.agglomerated(nodes, marked, 0.3)
    assert rows(n, "id", "size") == [(1, 2), (2, 1), (4, 1), (5, 1)]
    assert rows(e, "node1", "node2", "preserve", "false_edge") == [(1, 2, True, False), (4, 5, False, True)]


def test_degrees_leave_false_edges_out_of_the_border(spark):
    nodes = spark.createDataFrame([(1, 7), (2, 0)], "id long, boundary_size long")
    edges = spark.createDataFrame([(1, 2, 5, True), (1, 3, 4, False)], "node1 long, node2 long, edge_size long, false_edge boolean")
    assert rows(gr.degrees(nodes, edges), "id", "degree", "border") == [(1, 2, 11), (2, 1, 0)]


def test_coloring_is_proper_and_greedy(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "node1 long, node2 long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "id long")
    assert rows(gr.coloured(nodes, edges), "id", "color") == [(1, 0), (2, 1), (3, 2), (4, 0), (9, 0)]


def test_paths_take_the_best_product(spark):
    edges = spark.createDataFrame([(1, 2, 1, 0.1), (2, 3, 1, 0.1), (1, 3, 1, 0.6)], "node1 long, node2 long, edge_size long, weight double")
    got = {(r["head"], r["id"]): round(r["prob"], 4) for r in gr.best_paths(edges, spark.createDataFrame([(1,)], "id long"), 0.01, 5).collect()}
    assert got == {(1, 2): 0.9, (1, 3): 0.81}


def test_identical_labellings_have_no_information_distance(spark):
    t = spark.createDataFrame([(1, 1, 5), (2, 2, 7)], "seg long, gt long, count long")
    assert tuple(ov.variation_of_information(t).first()) == (0.0, 0.0)


def test_codecs_round_trip(spark):
    df = spark.createDataFrame([(3, [1.5, 2.5, -1.0, 0.0], [1, 2])], "n long, sums array<double>, counts array<long>")
    out = df.select(codecs.unpack_count(codecs.pack_count("n")).alias("n"), codecs.unpack_moments(codecs.pack_moments("n", "sums")).alias("m"), codecs.unpack_histogram(codecs.pack_histogram("n", "counts")).alias("h")).first()
    assert out.n == 3 and list(out.m.sums) == [1.5, 2.5, -1.0, 0.0] and list(out.h.counts) == [1, 2]


def test_binary_blocks(spark, tmp_path):
    (tmp_path / "b.bin").write_bytes(np.array([2, 1, 2, 7, 8, 9, 0], "<u8").tobytes())
    assert rows(volumes.read_blocks(spark, str(tmp_path)), "x", "y", "z", "label") == [(0, 0, 0, 7), (0, 0, 1, 9), (1, 0, 0, 8), (1, 0, 1, 0)]


def test_similar_pairs_against_brute_force(spark):
    x = np.random.default_rng(1).normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    want = sorted((i, j) for i in range(60) for j in range(i + 1, 60) if np.linalg.norm(x[i] - x[j]) < 1.0)
    assert rows(ft.similar_pairs(df, 1.0), "id1", "id2") == want


def test_similar_pairs_odd_rows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ft, "BLOCK", 7)
    monkeypatch.setattr(ft, "TILE", 3)
    x = np.random.default_rng(2).normal(size=(90, 4)).tolist() + [[1e200] * 4] * 2 + [[0.5] * 4] * 20
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf")] * 4), (204, [0.5] * 3), (205, []), (None, [0.5] * 4), (7, x[7])]
    df = spark.createDataFrame([*enumerate(x), *odd], "id long, v array<double>")
    near = [(i, j) for i in range(112) for j in range(i + 1, 112) if np.linalg.norm(np.subtract(x[i], x[j])) < 1.0]
    assert rows(ft.similar_pairs(df, 1.0), "id1", "id2") == sorted(near + [p for p in near if 7 in p])


def test_similar_pairs_of_one_length_make_no_row_a_pair(spark):
    x = np.random.default_rng(3).normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = ft.similar_pairs(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>"), 1.1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
    assert 0 < got.count() < 20_000


def test_part_graph_deals_more_items_to_more_tasks(spark, monkeypatch):
    from regraph.sources import fixtures

    sf = "/root/testdata/sf0.001"
    want = rows(fixtures.part_graph(spark, sf)[1], "node1", "node2", "edge_size")
    monkeypatch.setattr(fixtures, "TASK_ITEMS", 300)
    edges = fixtures.part_graph(spark, sf)[1]
    assert edges.rdd.getNumPartitions() == -(-fixtures.load(spark, sf, "lineitem").count() // 300) == fixtures.part_tasks(spark, sf)
    assert rows(edges, "node1", "node2", "edge_size") == want


def test_components_broadcast_no_labels(spark, monkeypatch):
    plans, kept = [], gr.kept
    monkeypatch.setattr(gr, "kept", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8)], "node1 long, node2 long")
    assert rows(gr.components(edges), "old", "new") == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_stream_merge_equals_batch(spark, tmp_path):
    from regraph.streaming.merge import merged_stream, write_totals

    parts = [[(1, 2, 3, 0.5, 0.25), (2, 3, 1, 1.0, 1.0)], [(1, 2, 4, 0.5, 0.25)]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, "node1 long, node2 long, edge_size long, p_s1 double, p_s2 double").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    q = write_totals(merged_stream(spark, str(tmp_path / "in" / "*")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "node1", "node2", "edge_size", "p_s1") == [(1, 2, 7, 1.0), (2, 3, 1, 1.0)]
