import numpy as np

from regraph import api
from regraph.operators import learning as ln
from regraph.operators import overlap as ov
from regraph.operators.editing import Session
from regraph.sources.fixtures import load, part_graph, voxel_grid

SF = "/root/testdata/sf0.001"


def test_features_training_and_scores(spark):
    v = voxel_grid(spark, SF).cache()
    f = ln.edge_features(v, ("p0", "p1")).cache()
    assert {len(r.features) for r in f.select("features").collect()} == {3 * (1 + 2 * (4 + 5)) + 1 + 2 * 4}
    gt = ov.assignment(ov.contingency(v)).select("seg", "gt")
    samples = ln.training_set(f, gt).cache()
    assert {r.label for r in samples.select("label").distinct().collect()} == {-1, 1}
    model = ln.fit_classifier(samples, trees=8)
    got = ln.scored_edges(model, f).collect()
    assert len(got) == f.count() and all(0 <= r.weight <= 1 for r in got)
    assert {r.weight for r in ln.scored_edges(None, f).collect()} == {0.5}
    train, test = ln.split(samples, 0.5)
    assert train.count() + test.count() == samples.count()
    merged = api.agglomerate(v, ("p0", "p1"), model, 0.5)
    assert merged.count() == v.count() and merged.select("seg").distinct().count() <= v.select("seg").distinct().count()


def test_session_and_undo(spark):
    nodes, edges = part_graph(spark, SF)
    s = Session(nodes.cache(), edges.cache())
    s.set_edge_mode(0.1, 0.9, 0.1)
    before, first = s.remaining(), s.next_edge()
    s.set_result(*first, True)
    assert s.graph()[0].count() == nodes.count() - 1
    second = s.next_edge()
    s.set_result(*second, False)
    assert s.next_edge() != second
    assert s.undo() and s.next_edge() == second and s.undo() and s.next_edge() == first and s.remaining() == before
    assert not s.undo()


def test_propagation_follows_the_nearer_seed(spark):
    v = spark.createDataFrame([(i, [x]) for i, x in enumerate([0.0, 0.3, 0.6, 2.0, 2.3, 9.0])], "id long, v array<double>")
    seeds = spark.createDataFrame([(0, 1.0), (3, -1.0)], "id long, label double")
    got = {r.id: r.belief for r in ln.propagated(v, seeds, 0.5).collect()}
    assert got[0] == 1 and got[1] > 0.9 and got[2] > 0.9 and got[3] == -1 and got[4] < -0.9 and got[5] == 0


def test_propagation_solves_a_chain(spark):
    """Rounds of means stop far from the solution on a chain; the beliefs are those of the linear system."""
    at = np.arange(12) * 0.4
    d = np.abs(at[:, None] - at[None])
    w = np.where((d < 0.5) & (d > 0), np.exp(-np.round(d, 6) ** 2 / (0.5 * 0.5**2)), 0.0)
    system, y = np.diag(w.sum(axis=1) + 1e-4) - w, np.zeros(12)
    system[0], system[11], y[0], y[11] = np.eye(12)[0], np.eye(12)[11], 1.0, -0.5
    v = spark.createDataFrame([*((i, [float(x)]) for i, x in enumerate(at)), (20, [50.0]), (21, [50.1])], "id long, v array<double>")
    seeds = spark.createDataFrame([(0, 1.0), (11, -0.5)], "id long, label double")
    got = {r.id: r.belief for r in ln.propagated(v, seeds, 0.5).collect()}
    assert np.abs(np.array([got[i] for i in range(12)]) - np.linalg.solve(system, y)).max() < 1e-7 and got[20] == got[21] == 0


def test_overlap_weights(spark):
    edges = spark.createDataFrame([(1, 2, 20), (2, 3, 5)], "node1 long, node2 long, edge_size long")
    got = {(r.node1, r.node2): round(r.weight, 4) for r in ln.overlap_weights(None, edges).collect()}
    assert got == {(1, 2): 0.0, (2, 3): 1.0}


def test_queries_do_the_operators_whole_job(spark, monkeypatch):
    from regraph.operators import graph as gr
    from regraph.plans import catalog

    calls = {}

    def held(name):
        def run(*args, **options):
            calls[name] = args, options

        return run

    monkeypatch.setattr(gr, "graph_uncertainty", held("certainty"))
    monkeypatch.setattr(ln, "propagated", held("beliefs"))
    monkeypatch.setattr(ln, "fit_classifier", held("forest"))
    for name in ("graph_certainty", "propagated_beliefs", "classifier_scores"):
        catalog.QUERIES[name](spark, SF)
    assert calls["certainty"][0][1].agg({"weight": "max"}).first()[0] > 0.3
    assert [options for _, options in calls.values()] == [{}, {}, {}]


def test_whole_part_graph_against_brute_force(spark):
    from regraph.plans import catalog

    orders, sizes, pairs = {}, {}, {}
    for o, p in load(spark, SF, "lineitem").select("l_orderkey", "l_partkey").collect():
        orders.setdefault(o, set()).add(p + 1)
        sizes[p + 1] = sizes.get(p + 1, 0) + 1
    for ids in orders.values():
        for a in ids:
            for b in ids:
                if a < b:
                    pairs[a, b] = pairs.get((a, b), 0) + 1
    nodes, edges = part_graph(spark, SF)
    assert {r.id: r["size"] for r in nodes.collect()} == sizes
    assert {(r.node1, r.node2): r.edge_size for r in edges.collect()} == pairs
    asked = catalog.QUERIES["body_mode_questions"](spark, SF)
    assert asked.where("node1 % 8 != 1 or node2 % 8 != 1").limit(1).count()


def test_first_of_equal_features(spark):
    from regraph.operators.learning import first_of_equal

    third = 0.1 + 0.2  # one spacing above 0.3
    rows = [(2, 3, [0.3, 1.0], 1), (1, 9, [third, 1.0], -1), (1, 9, [third, 1.0], -1), (1, 2, [0.3001, 1.0], 1), (5, 6, [float("nan"), None], 1), (4, 6, [float("nan"), None], -1)]
    df = spark.createDataFrame(rows, "node1 long, node2 long, features array<double>, label int")
    got = first_of_equal(df)
    assert got.columns == df.columns
    assert sorted((r.node1, r.node2, r.label) for r in got.collect()) == [(1, 2, 1), (1, 9, -1), (4, 6, -1)]
    assert first_of_equal(df.limit(0)).count() == 0
