import random

from pyspark.sql import functions as F

from regraph.operators import graph as gr
from regraph.operators import passes as ps
from regraph.operators.inclusions import inclusions

NODES, EDGES = "id long, boundary_size long", "node1 long, node2 long"


def pairs(df):
    return sorted((r["old"], r["new"]) for r in df.collect())


def reach(n, edges, outer, without):
    seen, todo = set(), [v for v in outer if v != without]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += [b if a == v else a for a, b in edges if v in (a, b) and without not in (a, b)]
    return seen


def brute_inclusions(n, edges, outer):
    whole = reach(n, edges, outer, None)
    needs = {v: {x for x in range(n) if x != v and v not in reach(n, edges, outer, x)} for v in whole}
    return sorted((v, x) for v in whole for x in needs[v] if not needs[x])


def test_inclusions_equal_brute_force(spark):
    for seed in range(3):
        r = random.Random(seed)
        n = 40
        edges = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(44)})
        outer = r.sample(range(n), 5)
        got = inclusions(spark.createDataFrame([(i, int(i in outer)) for i in range(n)], NODES), spark.createDataFrame(edges, EDGES))
        want = brute_inclusions(n, edges, outer)
        assert want and pairs(got) == want


def test_preserved_blocks_stay(spark):
    # outside - 1 - {2, 3} - and on 3 hangs 4, on 4 hangs 5; on 1 hangs 6
    nodes = spark.createDataFrame([(1, 3), (2, 0), (3, None), (4, 0), (5, 0), (6, 0), (9, 0)], NODES)
    edges = [(1, 2, False), (2, 3, False), (1, 3, False), (3, 4, False), (4, 5, True), (1, 6, False)]
    e = spark.createDataFrame(edges, EDGES + ", preserve boolean")
    assert pairs(inclusions(nodes, e)) == [(2, 1), (3, 1), (6, 1)]
    assert pairs(inclusions(nodes, e.withColumn("preserve", F.lit(False)))) == [(v, 1) for v in (2, 3, 4, 5, 6)]
    inner = spark.createDataFrame([(1, 2, True), (2, 3, False), (1, 3, False), (3, 4, False), (4, 5, False), (1, 6, False), (1, 6, False)], EDGES + ", preserve boolean")
    assert pairs(inclusions(nodes, inner)) == [(4, 3), (5, 3), (6, 1)]  # the block of 2 and 3 stays, those below it merge
    false = e.withColumn("false_edge", F.col("node2") == 6).drop("preserve")
    assert (6, 1) not in pairs(inclusions(nodes, false))
    assert pairs(inclusions(nodes.limit(0), e.limit(0))) == []


def test_mito(spark):
    nodes = spark.createDataFrame([(1, 100, 5, 1), (2, 10, 0, 2), (3, 8, 0, 2), (4, 5, 90, 2), (5, 3, 0, 1)], "id long, size long, boundary_size long, mito_type int")
    edges = spark.createDataFrame([(1, 2, 9), (2, 3, 9), (2, 5, 2), (3, 5, 1), (1, 4, 10)], EDGES + ", edge_size long")
    keys = {(r["mito"], r["other"]): r["key"] for r in ps.mito_keys(nodes, edges).collect()}
    assert keys == {(2, 1): 1 - 9 / 20, (4, 1): 1 - 10 / 100}  # 5 is smaller than its mitochondria
    # 3 meets 1 only once 2 has merged; 4 has too little in common
    assert pairs(ps.mito_merged(nodes, edges)) == [(2, 1), (3, 1)]
    assert pairs(ps.mito_merged(nodes.limit(0), edges.limit(0))) == []


def test_two_step(spark):
    nodes = spark.createDataFrame([(1, 9, 1), (2, 9, 1), (3, 9, 0), (4, 9, 1), (5, 9, 1)], "id long, size long, boundary_size long")
    edges = spark.createDataFrame([(1, 2, 4, 0.05), (2, 3, 4, 0.9), (2, 4, 4, 0.15), (4, 5, 4, 0.8)], EDGES + ", edge_size long, weight double")
    assert pairs(ps.two_step(nodes, edges, 0.2)) == [(2, 1), (3, 1), (4, 1)]
    low = lambda n, e: e.withColumn("weight", F.lit(0.0))
    assert pairs(ps.two_step(nodes, edges, 0.2, low)) == [(2, 1), (3, 1), (4, 1), (5, 1)]
    assert pairs(ps.two_step(nodes, edges, 0)) == []


def test_greedy_seeds_equal_one_by_one(spark):
    r = random.Random(5)
    edges = sorted({tuple(sorted(r.sample(range(60), 2))) for _ in range(120)})
    near = {v: {b if a == v else a for a, b in edges if v in (a, b)} for v in range(64)}
    want, closed = [], set()
    for v in sorted(near, key=lambda v: (-len(near[v]), v)):
        if v not in closed:
            want.append((v, len(near[v])))
            closed |= near[v]
    got = ps.greedy_seeds(spark.createDataFrame([(i,) for i in range(64)], "id long"), spark.createDataFrame(edges, EDGES))
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_greedy_seeds_drop_pairs_of_closed_nodes(spark, monkeypatch):
    """Every round keeps fewer pairs than the one before it, until none is left; a pair given twice or with itself counts once or not."""
    rows, kept = [], ps.kept

    def counted(df):
        out = kept(df)
        if set(out.columns) == {"id", "other"}:
            rows.append(out.count())
        return out

    monkeypatch.setattr(ps, "kept", counted)
    edges = [(i, i + 1) for i in range(9)] + [(0, 1), (3, 3), (10, 1)]
    got = ps.greedy_seeds(spark.range(11), spark.createDataFrame(edges, "node1 long, node2 long"))
    assert sorted(tuple(x) for x in got.collect()) == [(1, 3), (3, 2), (5, 2), (7, 2), (9, 1)]
    assert rows[0] == 10 and rows[-1] == 0 and all(a > b or a == b == 0 for a, b in zip(rows, rows[1:]))


def test_random_priority_keeps_to_the_threshold(spark):
    e = spark.range(500).selectExpr("id node1", "id + 1 node2", "id / 500.0D weight")
    got = [x["priority"] for x in ps.random_priority(e, 0.4).collect()]
    assert len(got) == 201 and 0 <= min(got) and max(got) < 0.4 and len(set(got)) == 201
    assert [x["priority"] for x in ps.random_priority(e, 0.4).collect()] == got != [x["priority"] for x in ps.random_priority(e, 0.4, 2).collect()]


def test_running_sums_over_ranges(spark):
    from regraph.operators.tables import running_before

    r = random.Random(1)
    values = [r.choice([3, 3, 7, 50, None]) for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")
    want, total = {}, 0
    for v, i in sorted(((-v if v is not None else 1), i) for i, v in enumerate(values)):
        want[i] = total
        total += values[i] or 0
    with_ranges = running_before(df.repartition(5), "v", F.desc_nulls_last("v"), F.col("id"))
    assert {r["id"]: r["before"] for r in with_ranges.collect()} == want
    assert running_before(df.limit(0), "v", F.desc("v"), F.col("id")).collect() == []
