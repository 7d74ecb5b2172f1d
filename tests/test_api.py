import random

import pytest

from regraph.api import find_close_bodies, find_important_paths

SCHEMA = "node1 long, node2 long, weight double"


def all_walks(edges, head, hops, least):
    """{id: (prob, hops between, from id's side)} over all simple paths."""
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, 1 - w))
        near.setdefault(b, []).append((a, 1 - w))
    best = {}

    def walk(path, prob):
        for to, p in near.get(path[-1], []):
            if to not in path and prob * p >= least:
                if prob * p > best.get(to, (0,))[0]:
                    best[to] = (prob * p, path[:0:-1])
                if len(path) < hops:
                    walk([*path, to], prob * p)

    walk([head], 1.0)
    return best


def test_close_bodies_and_important_paths_equal_all_walks(spark):
    r = random.Random(6)
    edges = [(a, b, r.randrange(1, 10**6) / 10**6) for a in range(12) for b in range(a) if r.random() < 0.4]
    edges = [(b, a, w) for a, b, w in edges]
    df = spark.createDataFrame(edges, SCHEMA)
    for hops in (1, 3):
        got = {x.id: (x.prob, x.hops) for x in find_close_bodies(df, 3, hops, 0.1).collect()}
        want = all_walks(edges, 3, hops, 0.1)
        assert {i: h for i, (_, h) in got.items()} == {i: h for i, (_, h) in want.items()}
        assert all(p == pytest.approx(want[i][0]) for i, (p, _) in got.items())
    chosen = [1, 3, 7, 9]
    got = {(x.head, x.id): x.hops for x in find_important_paths(df, spark.createDataFrame([(i,) for i in [*chosen, 3, None]], "id long")).collect()}
    assert got == {(h, i): hops for h in chosen for i, (_, hops) in all_walks(edges, h, 3, 0.1).items() if i in chosen and h < i}
    assert find_close_bodies(df, 99, 3, 0.1).count() == 0 and find_important_paths(df.limit(0), df.selectExpr("node1 AS id")).count() == 0
