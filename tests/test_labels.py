import random

import pytest

from regraph.operators import labels as lb


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def replay(n, events, upto):
    """Body of each label after the events up to a step, by moving members one event at a time."""
    body = {i: i for i in range(n)}
    for step, kind, *what in sorted(events):
        if step > upto:
            break
        if kind == "merge":
            remove, keep = what
            for i in body:
                if body[i] == remove:
                    body[i] = keep
        else:
            for i in what[1]:
                body[i] = what[0]
    return body


def random_events(r, n, count):
    """Merges of two bodies that exist, and splits of some labels whose bodies are not named by any of them."""
    events, body = [], {i: i for i in range(n)}
    for step in range(count):
        live = sorted(set(body.values()))
        if r.random() < 0.7 and len(live) > 1:
            event = (step, "merge", *r.sample(live, 2))
        else:
            group = [i for i in body if body[i] not in (i,)]
            if not group:
                continue
            head = r.choice(group)
            own = [i for i in group if body[i] == body[head] and i not in live]
            if head not in own:
                continue
            taken = sorted({head, *r.sample(own, r.randrange(min(3, len(own)) + 1))})
            event = (step, "split", head, taken)
        events.append(event)
        body = replay(n, events, step)
    return events


def tables(spark, events):
    merges = [(s, a, b) for s, kind, a, b in events if kind == "merge"]
    splits = [(s, i, head) for s, kind, head, taken in events if kind == "split" for i in taken]
    return frame(spark, merges, "step long, remove long, keep long"), frame(spark, splits, "step long, label long, head long")


def test_labels_equal_a_replay(spark):
    r, n = random.Random(4), 25
    for count in (30, 60):
        events = random_events(r, n, count)
        assert {e[1] for e in events} == {"merge", "split"}
        merges, splits = tables(spark, events)
        names = frame(spark, [(i,) for i in range(n)], "label long")
        for step in (0, count // 2, None):
            got = {x.label: x.body for x in lb.labels_at(names, merges, splits, step).collect()}
            assert got == replay(n, events, count if step is None else step)


def test_labels_of_odd_events(spark):
    names = frame(spark, [(1,), (1,), (2,), (3,), (9,), (None,)], "label long")
    merges = frame(spark, [(1, 2, 1), (1, 2, 1), (3, 2, 3), (2, 1, 1), (4, None, 1), (None, 3, 1)], "step long, remove long, keep long")
    splits = frame(spark, [], "step long, label long, head long")
    at = lb.labels_at(names, merges, splits)
    assert {tuple(x) for x in at.collect()} == {(1, 1), (2, 1), (3, 3), (9, 9)} and at.count() == 4
    assert [x.label for x in lb.members(at, 1).collect()] == [2]
    assert lb.labels_at(names.limit(0), merges, splits).count() == 0
    round_ = frame(spark, [(1, 1, 2), (2, 2, 3), (3, 3, 1)], "step long, remove long, keep long")
    with pytest.raises(ValueError):
        lb.labels_at(names, round_, splits)
    with pytest.raises(ValueError):
        lb.assigned_after(frame(spark, [(1, 1, 1)], "seg long, gt long, count long"), round_)


def test_assignment_equals_one_merge_at_a_time(spark):
    r = random.Random(8)
    overlap = {(s, g): r.randrange(1, 30) for s in range(12) for g in range(1, 5) if r.random() < 0.6}
    live, merges = list(range(12)), []
    for step in range(8):
        remove, keep = r.sample(live, 2)
        live.remove(remove)
        merges.append((step, remove, keep))
    table = frame(spark, [(s, g, c) for (s, g), c in overlap.items()], "seg long, gt long, count long")
    got = {x.seg: (x.gt, x["count"]) for x in lb.assigned_after(table, frame(spark, merges, "step long, remove long, keep long")).collect()}

    def best(s):
        return max(((c, -g) for (t, g), c in overlap.items() if t == s), default=None)

    for _, remove, keep in merges:
        if best(remove):
            count, gt = best(remove)
            overlap[keep, -gt] = overlap.get((keep, -gt), 0) + count
    assert got == {s: (-best(s)[1], best(s)[0]) for s in live if best(s)}
