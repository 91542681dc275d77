import itertools
import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import components as C
from trackloom.operators.matching import assign

EDGES = "seq_name string, frame_idx int, track_id int, det_id int, cost double"


def graph(seed, frames=12):
    rng = random.Random(seed)
    rows = set()
    for f in range(frames):
        for _ in range(rng.randrange(0, 14)):
            rows.add(("s", f, rng.randrange(8), rng.randrange(8)))
    return [(*r, round(rng.random(), 3)) for r in sorted(rows)]


def plain_components(rows):
    label = {(s, f, "t", t): t for s, f, t, _, _ in rows} | {(s, f, "d", d): 10**9 for s, f, _, d, _ in rows}
    changed = True
    while changed:
        changed = False
        for s, f, t, d, _ in rows:
            a, b = (s, f, "t", t), (s, f, "d", d)
            least = min(label[a], label[b])
            if label[a] != least or label[b] != least:
                label[a] = label[b] = least
                changed = True
    return {(s, f, t, d): label[s, f, "t", t] for s, f, t, d, _ in rows}


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rows = graph(seed)
    # and one long chain, in which labels would walk for a hundred rounds
    rows += [("chain", 0, 100 - i, i, 1.0) for i in range(100)] + [("chain", 0, 100 - i, i + 1, 1.0) for i in range(99)]
    got = {(r.seq_name, r.frame_idx, r.track_id, r.det_id): r.component for r in C.components(spark.createDataFrame(rows, EDGES)).collect()}
    assert got == plain_components(rows)


def test_components_of_odd_edges(spark):
    rows = [("s", 0, 1, 2, 0.5), ("s", 0, 1, 2, 0.5), (None, 0, 1, 1, 0.1), ("s", 0, None, 1, 0.1), ("s", 1, 7, 7, 0.2)]
    got = sorted((r.track_id, r.det_id, r.component) for r in C.components(spark.createDataFrame(rows, EDGES)).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (7, 7, 7)]
    assert C.components(spark.createDataFrame([], EDGES)).collect() == []


def best(edges):
    """The most pairs and their least cost, by all sets."""
    for n in range(len(edges), 0, -1):
        costs = [sum(e[2] for e in s) for s in itertools.combinations(edges, n) if len({e[0] for e in s}) == n == len({e[1] for e in s})]
        if costs:
            return n, min(costs)
    return 0, 0.0


@pytest.mark.parametrize("most", [1, 20, 256])
def test_assignment_by_component(spark, most):
    rows = [r for seed in (3, 4) for r in graph(seed, 8) if seed == 3 or r[1] < 3]
    rows = list({r[:4]: r for r in rows}.values())
    df = spark.createDataFrame(rows, EDGES)
    got = C.assign_by_component(df, most).collect()
    for f in {r[1] for r in rows}:
        mine = [r for r in got if r.frame_idx == f]
        assert len({r.track_id for r in mine}) == len(mine) == len({r.det_id for r in mine})
        by_component = {}
        for r, c in plain_components([r for r in rows if r[1] == f]).items():
            by_component.setdefault(c, []).append((r[2], r[3], next(x[4] for x in rows if x[:4] == r)))
        n, cost = map(sum, zip(*(best(e) for e in by_component.values())))
        assert (len(mine), round(sum(r.cost for r in mine), 6)) == (n, round(cost, 6))
    assert {r.way for r in got} == ({"star", "solved"} if most == 1 else {"star", "sets", "solved"} if most == 20 else {r.way for r in got})
    total = assign(df).agg(F.count("*"), F.sum("cost")).first()
    assert (len(got), pytest.approx(sum(r.cost for r in got))) == (total[0], total[1])


def test_greedy_rounds(spark):
    rows = graph(5, 20)
    df = spark.createDataFrame(rows, EDGES)
    key = lambda df: sorted((r.frame_idx, r.track_id, r.det_id) for r in df.collect())
    assert key(C.greedy_rounds(df)) == key(assign(df, "greedy"))
    assert C.greedy_rounds(df.limit(0)).collect() == []
