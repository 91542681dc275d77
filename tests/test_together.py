import numpy as np
import pytest
from test_tracker import DETS, LABELS, scene

from trackloom.operators import matching
from trackloom.streaming import together
from trackloom.streaming.tracker import CLASS_PRESET, DET, FRAME, LABEL, TRACKERS, Settings, run


def sequences(n, frames=70):
    """Scenes that begin at other frames, of which some frames are missing."""
    out = {}
    for i in range(n):
        rng = np.random.default_rng(100 + i)
        out[f"s{i}"] = {3 * (i % 4) + f: x for f, x in enumerate(scene(i, frames)) if rng.random() < 0.9}
    return out


def alone(name, settings, scenes, timed):
    out = []
    for seq, frames in scenes.items():
        t = TRACKERS[name](settings)
        for f, (dets, labels, time) in frames.items():
            step = (lambda *a: t.step_with_labels(a[0], a[1], labels, a[2])) if hasattr(t, "step_with_labels") else t.step  # noqa: B023
            out += [(seq, f, *x) for x in step(f, dets, time if timed else None)]
    return sorted(out)


def in_step(name, settings, scenes, timed):
    teams, out = together.Teams(TRACKERS[name], settings), []
    for f in sorted({f for x in scenes.values() for f in x}):
        rows = []
        for seq, frames in scenes.items():
            if f in frames:
                dets, labels, time = frames[f]
                slot = teams.slot(seq)
                rows.append((slot, FRAME, 0, time if timed else np.nan, *[np.nan] * 8))
                rows += [(slot, LABEL, k, np.nan, *x, np.nan) for k, x in sorted(labels.items())] + [(slot, DET, i, np.nan, *x) for i, x in enumerate(dets.tolist())]
        x = np.array(rows, float)
        for slot, ids, boxes, hits in teams.frame(f, x[:, 0].astype(int), x[:, 1].astype(int), x[:, 2], x[:, 3], x[:, 4:]):
            out += [(teams.names[s], f, i, *b, h) for s, i, b, h in zip(slot.tolist(), ids.tolist(), boxes.tolist(), hits.tolist())]
    return sorted(out)


@pytest.mark.parametrize("name", ["assisted", "mixture", "nearest", "passthrough"])
@pytest.mark.parametrize("timed,settings", [(False, Settings()), (True, Settings(**CLASS_PRESET)), (True, Settings(top_k=1, dist_gate_m=1.0, late="nominal"))])
def test_sequences_together_are_as_alone(monkeypatch, name, timed, settings):
    monkeypatch.setattr(together, "MOST", 3)
    scenes = {s: {f: (d, dict(sorted(labels.items())), t) for f, (d, labels, t) in x.items()} for s, x in sequences(7).items()}
    want = alone(name, settings, scenes, timed)
    same = lambda rows: str([(seq, *map(float, x)) for seq, *x in rows])
    assert same(in_step(name, settings, scenes, timed)) == same(want) and len(want) > 500


def test_a_task_steps_through_its_sequences_together(spark, monkeypatch):
    dets, labels = [], []
    for seq, frames in sequences(5, 30).items():
        for f, (d, known, _) in frames.items():
            dets += [(seq, f, i, *map(float, x)) for i, x in enumerate(d)]
            labels += [(seq, f, k, *map(float, x)) for k, x in known.items()]
    d, g = spark.createDataFrame(dets, DETS), spark.createDataFrame(labels, LABELS)
    for name in ("assisted", "nearest"):
        out = run(d, name, Settings(), g)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Sort [frame_idx" in plan  # before: Sort [seq_name
        got = out.collect()
        assert {r.seq_name for r in got} == {f"s{i}" for i in range(5)}


def test_late_times_are_errors_if_asked_for():
    teams = together.Teams(TRACKERS["assisted"], Settings(late="error"))
    teams.slot("a")
    row = lambda time: (np.array([0]), np.array([FRAME]), np.array([0]), np.array([time]), np.full((1, 8), np.nan))
    teams.frame(0, *row(5.0))
    with pytest.raises(ValueError, match="time goes from"):
        teams.frame(1, *row(4.0))


def test_assignment_along_edges_is_the_best_of_all():
    rng = np.random.default_rng(7)
    for _ in range(200):
        n, m = rng.integers(1, 9, 2)
        cost = np.where(rng.random((n, m)) < 0.4, rng.random((n, m)) - 0.1, np.inf)
        rows = [[(c, float(cost[r, c])) for c in range(m) if np.isfinite(cost[r, c])] for r in range(n)]
        square = np.full((max(n, m), max(n, m)), 1e6)
        square[:n, :m] = np.where(np.isfinite(cost), cost, 1e6)
        want = [(r, c) for r, c in matching.least_cost(square) if r < n and c < m and np.isfinite(cost[r, c])]
        got = matching.least_cost_of_edges(rows, m)
        assert len(got) == len(want) == len({c for _, c in got}) and sum(cost[p] for p in got) == pytest.approx(sum(cost[p] for p in want))
