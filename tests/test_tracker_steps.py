import numpy as np

from trackloom.operators import matching
from trackloom.streaming import tracker


def test_few_and_many_are_assigned_alike(monkeypatch):
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 12):
        cost = rng.random((n, n))
        few = matching.least_cost(cost)
        monkeypatch.setattr(matching, "_SMALL", 0)
        assert matching.least_cost(cost) == few
        monkeypatch.undo()


def test_smoothing_steps_through_all_tracks_at_once(spark, monkeypatch):
    rows = [("s", t, f, 0.1 * f, float(t)) for t in range(30) for f in range(20)]
    boxes = spark.createDataFrame(rows, "seq_name string, track_id int, frame_idx int, cx double, cy double")
    out = tracker.smooth(boxes, tracker.Settings())
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    found = []
    for size in ("10000", "7"):  # tracks that go on in other batches take their filters along
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append(sorted(map(tuple, out.collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and len(found[0]) == 600


def test_only_tracks_that_may_be_static_are_measured():
    family = tracker.Family(tracker.Settings())
    rows = family.add(0.0, np.arange(3), np.arange(3), np.zeros((3, 7)))
    for i in range(10):
        family.push(rows[:2], np.array([[0.0, 0, 0, 0, 0, 0, 0], [0.5 * i, 0, 0, 0, 0, 0, 0]]), np.full(2, 0.1))
    assert family.static().tolist() == [True, False, False] and family.static(np.array([1, 0])).tolist() == [False, True]
    assert family.away_too_long(rows, 3.0).tolist() == [False, True, True] and family.away_too_long(rows, 6.0).all()
