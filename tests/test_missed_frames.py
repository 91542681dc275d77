import random

import pytest

from trackloom.operators import tracks


def test_missed_frames_are_no_rows(spark):
    """Evidence, hits and confirmation as by one step after another, with a row for each box only: its number of rows doesn't grow with the frames."""
    rng = random.Random(6)
    frames = {"a": sorted(rng.sample(range(5000), 900)), "b": [3, 4, 9], "c": [7]}
    boxes = [("a", f, t, rng.choice([None, rng.random(), 1.0])) for t in range(4) for f in rng.sample(frames["a"], 40)]
    boxes += [("b", 4, 1, 0.9), ("b", 3, 2, None), ("c", 7, 1, 0.4)]
    want, score = {}, {r[:3]: r[3] for r in boxes}
    for seq, track in {(r[0], r[2]) for r in boxes}:
        e, hits, ok = 0.0, 0, False
        for f in frames[seq]:
            if f >= min(r[1] for r in boxes if (r[0], r[2]) == (seq, track)):
                x = score.get((seq, f, track))
                e, hits = (0.9 * e if x is None else 0.7 * e + 0.3 * x), hits + (x is not None)
                ok = ok or (x is not None and hits >= 3 and e >= 0.3)
        want[seq, track] = (hits, ok, e)
    df = spark.createDataFrame(boxes, "seq_name string, frame_idx int, track_id int, x double").repartition(3)
    rows = tracks.with_missed(df, spark.createDataFrame([(s, f) for s in frames for f in frames[s]], "seq_name string, frame_idx int"))
    assert rows.count() == len(boxes)
    got = {(r.seq_name, r.track_id): r for r in tracks.evidence_of(rows, "x", 0.3, 0.1, 0.3, 3).collect()}
    assert set(got) == set(want) and any(r.confirmed for r in got.values())
    assert all((got[k].hits, got[k].confirmed) == w[:2] and got[k].evidence == pytest.approx(w[2], rel=1e-9, abs=1e-15) for k, w in want.items())
