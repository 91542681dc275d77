import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import tracks
from trackloom.operators.scans import affine_scan, running_count


@pytest.mark.parametrize("block", [1, 4, 256])
def test_same_as_one_after_another(spark, block):
    rng = random.Random(block)
    rows = []
    for track in (1, 2, None):
        frame = rng.randrange(50)
        for _ in range(60):
            frame += rng.choice([1, 1, 2, 30])
            rows.append(("s", track, frame, rng.choice([0.0, 0.3, 0.9, 1.0, -2.0]), rng.random()))
    rows.append(("other", 1, 5, 0.5, 2.0))
    want = {}
    for seq, track in {(r[0], r[1]) for r in rows}:
        state, n = 3.0, 0
        for r in sorted((r for r in rows if r[:2] == (seq, track)), key=lambda r: r[2]):
            state, n = r[3] * state + r[4], n + (r[4] > 0.5)
            want[r[:3]] = (state, n)
    df = spark.createDataFrame(rows, "seq_name string, track_id int, frame_idx int, x double, y double").repartition(5)
    out = running_count(affine_scan(df, F.col("x"), F.col("y"), 3.0, block=block), F.col("y") > 0.5, "k", block=block)
    got = {(r.seq_name, r.track_id, r.frame_idx): (r.state, r.k) for r in out.collect()}
    assert set(got) == set(want)
    assert all(got[k][0] == pytest.approx(want[k][0], rel=1e-9, abs=1e-12) and got[k][1] == want[k][1] for k in want)
    assert out.columns == ["seq_name", "track_id", "frame_idx", "x", "y", "state", "k"]
    assert affine_scan(df.limit(0), F.col("x"), F.col("y")).collect() == []


def test_nothing_gathers_a_track(spark):
    df = spark.createDataFrame([("s", 1, 1, 0.0, 0.0, 0.5)], "seq_name string, track_id int, frame_idx int, cx double, cy double, x double")
    for out in (tracks.smoothed_speed(df, 0.3, 15.0), tracks.evidence_of(df, "x", 0.3, 0.1, 0.5, 3)):
        assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_long_track(spark):
    """A track of 100,000 frames; states don't overflow and agree with the recurrence."""
    df = spark.range(100_000).select(F.lit("s").alias("seq_name"), F.lit(1).alias("track_id"), F.col("id").cast("int").alias("frame_idx"), (F.col("id") % 97 / 97).alias("x"))
    out = affine_scan(df, F.lit(0.7), 0.3 * F.col("x"))
    got = {r.frame_idx: r.state for r in out.filter("frame_idx % 9973 = 0 or frame_idx = 99999").collect()}
    state = 0.0
    for i in range(100_000):
        state = 0.7 * state + 0.3 * ((i % 97) / 97)
        if i in got:
            assert got[i] == pytest.approx(state, rel=1e-12)
