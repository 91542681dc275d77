import random

from test_components import EDGES, plain_components

from trackloom.operators import components as C


def test_frames_that_go_on_in_other_batches_and_long_chains(spark):
    rng = random.Random(8)
    rows = [("s", 0, i // 2, (i + 1) // 2, 1.0) for i in range(300)]  # one chain through 300 boxes
    rows += [(f"q{rng.randrange(3)}", rng.randrange(5), rng.randrange(30), rng.randrange(30), 1.0) for _ in range(200)]
    rng.shuffle(rows)
    want = plain_components(rows)
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            out = C.components(spark.createDataFrame(rows, EDGES)).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(out) == len(rows) and {(r.seq_name, r.frame_idx, r.track_id, r.det_id): r.component for r in out} == want


def test_edges_are_written_once(spark, monkeypatch):
    found, real = [], C.written
    monkeypatch.setattr(C, "written", lambda df, *a: found.append(1) or real(df, *a))
    C.components(spark.createDataFrame([("s", 0, i, j, 1.0) for i in range(40) for j in (i, i + 1)], EDGES))
    assert len(found) == 1  # before: once for each 12 half rounds
