from trackloom.operators import joins, predicates, summaries, tracks


def test_timed_and_variants(spark):
    frames = spark.createDataFrame([("s", 0), ("s", 1), ("s", 1), (None, 0)], "seq_name string, frame_idx int")
    poses = spark.createDataFrame([("s", 1, 1_500_000_000)], "seq_name string, frame_idx int, timestamp_ns bigint")
    assert sorted(((r.frame_idx, r.seconds) for r in joins.timed(frames, poses).collect()), key=repr) == [(0, None), (0, None), (1, 1.5), (1, 1.5)]
    assert joins.with_variants(frames, ["a", "b"]).count() == 8 and joins.with_variants(frames, []).count() == 0


def test_sets_of_sequences(spark):
    a, b = (spark.createDataFrame([(x, 1) for x in names], "seq_name string, n int") for names in (["a", "b", "b", None], ["b", None]))
    assert {r.seq_name for r in predicates.in_both(a, b).collect()} == {"b", None}
    assert [r.seq_name for r in predicates.in_first(a, b).collect()] == ["a"]


def test_status_counts_and_clock(spark):
    status = spark.createDataFrame([("x", "ok"), ("x", "ok"), ("y", None)], "split string, status string")
    assert sorted(map(tuple, summaries.status_counts(status, "split").collect())) == [("x", "ok", 2), ("y", None, 1)]
    frames = spark.createDataFrame([("s", 3 * i) for i in range(6)], "seq_name string, frame_idx int")
    assert [(r.seconds, r.whole) for r in tracks.frame_clock(frames, 2.0).sort("frame_idx").collect()] == [(0.0, 0), (0.5, 0), (1.0, 1), (1.5, 2), (2.0, 2), (2.5, 2)]
