import io
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import order
from trackloom.sources import formats, reports, runs

BOXES = "seq_name string, frame_idx int, track_id int, cx double, cy double, cz double, l double, w double, h double, rot_z double, wrong int"


def lines(spark, names, tag):
    return spark.createDataFrame([(n, f"{tag} {i}") for n in names for i in range(5)], "seq_name string, value string")


def test_second_run_writes_what_is_left(spark, tmp_path):
    path = str(tmp_path / "out")
    assert runs.finished(spark, path).collect() == []
    assert {r.seq_name for r in runs.write_pending(lines(spark, "ab", "1"), path, "one").collect()} == {"a", "b"}
    before = {p: p.stat().st_mtime_ns for p in Path(path, "data").rglob("*.txt")}
    assert {r.seq_name for r in runs.write_pending(lines(spark, "abcd", "2"), path, "two").collect()} == {"c", "d"}
    after = {p: p.stat().st_mtime_ns for p in Path(path, "data").rglob("*.txt")}
    assert before.items() <= after.items() and {p.parent.name for p in set(after) - set(before)} == {"seq_name=c", "seq_name=d"}
    got = {(r.seq_name, r.value, r.run) for r in runs.read_lines(spark, path).collect()}
    assert got == {(n, f"{t} {i}", r) for names, t, r in (("ab", 1, "one"), ("cd", 2, "two")) for n in names for i in range(5)}
    assert runs.write_pending(lines(spark, "abcd", "3"), path).collect() == []
    assert {p: p.stat().st_mtime_ns for p in Path(path, "data").rglob("*.txt")} == after


def test_a_run_that_died_is_done_again(spark, tmp_path):
    """Data without its name in the list of finished ones isn't read, and is replaced."""
    path = str(tmp_path / "out")
    lines(spark, "a", "dead").write.partitionBy("seq_name").text(f"{path}/data")
    runs.write_pending(lines(spark, "b", "1"), path, "one")
    assert {r.seq_name for r in runs.read_lines(spark, path).collect()} == {"b"}
    runs.write_pending(lines(spark, "ab", "2"), path, "two")
    assert {(r.seq_name, r.value[0]) for r in runs.read_lines(spark, path).collect()} == {("a", "2"), ("b", "1")}


def test_set_aside_in_one_pass(spark):
    box = (0.0, 1.0, 2.0, 1.0, 1.0, 1.0, 0.1)
    at = lambda i, v: (*box[:i], v, *box[i + 1 :])
    rows = [("s", 0, 1, *box, 0), ("s", 0, 2, *at(0, None), 0), ("s", 0, 3, *at(6, math.inf), 0), ("s", 0, 4, *at(1, math.nan), 0), ("s", 0, 5, *at(3, -1.0), 0), ("s", 1, 1, *box, 0), ("s", 1, 1, *box, 0), (None, None, None, *([None] * 7), 0)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, BOXES)
    good, bad, counts = runs.quarantined(df.mapInArrow(counted, df.schema))
    assert counts == {"all": 8, "rejected": 7} and read.value == 8
    assert [r[:3] for r in good.collect()] == [("s", 0, 1)] and good.columns == df.columns[:-1]
    assert sorted((r.track_id or 0, r.wrong) for r in bad.collect()) == [(0, "missing cx,cy,cz,l,w,h,rot_z"), (1, "id given twice"), (1, "id given twice"), (2, "missing cx"), (3, "not finite"), (4, "not finite"), (5, "negative size")]
    assert read.value == 8  # reading the parts doesn't read the rows again
    good, bad, counts = runs.quarantined(df.limit(0))
    assert good.collect() == bad.collect() == [] and counts == {"all": 0, "rejected": 0}


def test_archives(spark, tmp_path):
    rng = random.Random(4)
    rows = [(s, k, rng.random()) for s in ("a", "b") for k in ("tp", "fp") for _ in range(300)] + [("c", "tp", 0.5)]
    runs.write_archives(spark.createDataFrame(rows, "split string, kind string, score double"), str(tmp_path), "split")
    with np.load(tmp_path / "a.npz") as held:
        assert sorted(held.files) == ["fp_scores", "tp_scores"] and held["tp_scores"].dtype == np.float32 and len(held["fp_scores"]) == 300
    with np.load(tmp_path / "c.npz") as held:
        assert len(held["fp_scores"]) == 0
    (tmp_path / "odd.npz").write_bytes(runs.archive_bytes({"tp_scores": np.array([[0.25, math.nan], [7.0, -1.0]]), "fp_scores": np.array([math.inf]), "score_calib_edges": np.zeros(3)}))
    got = sorted((r.name, r.kind, r.score) for r in runs.read_archives(spark, str(tmp_path), most=7).collect())
    want = [(s, k, float(np.float32(x))) for s, k, x in rows] + [("odd", "tp", x) for x in (0.0, 0.25, 1.0)]
    assert got == sorted(want)
    out = io.BytesIO()
    np.savez(out, other=np.zeros(2))
    (tmp_path / "wrong.npz").write_bytes(out.getvalue())
    with pytest.raises(Exception, match="wrong has no"):
        runs.read_archives(spark, str(tmp_path)).collect()


def test_report_of_nothing(spark, tmp_path):
    runs.write_score_report(spark.createDataFrame([], "split string, kind string, score double"), str(tmp_path / "r"))
    distribution, calibrator, summary = runs.read_score_report(spark, str(tmp_path / "r"))
    assert distribution.collect() == summary.collect() == [] and calibrator.count() == 20


def test_report_reads_scores_once_for_counts(spark):
    cube = runs.score_cube(spark.createDataFrame([("a", "tp", 0.5)], "split string, kind string, score double"), 4)
    assert cube._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert sorted((r.level, r.split, r.kind, r.bin, r.n) for r in cube.collect()) == [(0, "a", "tp", 2, 1), (1, "a", "tp", None, 1), (2, None, "tp", 2, 1), (3, None, "tp", None, 1)]


def test_frame_order(spark):
    ids = ["000010.pcd", "9", "none", "", "frame 3", "10", None, "0003"]
    df = spark.createDataFrame([(s, i) for s in ("a", "b") for i in ids], "seq_name string, frame_id string").repartition(5)
    got = {(r.seq_name, r.frame_ord): r.frame_id for r in order.ordered_frames(df, 3).collect()}
    for s in "ab":
        assert [got[s, k] for k in range(8)] == [None, "0003", "frame 3", "9", "000010.pcd", "10", "", "none"] or [got[s, k] for k in range(8)][0] is None
    assert len(got) == 16 and [got["a", k] for k in range(1, 6)] == ["0003", "frame 3", "9", "000010.pcd", "10"]


def test_whole_table_in_order(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("x"))
    got = order.numbered(df, [], ["x"], "n", 6).collect()
    assert all(r.x == r.n for r in got) and len(got) == 3000
    assert order.numbered(df.limit(0), [], ["x"], "n").collect() == []


def test_spec_of_a_file(spark, tmp_path):
    (tmp_path / "spec.json").write_text('{"base": {"severity": 2}}')
    assert reports.read_spec(spark, str(tmp_path / "spec.json")) == {"base": {"severity": 2}}


def test_points_chosen_are_the_same_however_dealt(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("s", i % 3, rng.random(), rng.random(), rng.random()) for i in range(300)], "seq_name string, frame_idx int, x double, y double, z double")
    chosen = lambda d, seed: sorted(map(tuple, formats.downsampled(d, 10, seed).collect()))
    assert chosen(df.repartition(7), 1) == chosen(df.coalesce(1), 1) != chosen(df, 2) and len(chosen(df, 1)) == 30
