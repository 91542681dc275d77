import numpy as np
from pyspark.sql import functions as F

from trackloom.operators.queries import QUERIES
from trackloom.sources import reports, runs, splits


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pending_sequences_are_as_many_files_as_sequences(spark, tmp_path):
    rows = spark.range(400).repartition(8).select(F.concat(F.lit("s"), F.col("id") % 5).alias("seq_name"), F.col("id").cast("string").alias("value"))
    runs.write_pending(rows, str(tmp_path / "out"), "first")
    assert len(list((tmp_path / "out" / "data").glob("seq_name=*/part-*"))) == 5
    assert runs.read_lines(spark, str(tmp_path / "out")).count() == 400


def test_status_rows_go_through_groups_batch_by_batch(spark):
    rows = spark.range(30).select((F.col("id") % 10).alias("k"), "id")
    out = reports.with_status(rows, lambda pdf: {"n": len(pdf), "least": 1 // int(pdf["k"].iloc[0] != 3)}, {"n": "long", "least": "long"}, ["k"])
    assert "FlatMapGroupsInPandas" not in plan(out)
    found = {r["k"]: (r["n"], r["status"], r["error"]) for r in out.collect()}
    assert found[1] == (3, "ok", None) and found[3][0] is None and found[3][1] == "error" and found[3][2].startswith("ZeroDivisionError") and len(found) == 10


def test_archives_are_written_and_read_in_pieces(spark, tmp_path, monkeypatch):
    pieces = list(runs.spread(np.array([0.25, 0.5, 0.75], np.float32), np.array([2, 11, 1]), most=3))
    assert max(map(len, pieces)) < 6 and np.concatenate(pieces).tolist() == [0.25] * 2 + [0.5] * 11 + [0.75]
    rows = spark.createDataFrame([("a", "tp", 0.5)] * 40 + [("a", "tp", None), ("b", "fp", 0.25)], "split string, kind string, score double")
    runs.write_archives(rows, str(tmp_path), "split")
    with np.load(tmp_path / "a.npz") as a, np.load(tmp_path / "b.npz") as b:
        assert a["tp_scores"].shape == (41,) and np.isnan(a["tp_scores"][-1]) and a["fp_scores"].shape == (0,) and b["fp_scores"].tolist() == [0.25] and b["tp_scores"].shape == (0,)
    read = runs.read_archives(spark, str(tmp_path), most=7)
    assert "binaryFile" not in plan(read) or "content" not in read._jdf.queryExecution().executedPlan().toString()
    assert read.count() == 41


def test_a_files_rows_are_its_parts(tmp_path):
    w = splits.FileWriter(str(tmp_path))
    w.commit([w.write([{"name": "x", "body": b"ab"}, {"name": "x", "body": b"cd"}, {"name": "y", "body": b"e"}])])
    assert (tmp_path / "x").read_bytes() == b"abcd" and (tmp_path / "y").read_bytes() == b"e"


def test_many_small_files_do_not_make_as_many_tasks(tmp_path):
    for i in range(600):
        (tmp_path / f"s{i}.json").write_text('{"detections": {"000001.pcd": []}}')
    parts = splits.FrameReader(str(tmp_path), ".json", 1 << 18).partitions()
    assert len(parts) <= 1.5 * splits.TASKS and sum(len(p.ranges) for p in parts) == 600


def test_boxes_and_lines_are_parsed_once(spark, sf):
    assert plan(QUERIES["p1_boxes"](spark, sf)).count("from_json(ArrayType") <= 2  # one for each half of the detections' union
    assert "Join" not in plan(QUERIES["k3_label_lines"](spark, sf)).replace("Join Cross", "").replace("Join Inner, true", "")


def test_corners_are_made_once(spark):
    from trackloom.functions import geometry, layouts

    corners = geometry.corners(*(F.col(c) for c in ("x", "y", "l", "w", "r")))
    area = spark.sql("SELECT 1D AS x, 2D AS y, 3D AS l, 2D AS w, rand() AS r").select(layouts.signed_area(corners).alias("a"))
    assert plan(area).count("COS(") <= 8 and abs(area.first()["a"] - 6) < 1e-9
