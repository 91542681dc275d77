import json
import random

import pytest

from trackloom.sources import formats
from trackloom.sources.splits import FileSink, read_frames, read_odometry


def boxes(rng, n):
    out = []
    for _ in range(n):
        box = [round(rng.uniform(-9, 9), 3) for _ in range(7)]
        entry = {"box": box if rng.random() < 0.3 else dict(zip(formats.MEMBERS, box)), "file_id": "000001.pcd"}
        entry |= {k: v for k, v in (("label_id", rng.choice(["pedestrian:4", "é:日", "plain"])), ("score", rng.random())) if rng.random() < 0.7}
        out.append(dict(rng.sample(sorted(entry.items(), key=str), len(entry))))
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, path = random.Random(5), tmp_path_factory.mktemp("json")
    for name, key in (("a", "detections"), ("b", None), ("c", "dets")):
        frames = {f"{i:06d}.pcd" if i % 3 else str(i): boxes(rng, rng.choice([0, 0, 1, 12])) for i in range(40)}
        (path / f"{name}.json").write_text(json.dumps({key: frames} if key else frames, ensure_ascii=name == "a", indent=2 if name == "c" else None))
    (path / ".hidden.json").write_text("{}")
    (path / "notes.txt").write_text("no JSON")
    (path / "empty.json").write_text("")
    return str(path)


@pytest.mark.parametrize("split", [97, 500, 1 << 25])
def test_same_as_whole_files(spark, folder, split):
    if split == 97:  # ranges shorter than most frames, of one file
        folder += "/b.json"
    want = formats.read_boxes(spark, folder).collect()
    df = read_frames(spark, folder, split_bytes=split)
    assert sorted(df.collect(), key=repr) == sorted(want, key=repr) and len(want) > 100
    if split == 500:
        assert spark.read.format("frames").option("splitBytes", 500).load(f"{folder}/a.json").rdd.getNumPartitions() > 5


def test_chosen_sequences(spark, folder):
    df = read_frames(spark, folder).filter("seq_name = 'a'")
    assert {r.seq_name for r in df.collect()} == {"a"} and df.rdd.getNumPartitions() == 1


def test_broken_frames(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"detections": {"000001.pcd": [{"box": [1')
    with pytest.raises(Exception, match="is no list"):
        read_frames(spark, str(tmp_path)).collect()


def test_odometry(spark, tmp_path):
    lines = {name: [f"{i},{i / 8},1,2,0,0,0.5,{i}" for i in range(n)] for name, n in (("a", 700), ("b", 3), ("none", 0))}
    for name, rows in lines.items():
        end = "\r\n" if name == "a" else "\n"
        body = end.join(["timestamp_ns,x,y,z,qx,qy,qz,qw", *rows[:2], "", *rows[2:]])
        (tmp_path / f"{name}.csv").write_text(body + (end if name == "b" else ""), newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = read_odometry(spark, str(tmp_path)).collect()
        assert spark.read.text(f"{tmp_path}/a.csv").rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes"), spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.seq_name, r.frame_idx, r.timestamp_ns, r.x, r.qw) for r in got) == sorted((n, i, i, i / 8, float(i)) for n, rows in lines.items() for i in range(len(rows)))


def test_files_of_rows(spark, tmp_path):
    spark.dataSource.register(FileSink)
    df = spark.createDataFrame([("x/a.bin", b"\x00\x01"), ("b.bin", b"")], "name string, body binary").repartition(2)
    df.write.format("whole_files").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out/x/a.bin").read_bytes() == b"\x00\x01" and (tmp_path / "out/b.bin").read_bytes() == b""
    assert not (tmp_path / "out/_writing").exists()
