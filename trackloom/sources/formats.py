"""Readers and writers of detection JSON, odometry CSV, track text and frame statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions.geometry import export_axes, import_axes

#: Names under which files hold their frames, tried in this order.
DETECTION_KEYS = ("detections", "dets", "predictions")
LABEL_KEYS = ("labels", "annotations", "frames", "data")
MEMBERS = ("cx", "cy", "cz", "l", "w", "h", "rot_z")
_ENTRIES = "array<struct<box: string, label_id: string, track_id: bigint, score: double, file_id: string>>"


def frame_number(frame_id: Column) -> Column:
    """The number before the first dot of a frame id; raises if there is none."""
    return F.split_part(F.trim(frame_id), F.lit("."), F.lit(1)).cast("int")


def frame_order(frame_id: Column) -> Column:
    """All digits of a frame id as a number, ids without digits last."""
    digits = F.regexp_replace(frame_id, "[^0-9]", "")
    return F.when(digits == "", F.lit(10**18)).otherwise(digits.cast("long"))


def label_parts(label_id: Column, mode: str = "unknown") -> tuple[Column, Column]:
    """label and track number of 'label:number'. Without a colon or number: unknown/-1, the text itself ('text'), or an error ('strict')."""
    text, number = F.split_part(label_id, F.lit(":"), F.lit(1)), F.substring_index(label_id, ":", -1)
    has = F.instr(label_id, ":") > 0
    if mode == "strict":
        return text, number.cast("long")
    known = F.when(has, number.try_cast("long"))
    other = F.lit("unknown") if mode == "unknown" else label_id
    return F.when(known.isNotNull(), text).otherwise(other), F.coalesce(known, F.lit(-1).cast("long"))


def box_of(box: Column) -> Column:
    """A box from its JSON text, which is an object or a list of seven."""
    seven = lambda v: F.when(F.size(v) == 7, F.struct(*(F.get(v, F.lit(i)).alias(m) for i, m in enumerate(MEMBERS))))
    as_list = F.get(F.transform(F.array(F.from_json(box, "array<double>")), seven), F.lit(0))  # parsed once, not for each member
    as_object = F.from_json(box, ", ".join(f"{m} double" for m in MEMBERS))
    return F.when(F.substring(F.ltrim(box), 1, 1) == "[", as_list).otherwise(as_object)


def parse_boxes(docs: DataFrame, keys: Sequence[str] = DETECTION_KEYS, mode: str = "unknown") -> DataFrame:
    """docs(seq_name, value), one JSON text for each sequence, as rows of boxes; a frame without boxes gives one row
    without a box, so that it isn't lost. The first of the keys that holds an object wins, else the text itself."""
    held = F.coalesce(*(F.get_json_object("value", f"$.{k}") for k in keys), F.col("value"))
    frames = docs.select("seq_name", F.explode(F.from_json(held, f"map<string, {_ENTRIES}>")).alias("frame_id", "entries"))
    return _boxes(frames, mode)


def boxes_of(frames: DataFrame, mode: str = "unknown") -> DataFrame:
    """The same of frames(seq_name, frame_id, value), a frame's list as JSON text each."""
    return _boxes(frames.select("seq_name", "frame_id", F.from_json("value", _ENTRIES).alias("entries")), mode)


def _boxes(frames: DataFrame, mode: str) -> DataFrame:
    rows = frames.select("seq_name", "frame_id", F.posexplode_outer("entries").alias("det_pos", "e"))
    label, number = label_parts(F.col("e.label_id"), mode)
    box = box_of(F.col("e.box"))
    return rows.select("seq_name", "frame_id", frame_number(F.col("frame_id")).alias("frame_idx"), "det_pos", F.coalesce("e.track_id", number, F.lit(-1)).alias("track_id"), label.alias("label"), "e.score", box.alias("box")).select(
        "seq_name", "frame_id", "frame_idx", "det_pos", "track_id", "label", "score", "box.*"
    )


def read_boxes(spark: SparkSession, path: str, keys: Sequence[str] = DETECTION_KEYS, mode: str = "unknown") -> DataFrame:
    """All *.json files under path; a sequence is named by its file. Hidden files are skipped by the scan."""
    docs = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return parse_boxes(docs.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("seq_name"), "value"), keys, mode)


def boxes_json(frames: DataFrame, boxes: DataFrame, key: str = "detections") -> DataFrame:
    """(seq_name, value): each sequence's boxes as JSON, frames without any included."""
    entry = F.struct(F.struct(*MEMBERS).alias("box"), F.concat_ws(":", "label", F.col("track_id").cast("string")).alias("label_id"), "score")
    lists = boxes.groupBy("seq_name", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("det_pos", entry.alias("e")))).alias("e"))
    rows = frames.join(lists, ["seq_name", "frame_idx"], "left").select("seq_name", F.format_string("%06d.pcd", "frame_idx").alias("frame_id"), F.coalesce(F.transform("e", lambda x: x["e"]), F.array().cast("array<struct<box:struct<cx:double,cy:double,cz:double,l:double,w:double,h:double,rot_z:double>,label_id:string,score:double>>")).alias("entries"))
    return rows.groupBy("seq_name").agg(F.to_json(F.create_map(F.lit(key), F.map_from_entries(F.array_sort(F.collect_list(F.struct("frame_id", "entries")))))).alias("value"))


def parse_odometry(docs: DataFrame) -> DataFrame:
    """docs(seq_name, value), one CSV text with a header each: poses, whose frame is the row's number."""
    lines = docs.select("seq_name", F.posexplode(F.split(F.regexp_replace(F.rtrim("value"), "\r", ""), "\n")).alias("pos", "line")).filter("pos > 0 and trim(line) <> ''")
    fields = F.from_csv("line", "timestamp_ns bigint, x double, y double, z double, qx double, qy double, qz double, qw double")
    return lines.select("seq_name", (F.col("pos") - 1).alias("frame_idx"), fields.alias("p")).select("seq_name", "frame_idx", "p.*")


def track_lines(boxes: DataFrame, kind: str = "Pedestrian", alpha: float = 0.0) -> DataFrame:
    """(seq_name, frame_idx, track_id, value): a line of 18 columns for each box, by float32 sizes as files hold them."""
    f32 = {m: F.col(m).cast("float").cast("double") for m in MEMBERS}
    axes = export_axes(f32["cx"], f32["cy"], f32["cz"], f32["h"], f32["rot_z"])
    numbers = [axes["x"], axes["y"], axes["z"], f32["w"], f32["h"], f32["l"], axes["yaw"], F.coalesce("score", F.lit(1.0))]
    text = [F.format_string("%.6f", n.cast("float").cast("double")) for n in numbers]
    value = F.concat_ws(" ", F.col("frame_idx").cast("string"), F.col("track_id").cast("string"), F.lit(kind), F.lit("0"), F.lit("0"), F.format_string("%.6f", F.lit(alpha)), F.lit("0 0 0 0"), *text)
    return boxes.select("seq_name", "frame_idx", "track_id", value.alias("value"))


def write_tracks(lines: DataFrame, path: str) -> None:
    """One folder for each sequence, sorted by frame and track."""
    out = lines.repartition("seq_name").sortWithinPartitions("seq_name", "frame_idx", "track_id")
    out.select("seq_name", "value").write.partitionBy("seq_name").mode("overwrite").text(path)


def parse_tracks(lines: DataFrame, *kept: str) -> DataFrame:
    """lines(seq_name, value) as boxes; blank lines are skipped, 17 columns mean no score. Columns named `kept` stay."""
    c = F.split(F.trim("value"), r"\s+")
    n = lambda i: F.get(c, F.lit(i)).cast("double")
    axes = import_axes(n(10), n(11), n(12), n(14), n(16))
    rows = lines.filter(F.trim("value") != "")
    return rows.select("seq_name", F.get(c, F.lit(0)).cast("int").alias("frame_idx"), F.get(c, F.lit(1)).cast("long").alias("track_id"), F.get(c, F.lit(2)).alias("label"), axes["cx"].alias("cx"), axes["cy"].alias("cy"), axes["cz"].alias("cz"), n(15).alias("l"), n(13).alias("w"), n(14).alias("h"), axes["rot_z"].alias("rot_z"), n(17).alias("score"), *kept)


def true_text(value: Column) -> Column:
    return F.lower(F.trim(value)).isin("1", "true", "t", "yes", "y")


def read_frame_stats(spark: SparkSession, path: str) -> DataFrame:
    schema = "frame_id string, frame_idx int, timestamp_s double, step_ms double, fps_inst double, num_det_in int, num_tracks_out int, num_gt int, is_warmup string"
    return spark.read.schema(schema).csv(path, header=True).withColumn("is_warmup", true_text(F.col("is_warmup")))


def downsampled(points: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n points of each frame, chosen by a seeded digest of their places in micrometres."""
    micro = [F.round(F.col(c) * 1_000_000).cast("long").cast("string") for c in "xyz"]
    order = W.partitionBy("seq_name", "frame_idx").orderBy(F.md5(F.concat_ws(" ", F.lit(str(seed)), *micro)), "x", "y", "z")
    return points.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("rank")


def row_json(boxes: DataFrame, as_list: Column) -> DataFrame:
    """boxes with `value`, each row as JSON: its box as a list or as an object, its label and score if it has them."""
    box = F.when(as_list, F.to_json(F.array(*MEMBERS))).otherwise(F.to_json(F.struct(*MEMBERS)))
    rest = [F.to_json(F.struct(F.col(c))) for c in ("label_id", "score") if c in boxes.columns]
    inner = [F.regexp_extract(x, r"^\{(.*)\}$", 1) for x in rest]
    return boxes.withColumn("value", F.concat(F.lit("{"), F.array_join(F.filter(F.array(F.concat(F.lit('"box":'), box), *inner), lambda x: x != ""), ","), F.lit("}")))
