"""Registered queries of scans, incremental and set-aside writes, archives, reports and global order, and the SQL that checks them. Files lie in the shared folder."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import corruption, order, predicates, summaries, tracks
from trackloom.operators.registry import KEYS, C, query, r6
from trackloom.plans.storage import shared_folder
from trackloom.sources import formats, reports, runs, splits


def new_folder(df: DataFrame) -> str:
    return f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"


def labelled(det: DataFrame) -> DataFrame:
    return det.select("*", C("det_id").alias("track_id"), F.lit("pedestrian").alias("label"), C("det_id").alias("det_pos"))


JSON_SQL = "SELECT seq_name, frame_idx, det_id AS track_id, 'pedestrian' AS label, round(score, 6) AS score, round(cx, 6) + 0.0 AS cx, round(rot_z, 6) + 0.0 AS rot_z FROM det UNION ALL SELECT seq_name, frame_idx, -1, NULL, NULL, NULL, NULL FROM frames f WHERE NOT EXISTS (SELECT 1 FROM det d WHERE d.seq_name = f.seq_name AND d.frame_idx = f.frame_idx)"


@query("s1_json_in_ranges", JSON_SQL, "det", "frames")
def s1(det, frames):
    """Detections written as one JSON file for each sequence, and read in ranges of each."""
    path = new_folder(det)
    formats.boxes_json(frames, labelled(det)).write.partitionBy("seq_name").text(path)
    rows = splits.read_frames(det.sparkSession, path, suffix=".txt", split_bytes=1 << 18)
    return rows.select(*KEYS, "track_id", F.when(C("det_pos").isNotNull(), C("label")).alias("label"), r6(C("score"), "score"), r6(C("cx"), "cx"), r6(C("rot_z"), "rot_z"))


@query("s4_odometry_in_blocks", "SELECT seq_name, CAST(row_number() OVER (PARTITION BY seq_name ORDER BY frame_idx) - 1 AS int) AS frame_idx, timestamp_ns, round(x, 6) AS x, round(qz, 6) AS qz, round(qw, 6) AS qw FROM poses", "poses")
def s4(poses):
    """Poses as CSV files, numbered by their rows across the blocks of a file."""
    path = new_folder(poses)
    columns = ["timestamp_ns", "x", "y", "z", "qx", "qy", "qz", "qw"]
    poses.repartition("seq_name").sortWithinPartitions("seq_name", "frame_idx").select("seq_name", *columns).write.partitionBy("seq_name").option("header", True).csv(path)
    return splits.read_odometry(poses.sparkSession, path).select(*KEYS, "timestamp_ns", r6(C("x"), "x"), r6(C("qz"), "qz"), r6(C("qw"), "qw"))


@query("k9_pending_only", "SELECT seq_name, CASE WHEN seq_name < 'seq_0005' THEN 'first' ELSE 'second' END AS run, frame_idx || ' ' || det_id || CASE WHEN seq_name < 'seq_0005' THEN ' 1' ELSE ' 2' END AS value FROM det", "det")
def k9(det):
    """A run over some sequences and one over all: the second writes what the first has not."""
    path, spark = new_folder(det), det.sparkSession
    line = lambda n: det.select("seq_name", F.concat_ws(" ", C("frame_idx").cast("string"), C("det_id").cast("string"), F.lit(n)).alias("value"))
    runs.write_pending(line("1").filter("seq_name < 'seq_0005'"), path, "first")
    runs.write_pending(line("2"), path, "second")
    return runs.read_lines(spark, path).select("seq_name", "run", "value")


BROKEN = """SELECT seq_name, frame_idx, CASE WHEN det_id % 29 = 0 THEN det_id + 1 ELSE det_id END AS track_id, CASE WHEN det_id % 17 <> 0 THEN cx END AS cx, CASE WHEN det_id % 19 = 0 THEN CAST('NaN' AS double) ELSE cy END AS cy, cz,
CASE WHEN det_id % 34 = 0 THEN NULL WHEN det_id % 23 = 0 THEN -l ELSE l END AS l, w, CASE WHEN det_id % 31 = 0 THEN CAST('Infinity' AS double) ELSE h END AS h, rot_z, det_id FROM det"""
JUDGED = f"""SELECT *, CASE WHEN cx IS NULL OR l IS NULL THEN 'missing ' || concat_ws(',', CASE WHEN cx IS NULL THEN 'cx' END, CASE WHEN l IS NULL THEN 'l' END)
WHEN isnan(cy) OR isinf(h) THEN 'not finite' WHEN l < 0 THEN 'negative size' WHEN count(*) OVER (PARTITION BY seq_name, frame_idx, track_id) > 1 THEN 'id given twice' END AS wrong FROM ({BROKEN})"""


@query("p8_set_aside", f"SELECT seq_name, frame_idx, track_id, wrong, round(cx, 6) + 0.0 AS cx, NULL AS n FROM ({JUDGED}) UNION ALL SELECT 'all', NULL, NULL, NULL, NULL, count(*) FROM det UNION ALL SELECT 'rejected', NULL, NULL, NULL, NULL, count(wrong) FROM ({JUDGED})", "det")
def p8(det):
    """Boxes that can be used and those that can't, with what is wrong, and the counts observed on the way."""
    broken = det.sparkSession.sql(BROKEN.replace("FROM det", "FROM {det}"), det=det)
    accepted, rejected, counts = runs.quarantined(broken)
    box = lambda rows, wrong: rows.select(*KEYS, "track_id", wrong.alias("wrong"), r6(C("cx"), "cx"), F.lit(None).cast("long").alias("n"))
    totals = det.sparkSession.createDataFrame([(k, None, None, None, None, v) for k, v in counts.items()], "seq_name string, frame_idx int, track_id int, wrong string, cx double, n long")
    return box(accepted, F.lit(None).cast("string")).unionByName(box(rejected, C("wrong"))).unionByName(totals)


@query("p1_missing_keys", "SELECT seq_name, frame_idx, CAST(det_id AS bigint) AS track_id, CASE WHEN det_id % 17 = 0 AND det_id % 34 <> 0 THEN 'missing cx' WHEN det_id % 34 = 0 THEN 'missing cx,l' END AS wrong FROM det", "det", "frames")
def p1(det, frames):
    """Box objects without some of their keys come through JSON with the names of these."""
    some = labelled(det).withColumn("cx", F.when(C("det_id") % 17 != 0, C("cx"))).withColumn("l", F.when(C("det_id") % 34 != 0, C("l")))
    rows = formats.parse_boxes(formats.boxes_json(frames, some)).filter("det_pos is not null")
    accepted, rejected, _ = runs.quarantined(rows)
    return accepted.select(*KEYS, "track_id", F.lit(None).cast("string").alias("wrong")).unionByName(rejected.select(*KEYS, "track_id", "wrong"))


KIND = "SELECT CASE WHEN seq_name < 'seq_0005' THEN 'a' ELSE 'b' END AS split, CASE WHEN det_id % 2 = 0 THEN 'tp' ELSE 'fp' END AS kind, score FROM det"


def kinds(det: DataFrame) -> DataFrame:
    return det.select(F.when(C("seq_name") < "seq_0005", "a").otherwise("b").alias("split"), F.when(C("det_id") % 2 == 0, "tp").otherwise("fp").alias("kind"), "score")


@query("s8_array_archives", f"SELECT split, kind, round(CAST(CAST(least(1, score) AS float) AS double), 4) AS score, count(*) AS n FROM ({KIND}) GROUP BY ALL", "det")
def s8(det):
    """Scores as one archive of arrays for each split, read and decoded again."""
    path = new_folder(det)
    runs.write_archives(kinds(det), path, "split")
    rows = runs.read_archives(det.sparkSession, path)
    return rows.groupBy(C("name").alias("split"), "kind", F.round("score", 4).alias("score")).agg(F.count(F.lit(1)).alias("n"))


BIN = "CAST(least(floor(greatest(least(score, 1.0), 0.0) * 20), 19) AS int)"


def report(det: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    path = new_folder(det)
    runs.write_score_report(kinds(det), path)
    return runs.read_score_report(det.sparkSession, path)


@query("k7_distribution_files", f"SELECT split, kind, {BIN} AS bin, count(*) AS n, round(min(score), 6) AS min, round(max(score), 6) AS max FROM ({KIND}) GROUP BY ALL", "det")
def k7_distribution(det):
    return report(det)[0].select("split", "kind", "bin", "n", r6(C("min"), "min"), r6(C("max"), "max"))


@query("k7_calibrator_files", f"SELECT bin, tp, fp, round(CASE WHEN tp + fp = 0 THEN sum(tp) OVER () / sum(tp + fp) OVER () ELSE (tp + 1.0) / (tp + fp + 2.0) END, 6) AS precision FROM (SELECT CAST(range AS int) AS bin, count(kind) FILTER (kind = 'tp') AS tp, count(kind) FILTER (kind = 'fp') AS fp FROM range(20) LEFT JOIN (SELECT {BIN} AS b, kind FROM ({KIND})) ON b = range GROUP BY 1)", "det")
def k7_calibrator(det):
    return report(det)[1].select("bin", "tp", "fp", r6(C("precision"), "precision"))


@query("k7_summary_files", f"SELECT kind, count(*) AS n, round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.05), 6) AS p05, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95, count(*) FILTER (split = 'a') AS n_a, count(*) FILTER (split = 'b') AS n_b FROM ({KIND}) GROUP BY 1", "det")
def k7_summary(det):
    n_of = lambda s: F.coalesce(F.get(F.filter("per_split", lambda x: x["split"] == s), F.lit(0))["n"], F.lit(0))
    return report(det)[2].select("kind", "n", *(r6(C(c), c) for c in ("min", "max", "mean", "p05", "p50", "p95")), n_of("a").alias("n_a"), n_of("b").alias("n_b"))


RUNS = """SELECT seq_name, CASE WHEN seq_name < 'seq_5' THEN 'a' ELSE 'b' END AS split, CASE WHEN seq_name IN ('seq_3', 'seq_7') THEN 'error' ELSE 'ok' END AS status, count(*) AS num_frames, avg(s) AS mean_step_ms, quantile_cont(s, 0.5) AS p50_step_ms,
quantile_cont(s, 0.9) AS p90_step_ms, quantile_cont(s, 0.99) AS p99_step_ms, count(s) / (sum(s) / 1000) AS fps FROM (SELECT seq_name, CASE WHEN frame_idx >= 3 THEN step_ms END AS s FROM frame_stats) GROUP BY seq_name"""
_NUMBERS = ("fps", "mean_step_ms", "p50_step_ms", "p90_step_ms", "p99_step_ms")


def run_files(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    split = F.when(C("seq_name") < "seq_5", "a").otherwise("b").alias("split")
    failed = C("seq_name").isin("seq_3", "seq_7")
    status = stats.select("seq_name").distinct().select("seq_name", split, F.when(failed, "error").otherwise("ok").alias("status"), F.when(failed, "no detections").alias("error"))
    path = new_folder(stats)
    runs.write_run_summary(summaries.run_stats(tracks.warm_up(stats, 3)).select("*", split), status, path, "split")
    return runs.read_run_summary(stats.sparkSession, path, "split")


@query("k6_sequence_files", f"SELECT split, seq_name, status, CASE WHEN status = 'error' THEN 'no detections' END AS error, CASE WHEN status = 'ok' THEN num_frames ELSE 0 END AS num_frames, {', '.join(f'''round(CASE WHEN status = 'ok' THEN {c} ELSE 0 END, 6) AS {c}''' for c in _NUMBERS)} FROM ({RUNS})", "frame_stats")
def k6_sequences(stats):
    """A row for each sequence of a run, failed ones with their error, as CSV by split."""
    return run_files(stats)[0].select("split", "seq_name", "status", "error", "num_frames", *(r6(C(c), c) for c in _NUMBERS))


@query("k6_total_files", f"SELECT split, count(*) AS num_sequences, count(*) FILTER (ok) AS num_ok, count(*) FILTER (NOT ok) AS num_error, CAST(sum(num_frames) FILTER (ok) AS bigint) AS num_frames, round(avg(fps) FILTER (ok), 6) AS fps_mean, round(min(fps) FILTER (ok), 6) AS fps_min, round(max(fps) FILTER (ok), 6) AS fps_max, round(sum(num_frames) FILTER (ok) / (sum(num_frames * mean_step_ms) FILTER (ok) / 1000), 6) AS fps_weighted, round(avg(mean_step_ms) FILTER (ok), 6) AS step_mean FROM (SELECT *, status = 'ok' AS ok FROM ({RUNS})) GROUP BY 1", "frame_stats")
def k6_totals(stats):
    return run_files(stats)[1].select("split", "num_sequences", "num_ok", "num_error", "num_frames", *(r6(C(c), c) for c in ("fps_mean", "fps_min", "fps_max", "fps_weighted", "step_mean")))


MIXED = "SELECT seq_name, CASE frame_idx % 5 WHEN 0 THEN lpad(CAST(frame_idx AS {0}), 6, '0') || '.pcd' WHEN 1 THEN CAST(frame_idx AS {0}) WHEN 2 THEN 'cam' || frame_idx WHEN 3 THEN 'none-' || chr(97 + frame_idx % 26) ELSE '' END AS frame_id, frame_idx FROM frames"


@query("o1_frame_order", f"SELECT *, row_number() OVER (PARTITION BY seq_name ORDER BY key, frame_id, frame_idx) - 1 AS frame_ord FROM (SELECT seq_name, frame_id, frame_idx, CASE WHEN d = '' THEN 1000000000000000000 ELSE CAST(d AS bigint) END AS key FROM (SELECT *, regexp_replace(frame_id, '[^0-9]', '', 'g') AS d FROM ({MIXED.format('varchar')})))", "frames")
def o1(frames):
    """The place of each frame by ids of several kinds, some without any digit."""
    mixed = frames.sparkSession.sql(MIXED.format("string").replace("FROM frames", "FROM {frames}"), frames=frames)
    keyed = mixed.withColumn("key", formats.frame_order(C("frame_id")))
    return order.numbered(keyed, ["seq_name"], ["key", "frame_id", "frame_idx"], "frame_ord")


@query("o3_export_order", "SELECT seq_name, row_number() OVER (PARTITION BY seq_name ORDER BY frame_idx, det_id) - 1 AS line, frame_idx, det_id AS track_id FROM det", "det")
def o3(det):
    """The lines of exported files, in the order in which they stand there."""
    path = new_folder(det)
    formats.write_tracks(formats.track_lines(det.withColumn("track_id", C("det_id"))), path)
    lines = det.sparkSession.read.schema("value string, seq_name string").text(path)
    lines = lines.select("seq_name", "value", C("_metadata.file_path").alias("file"), C("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    fields = F.split("value", " ")
    placed = order.numbered(lines, ["seq_name"], ["file", "block", "at"], "line")
    return placed.select("seq_name", "line", fields[0].cast("int").alias("frame_idx"), fields[1].cast("int").alias("track_id"))


@query("p7_default_score", "SELECT seq_name, frame_idx, CAST(det_id AS bigint) AS track_id, round(CAST(CASE WHEN det_id % 3 = 0 THEN 1 ELSE score END AS float), 4) AS score FROM det WHERE det_id % 3 = 0 OR score >= 0.8", "det")
def p7(det):
    """Boxes without a score count as 1, in the filter and in what is exported."""
    some = det.withColumn("track_id", C("det_id")).withColumn("score", F.when(C("det_id") % 3 != 0, C("score")))
    lines = formats.track_lines(predicates.scored_at_least(some, 0.8, missing="one"))
    return formats.parse_tracks(lines).select(*KEYS, "track_id", F.round(C("score").cast("float"), 4).alias("score"))


@query("w11_chosen_points", "SELECT seq_name, frame_idx, round(cx, 6) + 0.0 AS x, round(cy, 6) + 0.0 AS y, round(score, 6) AS z FROM (SELECT *, row_number() OVER (PARTITION BY seq_name, frame_idx ORDER BY md5('3 ' || CAST(round(cx * 1000000) AS bigint) || ' ' || CAST(round(cy * 1000000) AS bigint) || ' ' || CAST(round(score * 1000000) AS bigint)), cx, cy, score) AS k FROM det) WHERE k <= 10", "det")
def w11(det):
    """The points that stay, themselves."""
    points = det.select(*KEYS, C("cx").alias("x"), C("cy").alias("y"), C("score").alias("z"))
    return formats.downsampled(points, 10, 3).select(*KEYS, r6(C("x"), "x"), r6(C("y"), "y"), r6(C("z"), "z"))


_SETTINGS = ("severity", "dropout_p_start", "dropout_min_s", "dropout_max_s", "instability_p_switch", "instability_mode_xy_sigma_m", "instability_mode_lwh_sigma_rel", "instability_jitter_xy_sigma_m", "instability_p_yaw_random", "confuser_p_start", "confuser_p_static", "confuser_min_s", "confuser_max_s", "confuser_offset_xy_mu_m", "confuser_offset_xy_sigma_m")
#: Worked out by hand from the spec in corruption.EXAMPLE: of `all`, probabilities and magnitudes are 1.5 times those of its levels, times and the static share are not.
_BY_HAND = """('clean', 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), ('dropout_light', 1, 0.02, 0, 0.4, 0, 0, 0, 0.02, 0, 0, 0, 0, 0, 0, 0), ('dropout_heavy', 1, 0.1, 0.2, 0.8, 0, 0, 0, 0.02, 0, 0, 0, 0, 0, 0, 0),
('switching_on', 1, 0, 0, 0, 0.2, 0.3, 0.1, 0.02, 0.05, 0, 0, 0, 0, 0, 0), ('confusers_near', 1, 0, 0, 0, 0, 0, 0, 0.02, 0, 0.05, 0.5, 0.2, 1, 0.8, 0.2), ('all', 1.5, 0.15, 0.2, 0.8, 0.3, 0.45, 0.15, 0.03, 0.075, 0.075, 0.5, 0.2, 1, 1.2, 0.3)"""


VARIANTS_SQL = f"SELECT n.seq_name, n.n_frames, variant, {', '.join(f'round(CAST({c} AS double), 6) AS {c}' for c in _SETTINGS)} FROM (SELECT seq_name, count(*) AS n_frames FROM frames GROUP BY 1) n, (VALUES {_BY_HAND}) v(variant, {', '.join(_SETTINGS)})"


def beside_frames(frames: DataFrame, spec: dict, settings: tuple[str, ...] = _SETTINGS) -> DataFrame:
    variants = [corruption.scaled(v) for v in corruption.resolve(spec)]
    table = frames.sparkSession.createDataFrame([(v["name"], *(float(v[c]) for c in settings)) for v in variants], f"variant string, {', '.join(f'{c} double' for c in settings)}")
    n = frames.groupBy("seq_name").agg(F.count(F.lit(1)).alias("n_frames")).withColumn("variant", F.explode(F.lit([v["name"] for v in variants])))
    return n.join(F.broadcast(table), "variant").select("seq_name", "n_frames", "variant", *(r6(C(c), c) for c in settings))


#: The settings that no variant of the spec names, by their defaults.
_UNNAMED = """15 AS fps, 1 AS score_value, 0 AS instability_mode_yaw_sigma_rad, 0 AS instability_jitter_yaw_sigma_rad, 0 AS instability_jitter_lwh_sigma_rel, 0 AS confuser_yaw_sigma_rad, 0 AS confuser_lwh_sigma_rel,
0 AS confuser_jitter_xy_sigma_m, 0 AS confuser_jitter_yaw_sigma_rad, 0 AS confuser_jitter_lwh_sigma_rel, 0 AS confuser_p_yaw_random, 0 AS confuser_static_offset_xy_mu_m, 0 AS confuser_static_offset_xy_sigma_m, 0 AS confuser_static_yaw_sigma_rad,
0 AS confuser_static_lwh_sigma_rel, 0 AS confuser_static_jitter_xy_sigma_m, 0 AS confuser_static_jitter_yaw_sigma_rad, 0 AS confuser_static_jitter_lwh_sigma_rel, 0 AS confuser_static_p_yaw_random"""
_REST = tuple(re.findall(r"AS (\w+)", _UNNAMED))


@query("c2_variants", f"SELECT v.*, {', '.join(f'CAST({c} AS double) AS {c}' for c in _REST)} FROM ({VARIANTS_SQL}) v, (SELECT {_UNNAMED})", "frames")
def c2(frames):
    """All settings of each variant, with its severity, beside the number of frames that it will be applied to."""
    return beside_frames(frames, corruption.EXAMPLE, (*_SETTINGS, *_REST))


@query("s9_variants_of_file", VARIANTS_SQL, "frames")
def s9(frames):
    """The same of a spec's file."""
    spark, path = frames.sparkSession, new_folder(frames)
    spark.createDataFrame([(json.dumps(corruption.EXAMPLE),)], "value string").coalesce(1).write.text(path)
    return beside_frames(frames, reports.read_spec(spark, path))
