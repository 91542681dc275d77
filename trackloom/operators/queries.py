"""Registered queries of the track operators, and the SQL that checks them. Names begin with the operator's id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.operators import corruption, joins, matching, predicates, summaries, tracks
from trackloom.operators.registry import KEYS, ORACLE_SQL, QUERIES, C, query, r6
from trackloom.sources import formats
from trackloom.streaming import tracker

WRAP = "(CASE WHEN fmod({0}, 2 * pi()) < 0 THEN fmod({0}, 2 * pi()) + 2 * pi() ELSE fmod({0}, 2 * pi()) END)"




@query("g1_wrap_angles", f"SELECT seq_name, frame_idx, track_id, round({WRAP.format('rot_z * 7 - 5')}, 6) + 0.0 AS a, round({WRAP.format('(rot_z * 7 - 5 + pi())')} - pi(), 6) + 0.0 AS b FROM gt", "gt")
def g1(gt):
    a = C("rot_z") * 7 - 5
    return gt.select(*KEYS, "track_id", r6(G.wrap_2pi(a), "a"), r6(G.wrap_pi(a), "b"))


@query("g2_export_axes", f"SELECT seq_name, frame_idx, det_id, round(-cy, 6) + 0.0 AS x, round(-cz + h / 2, 6) + 0.0 AS y, round(cx, 6) + 0.0 AS z, round({WRAP.format('(-rot_z)')}, 6) + 0.0 AS yaw FROM det", "det")
def g2(det):
    axes = G.export_axes(C("cx"), C("cy"), C("cz"), C("h"), C("rot_z"))
    return det.select(*KEYS, "det_id", *(r6(c, n) for n, c in axes.items()))


@query("g3_axes_round_trip", "SELECT seq_name, frame_idx, track_id, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, round(cz, 6) + 0.0 AS cz, round(rot_z, 6) + 0.0 AS rot_z FROM gt", "gt")
def g3(gt):
    e = G.export_axes(C("cx"), C("cy"), C("cz"), C("h"), C("rot_z"))
    back = G.import_axes(e["x"], e["y"], e["z"], C("h"), e["yaw"])
    return gt.select(*KEYS, "track_id", *(r6(c, n) for n, c in back.items()))


@query("g5_yaw_of_quaternion", "SELECT seq_name, frame_idx, round(atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz)), 6) + 0.0 AS yaw FROM poses", "poses")
def g5(poses):
    return poses.select(*KEYS, r6(G.yaw_of_quaternion(C("qx"), C("qy"), C("qz"), C("qw")), "yaw"))


@query(
    "g7_local_to_global",
    """SELECT g.seq_name, g.frame_idx, g.track_id, round((1 - 2 * qz * qz) * cx - 2 * qz * qw * cy + p.x, 6) + 0.0 AS gx, round(2 * qz * qw * cx + (1 - 2 * qz * qz) * cy + p.y, 6) + 0.0 AS gy,
    round(cz + p.z, 6) + 0.0 AS gz, round(rot_z - atan2(2 * qw * qz, 1 - 2 * qz * qz), 6) + 0.0 AS gyaw FROM gt g JOIN poses p ON g.seq_name = p.seq_name AND g.frame_idx = p.frame_idx""",
    "gt", "poses",
)
def g7(gt, poses):
    moved = joins.to_global(gt, poses)
    return moved.select(*KEYS, "track_id", r6(C("cx"), "gx"), r6(C("cy"), "gy"), r6(C("cz"), "gz"), r6(C("rot_z"), "gyaw"))


@query("g9_clips_and_frames", "SELECT seq_name, frame_idx, det_id, round(greatest(0, least(1, score * 2 - 0.7)), 6) AS s, CAST(greatest(1, ceil(score * 15)) AS int) AS n FROM det", "det")
def g9(det):
    return det.select(*KEYS, "det_id", r6(G.unit_clip(C("score") * 2 - 0.7), "s"), G.frames_of_seconds(C("score"), F.lit(15)).alias("n"))


@query("g11_corners", "SELECT seq_name, frame_idx, track_id, round(cx + 0.5 * l * cos(rot_z) - 0.5 * w * sin(rot_z), 6) + 0.0 AS x0, round(cy + 0.5 * l * sin(rot_z) + 0.5 * w * cos(rot_z), 6) + 0.0 AS y0, round(cx - 0.5 * l * cos(rot_z) + 0.5 * w * sin(rot_z), 6) + 0.0 AS x2 FROM gt", "gt")
def g11(gt):
    rows = gt.withColumn("c", G.corners(C("cx"), C("cy"), C("l"), C("w"), C("rot_z")))
    return rows.select(*KEYS, "track_id", r6(C("c")[0]["x"], "x0"), r6(C("c")[0]["y"], "y0"), r6(C("c")[2]["x"], "x2"))


_CORNER = "{{'x': {0}.cx + {1} * {0}.l * cos({0}.rot_z) - {2} * {0}.w * sin({0}.rot_z), 'y': {0}.cy + {1} * {0}.l * sin({0}.rot_z) + {2} * {0}.w * cos({0}.rot_z)}}"
_CORNERS = lambda t: "[" + ", ".join(_CORNER.format(t, a, b) for a, b in ((0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5), (0.5, -0.5))) + "]"
_INSIDE = "lambda q: abs((q.x - {0}.cx) * cos({0}.rot_z) + (q.y - {0}.cy) * sin({0}.rot_z)) <= {0}.l / 2 + 1e-9 AND abs((q.y - {0}.cy) * cos({0}.rot_z) - (q.x - {0}.cx) * sin({0}.rot_z)) <= {0}.w / 2 + 1e-9"
#: Corners of one box in the other and crossings of edges, by angle around their centre, and the area that they enclose.
OVERLAP = f"""SELECT seq_name, frame_idx, track_id, det_id, round(least(1, greatest(0, common / (2 * 0.6 * 0.5 - common))), 6) AS iou FROM (
SELECT *, CASE WHEN len(s) < 3 THEN 0 ELSE abs(list_sum(list_transform(range(1, len(s) + 1), lambda k: s[k].x * s[k % len(s) + 1].y - s[k % len(s) + 1].x * s[k].y))) / 2 END AS common FROM (
SELECT *, list_sort(list_transform(p, lambda q: {{'a': atan2(q.y - my, q.x - mx), 'x': q.x - mx, 'y': q.y - my}})) AS s FROM (
SELECT *, list_avg(list_transform(p, lambda q: q.x)) AS mx, list_avg(list_transform(p, lambda q: q.y)) AS my FROM (
SELECT seq_name, frame_idx, track_id, det_id, list_concat(list_filter(pa, {_INSIDE.format('b')}), list_filter(pb, {_INSIDE.format('a')}),
  list_transform(list_filter(x, lambda c: abs(c.d) >= 1e-12 AND c.t >= 0 AND c.t <= c.d * sign(c.d) AND c.u >= 0 AND c.u <= c.d * sign(c.d)), lambda c: {{'x': c.x + c.ex * c.t / abs(c.d), 'y': c.y + c.ey * c.t / abs(c.d)}})) AS p FROM (
SELECT *, list_transform(range(0, 16), lambda n: {{'x': pa[n // 4 + 1].x, 'y': pa[n // 4 + 1].y, 'ex': pa[(n // 4 + 1) % 4 + 1].x - pa[n // 4 + 1].x, 'ey': pa[(n // 4 + 1) % 4 + 1].y - pa[n // 4 + 1].y,
  'd': (pa[(n // 4 + 1) % 4 + 1].x - pa[n // 4 + 1].x) * (pb[(n % 4 + 1) % 4 + 1].y - pb[n % 4 + 1].y) - (pa[(n // 4 + 1) % 4 + 1].y - pa[n // 4 + 1].y) * (pb[(n % 4 + 1) % 4 + 1].x - pb[n % 4 + 1].x),
  't': sign((pa[(n // 4 + 1) % 4 + 1].x - pa[n // 4 + 1].x) * (pb[(n % 4 + 1) % 4 + 1].y - pb[n % 4 + 1].y) - (pa[(n // 4 + 1) % 4 + 1].y - pa[n // 4 + 1].y) * (pb[(n % 4 + 1) % 4 + 1].x - pb[n % 4 + 1].x)) * ((pb[n % 4 + 1].x - pa[n // 4 + 1].x) * (pb[(n % 4 + 1) % 4 + 1].y - pb[n % 4 + 1].y) - (pb[n % 4 + 1].y - pa[n // 4 + 1].y) * (pb[(n % 4 + 1) % 4 + 1].x - pb[n % 4 + 1].x)),
  'u': sign((pa[(n // 4 + 1) % 4 + 1].x - pa[n // 4 + 1].x) * (pb[(n % 4 + 1) % 4 + 1].y - pb[n % 4 + 1].y) - (pa[(n // 4 + 1) % 4 + 1].y - pa[n // 4 + 1].y) * (pb[(n % 4 + 1) % 4 + 1].x - pb[n % 4 + 1].x)) * ((pb[n % 4 + 1].x - pa[n // 4 + 1].x) * (pa[(n // 4 + 1) % 4 + 1].y - pa[n // 4 + 1].y) - (pb[n % 4 + 1].y - pa[n // 4 + 1].y) * (pa[(n // 4 + 1) % 4 + 1].x - pa[n // 4 + 1].x))}}) AS x FROM (
SELECT a.seq_name, a.frame_idx, a.track_id, b.det_id, a, b, {_CORNERS('a')} AS pa, {_CORNERS('b')} AS pb FROM gt a JOIN det b ON a.seq_name = b.seq_name AND a.frame_idx = b.frame_idx
  AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= CAST(0.45 AS double) * CAST(0.45 AS double)))))))"""


@query("g12_oriented_overlap", OVERLAP, "gt", "det")
def g12(gt, det):
    """Overlap of all boxes of a frame that are near each other."""
    return matching.candidates(gt, det, 0.45, min_iou=0.0).select(*KEYS, "track_id", "det_id", r6(C("iou"), "iou"))


@query("g16_mahalanobis", "SELECT seq_name, frame_idx, det_id, round((0.5 * cx * cx - 2 * 0.1 * cx * cy + 0.4 * cy * cy) / (0.4 * 0.5 - 0.1 * 0.1), 6) AS d2 FROM det", "det")
def g16(det):
    return det.select(*KEYS, "det_id", r6(G.mahalanobis2(C("cx"), C("cy"), F.lit(0.4), F.lit(0.1), F.lit(0.5)), "d2"))


@query("g19_fps_bands", "SELECT seq_name, CASE WHEN f >= 10 THEN 'green' WHEN f >= 8 THEN 'orange' ELSE 'red' END AS band, count(*) AS n FROM (SELECT seq_name, CASE WHEN step_ms < 1e-9 THEN 0.0 ELSE 1000.0 / step_ms END AS f FROM frame_stats) GROUP BY ALL", "frame_stats")
def g19(stats):
    return stats.groupBy("seq_name", G.fps_band(G.fps_of(C("step_ms"))).alias("band")).agg(F.count(F.lit(1)).alias("n"))


NEAR = "SELECT g.seq_name, g.frame_idx, g.track_id, d.det_id, (g.cx - d.cx) * (g.cx - d.cx) + (g.cy - d.cy) * (g.cy - d.cy) AS dist2 FROM gt g JOIN det d ON g.seq_name = d.seq_name AND g.frame_idx = d.frame_idx WHERE (g.cx - d.cx) * (g.cx - d.cx) + (g.cy - d.cy) * (g.cy - d.cy) <= CAST(0.45 AS double) * CAST(0.45 AS double)"


@query("j2_candidates", f"SELECT seq_name, frame_idx, track_id, det_id, round(dist2, 6) AS dist2 FROM ({NEAR})", "gt", "det")
def j2(gt, det):
    return matching.candidates(gt, det, 0.45, z_gate=1.0).select(*KEYS, "track_id", "det_id", r6(C("dist2"), "dist2"))


@query("w1_nearest_candidates", f"SELECT seq_name, frame_idx, track_id, det_id FROM ({NEAR}) QUALIFY row_number() OVER (PARTITION BY seq_name, frame_idx, track_id ORDER BY dist2, det_id) <= 1", "gt", "det")
def w1(gt, det):
    return matching.candidates(gt, det, 0.45, top_k=1).select(*KEYS, "track_id", "det_id")


def matches_of(gt: DataFrame, det: DataFrame, method: str = "optimal") -> DataFrame:
    return matching.assign(matching.edges_of(matching.candidates(gt, det, 0.45, top_k=8)), method)


@query("j12_assignment", None, "gt", "det")
def j12(gt, det):
    return matches_of(gt, det)


@query("j12_greedy_assignment", None, "gt", "det")
def j12_greedy(gt, det):
    return matches_of(gt, det, "greedy")


@query("j8_unmatched", None, "gt", "det")
def j8(gt, det):
    return matching.unmatched(det, matches_of(gt, det)).select(*KEYS, "det_id", "score")


@query("j9_matched", None, "gt", "det")
def j9(gt, det):
    return matching.matched(det, matches_of(gt, det)).select(*KEYS, "det_id", "score")


@query("j1_frame_alignment", "SELECT seq_name, frame_idx, coalesce(n_gt, 0) AS n_gt, coalesce(n_det, 0) AS n_det FROM (SELECT seq_name, frame_idx, count(*) AS n_gt FROM gt GROUP BY ALL) FULL JOIN (SELECT seq_name, frame_idx, count(*) AS n_det FROM det GROUP BY ALL) USING (seq_name, frame_idx)", "gt", "det")
def j1(gt, det):
    return joins.frame_counts(predicates.all_frames(gt, det), n_gt=gt, n_det=det)


@query("s5_timestamps", "SELECT f.seq_name, f.frame_idx, round(p.timestamp_ns * 1e-9, 6) AS t FROM frames f LEFT JOIN poses p ON f.seq_name = p.seq_name AND f.frame_idx = p.frame_idx", "frames", "poses")
def s5(frames, poses):
    return joins.timed(frames, poses).select(*KEYS, r6(C("seconds"), "t"))


JSON_SQL = "SELECT seq_name, frame_idx, det_id AS track_id, 'pedestrian' AS label, round(score, 6) AS score, round(cx, 6) + 0.0 AS cx, round(rot_z, 6) + 0.0 AS rot_z FROM det UNION ALL SELECT seq_name, frame_idx, -1, NULL, NULL, NULL, NULL FROM frames f WHERE NOT EXISTS (SELECT 1 FROM det d WHERE d.seq_name = f.seq_name AND d.frame_idx = f.frame_idx)"


@query("s1_detection_json", JSON_SQL, "det", "frames")
def s1(det, frames):
    """Detections written as JSON and parsed again; frames without any stay."""
    boxes = det.select("*", C("det_id").alias("track_id"), F.lit("pedestrian").alias("label"), C("det_id").alias("det_pos"))
    rows = formats.parse_boxes(formats.boxes_json(frames, boxes))
    return rows.select(*KEYS, "track_id", F.when(C("det_pos").isNotNull(), C("label")).alias("label"), r6(C("score"), "score"), r6(C("cx"), "cx"), r6(C("rot_z"), "rot_z"))


@query("s6_track_text", f"SELECT seq_name, frame_idx, CAST(det_id AS bigint) AS track_id, round(CAST(cx AS float), 4) + 0.0 AS cx, round(CAST(cy AS float), 4) + 0.0 AS cy, round(CAST(score AS float), 4) + 0.0 AS score FROM det", "det")
def s6(det):
    """Track lines of 18 columns, parsed again."""
    rows = formats.parse_tracks(formats.track_lines(det.withColumn("track_id", C("det_id"))))
    return rows.select(*KEYS, "track_id", *((F.round(C(c).cast("float"), 4) + F.lit(0.0).cast("float")).alias(c) for c in ("cx", "cy", "score")))


@query("p6_score_filter", "SELECT seq_name, count(*) AS n FROM det WHERE score >= 0.8 GROUP BY ALL", "det")
def p6(det):
    return predicates.scored_at_least(det, 0.8).groupBy("seq_name").agg(F.count(F.lit(1)).alias("n"))


@query("p9_repeated_ids", "SELECT seq_name, frame_idx, track_id % 20 AS id, count(*) AS n FROM gt GROUP BY ALL HAVING count(*) > 1", "gt")
def p9(gt):
    return predicates.repeated_ids(gt.withColumn("id", C("track_id") % 20), *KEYS, "id")


RUNS = """SELECT seq_name, count(*) AS num_frames, coalesce(sum(s) / 1000, 0) AS total_time_s, coalesce(avg(s), 0) AS mean_step_ms, coalesce(quantile_cont(s, 0.5), 0) AS p50_step_ms,
coalesce(quantile_cont(s, 0.9), 0) AS p90_step_ms, coalesce(quantile_cont(s, 0.99), 0) AS p99_step_ms, CASE WHEN sum(s) > 0 THEN count(s) / (sum(s) / 1000) ELSE 0 END AS fps
FROM (SELECT seq_name, CASE WHEN frame_idx >= 3 THEN step_ms END AS s FROM frame_stats) GROUP BY seq_name"""
RUN_COLUMNS = ("total_time_s", "mean_step_ms", "p50_step_ms", "p90_step_ms", "p99_step_ms", "fps")


def rounded(names, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


@query("a1_run_stats", f"SELECT seq_name, num_frames, {rounded(RUN_COLUMNS)} FROM ({RUNS})", "frame_stats")
def a1(stats):
    return summaries.run_stats(tracks.warm_up(stats, 3)).select("seq_name", "num_frames", *(r6(C(c), c) for c in RUN_COLUMNS))


SPLIT_COLUMNS = ("fps_mean", "fps_median", "fps_min", "fps_max", "fps_weighted", "step_mean", "step_p90", "p99_mean")


@query(
    "a2_split_stats",
    f"SELECT split, num_sequences, {rounded(SPLIT_COLUMNS)} FROM (SELECT CASE WHEN seq_name < 'seq_5' THEN 'a' ELSE 'b' END AS split, count(*) AS num_sequences, avg(fps) AS fps_mean, quantile_cont(fps, 0.5) AS fps_median, min(fps) AS fps_min, max(fps) AS fps_max, sum(num_frames) / (sum(num_frames * mean_step_ms) / 1000) AS fps_weighted, avg(mean_step_ms) AS step_mean, quantile_cont(mean_step_ms, 0.9) AS step_p90, avg(p99_step_ms) AS p99_mean FROM ({RUNS}) GROUP BY 1)",
    "frame_stats",
)
def a2(stats):
    runs = summaries.run_stats(tracks.warm_up(stats, 3)).withColumn("split", F.when(C("seq_name") < "seq_5", "a").otherwise("b"))
    return summaries.split_stats(runs, "split").select("split", "num_sequences", *(r6(C(c), c) for c in SPLIT_COLUMNS))


@query("a3_timing", "SELECT seq_name, n, round(total_ms, 4) AS total_ms, round(total_ms / n, 6) AS mean_ms, round(n * 1000 / total_ms, 6) AS fps, round(s[CAST(round_even(0.95 * (n - 1), 0) AS int) + 1], 6) AS p95_ms FROM (SELECT seq_name, count(*) AS n, sum(step_ms) AS total_ms, list_sort(list(step_ms)) AS s FROM frame_stats GROUP BY 1)", "frame_stats")
def a3(stats):
    return summaries.timing(stats).select("seq_name", "n", F.round("total_ms", 4).alias("total_ms"), r6(C("mean_ms"), "mean_ms"), r6(C("fps"), "fps"), r6(C("p95_ms"), "p95_ms"))


SUMMARY = ("min", "max", "mean", "p05", "p50", "p95")


@query("a4_score_summary", "SELECT seq_name, count(score) AS n, round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.05), 6) AS p05, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95 FROM det GROUP BY 1", "det")
def a4(det):
    return summaries.numeric_summary(det, "score", "seq_name").select("seq_name", "n", *(r6(C(c), c) for c in SUMMARY))


KIND = "SELECT CASE WHEN seq_name < 'seq_0005' THEN 'a' ELSE 'b' END AS split, CASE WHEN det_id % 2 = 0 THEN 'tp' ELSE 'fp' END AS kind, score FROM det"


def kinds(det: DataFrame) -> DataFrame:
    return det.select(F.when(C("seq_name") < "seq_0005", "a").otherwise("b").alias("split"), F.when(C("det_id") % 2 == 0, "tp").otherwise("fp").alias("kind"), "score")


@query("a5_tp_fp_counts", f"SELECT split, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp FROM ({KIND}) GROUP BY ROLLUP (split)", "det")
def a5(det):
    return summaries.tp_fp_counts(kinds(det))


CALIBRATED = f"SELECT bin, tp, fp, CASE WHEN tp + fp = 0 THEN sum(tp) OVER () / sum(tp + fp) OVER () ELSE (tp + 1.0) / (tp + fp + 2.0) END AS precision FROM (SELECT CAST(range AS int) AS bin, count(kind) FILTER (kind = 'tp') AS tp, count(kind) FILTER (kind = 'fp') AS fp FROM range(20) LEFT JOIN (SELECT least(floor(greatest(least(score, 1.0), 0.0) * 20), 19) AS b, kind FROM ({KIND})) ON b = range GROUP BY 1)"


@query("a6_calibrator", f"SELECT bin, tp, fp, round(precision, 6) AS precision FROM ({CALIBRATED})", "det")
def a6(det):
    return summaries.calibrator(kinds(det)).withColumn("precision", F.round("precision", 6))


@query("a7_isotonic", f"WITH c AS ({CALIBRATED}), s AS (SELECT *, greatest(tp + fp, 1) AS n FROM c), m AS (SELECT a.bin AS i, b.bin AS k, (SELECT sum(n * precision) / sum(n) FROM s WHERE bin BETWEEN a.bin AND b.bin) AS v FROM s a JOIN s b ON a.bin <= b.bin) SELECT j.bin, round(max(lo), 6) AS fitted FROM s j JOIN (SELECT j2.bin AS b, i, min(v) AS lo FROM s j2 JOIN m ON i <= j2.bin AND j2.bin <= k GROUP BY 1, 2) ON b = j.bin GROUP BY 1", "det")
def a7(det):
    rows = summaries.calibrator(kinds(det)).select("bin", C("precision").alias("value"), F.greatest(C("tp") + C("fp"), F.lit(1)).alias("weight"))
    return summaries.isotonic(rows).select("bin", F.round("fitted", 6).alias("fitted"))


@query("a8_frame_load", "SELECT f.seq_name, f.frame_idx, (SELECT count(*) FROM gt g WHERE g.seq_name = f.seq_name AND g.frame_idx = f.frame_idx) AS num_gt, (SELECT count(*) FROM det d WHERE d.seq_name = f.seq_name AND d.frame_idx = f.frame_idx) AS num_det FROM frames f", "frames", "gt", "det")
def a8(frames, gt, det):
    return joins.frame_counts(frames, num_gt=gt, num_det=det)


@query("a9_extents", "SELECT seq_name, round(min(cx) - 1, 6) AS x0, round(max(cx) + 1, 6) AS x1, round(min(cy) - 1, 6) AS y0, round(max(cy) + 1, 6) AS y1, round(min(cz) - CASE WHEN max(cz) - min(cz) < 1e-6 THEN 2 ELSE 1 END, 6) AS z0, round(max(cz) + CASE WHEN max(cz) - min(cz) < 1e-6 THEN 2 ELSE 1 END, 6) AS z1 FROM gt GROUP BY 1", "gt")
def a9(gt):
    box = summaries.extents(gt, {"x": "cx", "y": "cy", "z": "cz"}, 1.0, 1.0, "seq_name")
    return box.select("seq_name", *(r6(C(c), c) for c in ("x0", "x1", "y0", "y1", "z0", "z1")))


@query("a10_id_ranks", "SELECT seq_name, track_id, round((dense_rank() OVER (PARTITION BY seq_name ORDER BY track_id) - 1) / greatest(count(*) OVER (PARTITION BY seq_name) - 1, 1), 6) AS shade FROM (SELECT DISTINCT seq_name, track_id FROM gt)", "gt")
def a10(gt):
    return summaries.id_ranks(gt).withColumn("shade", F.round("shade", 6))


LAG = "lag({0}) OVER (PARTITION BY seq_name, track_id ORDER BY frame_idx)"


@query("w2_displacement", f"SELECT seq_name, frame_idx, track_id, CASE WHEN {LAG.format('frame_idx')} = frame_idx - 1 THEN round(cx - {LAG.format('cx')}, 6) END AS dx FROM gt", "gt")
def w2(gt):
    return tracks.displacement(gt).select(*KEYS, "track_id", F.round("dx", 6).alias("dx"))


@query("w3_static_flag", "SELECT *, n >= 7 AND max_radius <= 0.305 AS is_static FROM (SELECT seq_name, frame_idx, track_id, n, round(sqrt(list_max(list_transform(p, lambda q: (q.x - mx) * (q.x - mx) + (q.y - my) * (q.y - my)))), 5) AS max_radius FROM (SELECT seq_name, frame_idx, track_id, list({'x': cx, 'y': cy}) OVER t AS p, CAST(count(*) OVER t AS int) AS n, avg(cx) OVER t AS mx, avg(cy) OVER t AS my FROM gt WINDOW t AS (PARTITION BY seq_name, track_id ORDER BY frame_idx ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)))", "gt")
def w3(gt):
    return tracks.static_flag(gt, radius=0.305).select(*KEYS, "track_id", "n", F.round("max_radius", 5).alias("max_radius"), "is_static")


SPEEDS = "SELECT seq_name, track_id, frame_idx, sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)) * 15.0 / (frame_idx - pf) AS v FROM (SELECT *, lag(cx) OVER t AS px, lag(cy) OVER t AS py, lag(frame_idx) OVER t AS pf FROM gt WINDOW t AS (PARTITION BY seq_name, track_id ORDER BY frame_idx)) WHERE pf IS NOT NULL"


@query("w4_smoothed_speed", f"SELECT seq_name, track_id, CAST(count(*) AS int) AS n, round(list_reduce(list_prepend(CAST(0 AS double), list(v ORDER BY frame_idx)), lambda s, x: s + 0.3 * (x - s)), 6) AS speed FROM ({SPEEDS}) GROUP BY ALL", "gt")
def w4(gt):
    return tracks.smoothed_speed(gt, 0.3, 15.0).withColumn("speed", F.round("speed", 6))


@query("w5_epochs", "SELECT seq_name, frame_idx, track_id, gap, epoch, track_id + epoch * 100000 AS epoch_id FROM (SELECT *, sum(CASE WHEN gap > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_name, track_id ORDER BY frame_idx)::bigint AS epoch FROM (SELECT *, coalesce(frame_idx - lag(frame_idx) OVER (PARTITION BY seq_name, track_id ORDER BY frame_idx), 0) AS gap FROM gt))", "gt")
def w5(gt):
    return tracks.epochs(gt, 5).select(*KEYS, "track_id", "gap", "epoch", "epoch_id")


EVIDENCE = """SELECT seq_name, track_id, list_reduce(list_prepend({'e': CAST(0 AS double), 'h': 0, 'ok': false, 'x': CAST(NULL AS double)}, list({'e': CAST(0 AS double), 'h': 0, 'ok': false, 'x': x} ORDER BY frame_idx)),
  lambda a, b: {'e': CASE WHEN b.x IS NULL THEN 0.9 * a.e ELSE 0.7 * a.e + 0.3 * b.x END, 'h': a.h + CASE WHEN b.x IS NULL THEN 0 ELSE 1 END,
                'ok': a.ok OR (b.x IS NOT NULL AND a.h + 1 >= 3 AND 0.7 * a.e + 0.3 * b.x >= 0.5), 'x': b.x}) AS s
FROM (SELECT f.seq_name, t.id AS track_id, f.frame_idx, CASE WHEN d.score IS NOT NULL THEN pow(greatest(0, least(1, (d.score - 0.4) / 0.6)), 1.5) END AS x
      FROM frames f JOIN (SELECT seq_name, det_id AS id, min(frame_idx) AS a FROM det GROUP BY ALL) t ON f.seq_name = t.seq_name AND f.frame_idx >= t.a
      LEFT JOIN det d ON d.seq_name = f.seq_name AND d.frame_idx = f.frame_idx AND d.det_id = t.id) GROUP BY ALL"""


@query("w6_evidence", f"SELECT seq_name, track_id, s.h AS hits, round(s.e, 6) AS evidence, s.ok AS confirmed FROM ({EVIDENCE})", "det", "frames")
def w6(det, frames):
    """Detections that keep their number are a track; it decays in frames without it."""
    rows = det.select(*KEYS, C("det_id").alias("track_id"), G.evidence(C("score"), 0.4, 1.5).alias("x"))
    return tracks.evidence_of(tracks.with_missed(rows, frames), "x", 0.3, 0.1, 0.5, 3).withColumn("evidence", F.round("evidence", 6))


@query("w9_fresh_ids", "SELECT seq_name, frame_idx, det_id, CAST(row_number() OVER (PARTITION BY seq_name ORDER BY frame_idx, det_id) AS int) AS new_id FROM det", "det")
def w9(det):
    return tracks.fresh_ids(det).select(*KEYS, "det_id", "new_id")


@query("w10_contiguous_frames", "SELECT seq_name, frame_idx, CAST(dense_rank() OVER (PARTITION BY seq_name ORDER BY frame_idx) - 1 AS int) AS out_idx FROM frames", "frames")
def w10(frames):
    return tracks.contiguous_frames(frames)


@query("t1_track_sequences", None, "det", "gt", "frames")
def t1(det, gt, frames):
    """Detections tracked with the help of labels; every frame is a step."""
    return tracker.run(det, "assisted", tracker.Settings(), gt, frames)


@query("t6_nearest_tracks", None, "det")
def t6(det):
    return tracker.run(det, "nearest", tracker.Settings())


@query("t2_mixture_tracks", None, "det", "gt", "frames")
def t2(det, gt, frames):
    return tracker.run(det, "mixture", tracker.Settings(), gt, frames)


@query("t7_several_runs", None, "det", "gt", "frames")
def t7(det, gt, frames):
    """Several trackers over all sequences: tracks and boxes of each run."""
    runs = {"nearest": ("nearest", tracker.Settings()), "assisted__class": ("assisted", tracker.Settings(**tracker.CLASS_PRESET)), "passthrough": ("passthrough", tracker.Settings())}
    return tracker.run_many(det, runs, gt, frames).groupBy("run_name", "seq_name").agg(F.count_distinct("track_id").alias("tracks"), F.count(F.lit(1)).alias("boxes"))


@query("t3_timed_tracks", None, "det", "poses")
def t3(det, poses):
    """The assisted tracker without labels, on the clock of the poses."""
    return tracker.run(det, "assisted", tracker.Settings(), None, poses.select(*KEYS, (C("timestamp_ns") * 1e-9).alias("time")))


@query("t8_smooth_tracks", None, "gt")
def t8(gt):
    return tracker.smooth(gt, tracker.Settings())


@query("c7_corrupt_tracks", None, "gt", "det")
def c7(gt, det):
    """Every track under every variant, with scores drawn from a bounded sample of the detections' own."""
    pool = summaries.score_sample(kinds(det), "tp", "fp")
    return corruption.corrupt(gt, corruption.resolve(corruption.EXAMPLE), seed=5, pools=pool)


# queries of the other modules register themselves
from trackloom.operators import graph_queries, more_queries, run_queries  # noqa: E402, F401
