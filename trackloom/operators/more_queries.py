"""Registered queries of filters, checks, sources and sinks, layouts, motion models, joins and gates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.functions import layouts, motion
from trackloom.operators import joins, matching, predicates, summaries, tracks
from trackloom.operators.registry import KEYS, C, query, r6
from trackloom.sources import formats, reports

BOX = ("cx", "cy", "cz", "l", "w", "h", "rot_z")


def r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def rc(*names: str):
    return [r6(C(n), n) for n in names]


# ------------------------------------------------------------------ sources and sinks

@query("s2_label_json", f"SELECT seq_name, frame_idx, CAST(track_id AS bigint) AS track_id, 'pedestrian' AS label, {r('cx', 'cy', 'h')} FROM gt", "gt", "frames")
def s2(gt, frames):
    """Labels as JSON under the labels' key, parsed again."""
    docs = formats.boxes_json(frames, gt.select("*", F.lit("pedestrian").alias("label"), F.lit(None).cast("double").alias("score"), C("track_id").alias("det_pos")), key="labels")
    rows = formats.parse_boxes(docs, formats.LABEL_KEYS).filter("det_pos is not null")
    return rows.select(*KEYS, "track_id", "label", *rc("cx", "cy", "h"))


@query("s4_odometry_csv", f"SELECT seq_name, frame_idx, timestamp_ns, {r('x', 'qz', 'qw')} FROM poses", "poses")
def s4(poses):
    """Poses as one CSV text for each sequence, whose rows are the frames, parsed again."""
    line = F.concat_ws(",", *(C(c).cast("string") for c in ("timestamp_ns", "x", "y", "z", "qx", "qy", "qz", "qw")))
    docs = poses.groupBy("seq_name").agg(F.array_sort(F.collect_list(F.struct("frame_idx", line.alias("line")))).alias("rows"))
    head = "timestamp_ns,x,y,z,qx,qy,qz,qw"
    docs = docs.select("seq_name", F.concat(F.lit(head + "\n"), F.array_join(F.transform("rows", lambda x: x["line"]), "\n")).alias("value"))
    return formats.parse_odometry(docs).select(*KEYS, "timestamp_ns", *rc("x", "qz", "qw"))


@query("s7_frame_stats_csv", "SELECT seq_name, frame_idx, round(step_ms, 6) AS step_ms, num_det_in, CAST(NULL AS int) AS num_gt, frame_idx < 3 AS is_warmup FROM frame_stats", "frame_stats")
def s7(stats):
    """Frame statistics as CSV lines (K5) with missing columns empty, parsed again."""
    lines = reports.frame_stats_lines(tracks.warm_up(stats, 3))
    return reports.parse_frame_stats(lines).select(*KEYS, F.round("step_ms", 6).alias("step_ms"), "num_det_in", "num_gt", "is_warmup")


POOLED = "SELECT seq_name, CASE WHEN det_id % 2 = 0 THEN 'tp' ELSE 'fp' END AS kind, score * 1.2 - 0.1 AS score FROM det"


def pooled(det):
    return det.select("seq_name", F.when(C("det_id") % 2 == 0, "tp").otherwise("fp").alias("kind"), (C("score") * 1.2 - 0.1).alias("score"))


@query("s8_score_pools", f"SELECT seq_name, kind, count(*) AS n, round(min(s), 6) AS low, round(max(s), 6) AS high, round(avg(s), 6) AS mean FROM (SELECT seq_name, kind, greatest(0, least(1, score)) AS s FROM ({POOLED})) GROUP BY ALL", "det")
def s8(det):
    """Scores of each sequence as JSON in one of three shapes, read back and clipped."""
    docs = reports.pools_json(pooled(det), "seq_name")
    shape = F.pmod(F.crc32("seq_name"), F.lit(3))
    tp, fp = (F.get_json_object("value", f"$.{k}_scores") for k in ("tp", "fp"))
    second = F.concat(F.lit('{"scores":{"tp":'), tp, F.lit(',"fp":'), fp, F.lit("}}"))
    third = F.concat(F.lit('{"tp":'), tp, F.lit(',"fp":'), fp, F.lit("}"))
    docs = docs.withColumn("value", F.when(shape == 0, C("value")).when(shape == 1, second).otherwise(third))
    return reports.score_pools(docs).groupBy("seq_name", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 6).alias("low"), F.round(F.max("score"), 6).alias("high"), F.round(F.avg("score"), 6).alias("mean"))


@query("s10_variant_list", "SELECT seq_name, 'level_' || CAST(track_id % 4 AS varchar) AS variant FROM gt GROUP BY ALL", "gt")
def s10(gt):
    """The variants that each sequence's manifest (K8) lists."""
    variants = gt.select("seq_name", F.concat(F.lit("level_"), (C("track_id") % 4).cast("string")).alias("name")).distinct().withColumn("settings", F.struct(F.lit(1.5).alias("severity")))
    return reports.variant_names(reports.manifest(variants, 7, "seq_name"))


@query("s11_sequences", "SELECT DISTINCT seq_name FROM frames", "frames")
def s11(frames):
    """Names of JSON files, hidden ones and others among them, as sequences."""
    files = frames.select(F.explode(F.array(F.concat("seq_name", F.lit(".json")), F.concat(F.lit("."), "seq_name", F.lit(".json")), F.concat("seq_name", F.lit(".txt")))).alias("file_name"))
    return reports.sequences_of(files)


@query("s12_frames_of_pair", "SELECT seq_name, frame_idx, max(a) AS labelled, max(b) AS detected FROM (SELECT seq_name, frame_idx, 1 AS a, 0 AS b FROM gt WHERE track_id < 25 UNION ALL SELECT seq_name, frame_idx, 0, 1 FROM det WHERE det_id % 3 = 0) GROUP BY ALL", "gt", "det")
def s12(gt, det):
    """Frames that labels or detections have (U1), and which of them."""
    a, b = gt.filter("track_id < 25").select(*KEYS).distinct().withColumn("labelled", F.lit(1)), det.filter("det_id % 3 = 0").select(*KEYS).distinct().withColumn("detected", F.lit(1))
    return predicates.all_frames(a, b).join(a, list(KEYS), "left").join(b, list(KEYS), "left").select(*KEYS, F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("detected", F.lit(0)).alias("detected"))


@query("s13_labels_by_track", "SELECT seq_name, track_id, count(*) AS n, min(frame_idx) AS first, max(frame_idx) AS last, string_agg(CAST(frame_idx AS varchar), ',' ORDER BY frame_idx) AS frames FROM gt GROUP BY ALL", "gt")
def s13(gt):
    rows = tracks.by_label(gt)
    return rows.select("seq_name", "track_id", F.size("rows").cast("long").alias("n"), C("rows")[0]["frame_idx"].alias("first"), F.element_at("rows", -1)["frame_idx"].alias("last"), F.array_join(F.transform("rows", lambda x: x["frame_idx"].cast("string")), ",").alias("frames"))


@query("k1_checked_lines", f"SELECT seq_name, frame_idx, CAST(track_id AS bigint) AS track_id, 'Pedestrian' AS label, {r('cx', 'cy', 'rot_z', digits=4)} FROM gt WHERE track_id % 5 <> 0", "gt")
def k1(gt):
    """Track lines of checked boxes; those that aren't numbers were taken out before."""
    bad = gt.withColumn("h", F.when(C("track_id") % 5 == 0, float("nan")).otherwise(C("h")))
    good, _ = predicates.finite(bad)
    rows = formats.parse_tracks(formats.track_lines(predicates.checked(good).withColumn("score", F.lit(None).cast("double"))))
    return rows.select(*KEYS, "track_id", "label", *((F.round(c, 4) + 0.0).alias(c) for c in ("cx", "cy", "rot_z")))


@query("k3_label_lines", f"SELECT seq_name, frame_idx, CAST(track_id AS bigint) AS track_id, 'pedestrian' AS label, CAST(NULL AS double) AS score, 17 AS columns, {r('cx', 'cy', digits=4)} FROM gt", "gt")
def k3(gt):
    """Labels as track lines without a score, parsed again."""
    lines = reports.label_lines(gt).withColumn("columns", F.size(F.split("value", " ")))
    rows = formats.parse_tracks(lines, "columns")
    return rows.select(*KEYS, "track_id", "label", "score", "columns", *((F.round(c, 4) + 0.0).alias(c) for c in ("cx", "cy")))


STATUS = "SELECT seq_name, CASE WHEN n % 3 = 0 THEN 'error' WHEN n % 3 = 1 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN seq_name < 'seq_5' THEN 'a' ELSE 'b' END AS split FROM (SELECT seq_name, count(*) AS n FROM frame_stats GROUP BY 1)"


@query("k6_run_summary", f"SELECT split, count(*) AS num_sequences, count(*) FILTER (status = 'ok') AS num_ok, count(*) FILTER (status = 'error') AS num_error, count(*) FILTER (status = 'skipped') AS num_skipped, CAST(coalesce(sum(n) FILTER (status = 'ok'), 0) AS bigint) AS num_frames, round(coalesce(avg(fps) FILTER (status = 'ok'), 0), 6) AS fps_mean FROM ({STATUS}) s JOIN (SELECT seq_name, count(*) AS n, count(*) * 1000 / sum(step_ms) AS fps FROM frame_stats GROUP BY 1) USING (seq_name) GROUP BY split", "frame_stats")
def k6(stats):
    """The summary of a run (A11) as JSON, read back."""
    runs = summaries.run_stats(stats.withColumn("is_warmup", F.lit(False)))
    n = C("num_frames")
    status = runs.select("seq_name", F.when(n % 3 == 0, "error").when(n % 3 == 1, "skipped").otherwise("ok").alias("status"), F.when(C("seq_name") < "seq_5", "a").otherwise("b").alias("split"))
    rows = reports.run_summary(runs, status, "split").select(F.from_json("value", "split string, num_sequences long, num_ok long, num_error long, num_skipped long, num_frames long, fps_mean double").alias("v")).select("v.*")
    return rows.withColumn("fps_mean", F.round("fps_mean", 6))


@query("k7_calibration_summary", f"SELECT kind, count(*) AS n, round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS p50 FROM ({POOLED}) GROUP BY kind", "det")
def k7(det):
    """A summary of the scores of each kind as JSON, read back."""
    rows = summaries.numeric_summary(pooled(det), "score", "kind")
    rows = rows.select(F.from_json(F.to_json(F.struct(*rows.columns)), "kind string, n long, min double, max double, mean double, p50 double").alias("v")).select("v.*")
    return rows.select("kind", "n", *(F.round(c, 6).alias(c) for c in ("min", "max", "mean", "p50")))


@query("k9_pending_sequences", "SELECT DISTINCT seq_name FROM frames WHERE right(seq_name, 1) NOT IN ('1', '4', '7')", "frames")
def k9(frames):
    """Sequences whose name ends so are done already."""
    return reports.pending(frames.select("seq_name").distinct(), frames.filter("right(seq_name, 1) in ('1', '4', '7')"))


@query("k10_status_rows", "SELECT seq_name, frame_idx, CASE WHEN n <= 32 THEN n END AS boxes, CASE WHEN n <= 32 THEN 'ok' ELSE 'error' END AS status, CASE WHEN n > 32 THEN 'ValueError: ' || CAST(n AS varchar) || ' boxes' END AS error FROM (SELECT seq_name, frame_idx, count(*) AS n FROM gt GROUP BY ALL)", "gt")
def k10(gt):
    """Work on each frame, which fails for crowded ones."""

    def work(pdf):
        if len(pdf) > 32:
            raise ValueError(f"{len(pdf)} boxes")
        return {"boxes": len(pdf)}

    return reports.with_status(gt.select(*KEYS, "track_id"), work, {"boxes": "long"}, KEYS)


# ------------------------------------------------------------------ filters, checks, sets

@query("p1_boxes", f"SELECT seq_name, frame_idx, det_id, {r('cx', 'l', 'rot_z')} FROM det WHERE det_id % 7 <> 3", "det")
def p1(det):
    """Boxes as JSON objects or lists; lists of another length are dropped."""
    listed = F.to_json(F.array(*(F.when(C("det_id") % 7 == 3, F.lit(None)).otherwise(C(c)) if c == "rot_z" else C(c) for c in BOX)))
    short = F.to_json(F.array(*(C(c) for c in BOX[:6])))
    text = F.when(C("det_id") % 7 == 3, short).when(C("det_id") % 2 == 0, listed).otherwise(F.to_json(F.struct(*BOX)))
    boxes = F.explode(F.array_compact(F.array(formats.box_of(text)))).alias("b")  # read once, as a filter would read them again
    return det.select(*KEYS, "det_id", boxes).select(*KEYS, "det_id", *(r6(C(f"b.{c}"), c) for c in ("cx", "l", "rot_z")))


LABELLED = "SELECT *, CASE WHEN det_id % 5 = 0 THEN 'Pedestrian' WHEN det_id % 5 = 1 THEN 'pedestrian' WHEN det_id % 5 = 2 THEN NULL ELSE 'car' END AS label FROM det"


def labelled(det):
    k = C("det_id") % 5
    return det.withColumn("label", F.when(k == 0, "Pedestrian").when(k == 1, "pedestrian").when(k == 2, F.lit(None)).otherwise("car"))


@query("p5_class_filter", f"SELECT seq_name, count(*) FILTER (lower(label) = 'pedestrian') AS any_case, count(*) FILTER (label = 'pedestrian') AS exact FROM ({LABELLED}) GROUP BY 1", "det")
def p5(det):
    rows = labelled(det)
    a, b = (predicates.of_class(rows, "pedestrian", exact).groupBy("seq_name").agg(F.count(F.lit(1)).alias(n)) for exact, n in ((False, "any_case"), (True, "exact")))
    return a.join(b, "seq_name", "full").select("seq_name", F.coalesce("any_case", F.lit(0)).alias("any_case"), F.coalesce("exact", F.lit(0)).alias("exact"))


@query("p6_missing_scores", "SELECT seq_name, count(*) FILTER (s >= 0.8) AS dropped, count(*) FILTER (s >= 0.8 OR s IS NULL) AS kept, count(*) FILTER (coalesce(s, 1) >= 0.8) AS one FROM (SELECT seq_name, CASE WHEN det_id % 4 <> 1 THEN score END AS s FROM det) GROUP BY 1", "det")
def p6_missing(det):
    rows = det.withColumn("score", F.when(C("det_id") % 4 != 1, C("score")))
    out = det.select("seq_name").distinct()
    for policy, name in (("drop", "dropped"), ("keep", "kept"), ("one", "one")):
        out = out.join(predicates.scored_at_least(rows, 0.8, policy).groupBy("seq_name").agg(F.count(F.lit(1)).alias(name)), "seq_name", "left")
    return out.na.fill(0)


@query("p8_not_numbers", "SELECT seq_name, count(*) FILTER (track_id % 6 <> 0 AND track_id % 7 <> 0) AS good, count(*) FILTER (track_id % 6 = 0 OR track_id % 7 = 0) AS bad FROM gt GROUP BY 1", "gt")
def p8(gt):
    rows = gt.withColumn("w", F.when(C("track_id") % 6 == 0, float("nan")).when(C("track_id") % 7 == 0, F.lit(None)).otherwise(C("w")))
    good, bad = (x.groupBy("seq_name").agg(F.count(F.lit(1)).alias(n)) for x, n in zip(predicates.finite(rows), ("good", "bad")))
    return good.join(bad, "seq_name")


@query("p10_chosen_sequences", "SELECT seq_name, count(*) AS n FROM det WHERE seq_name IN (SELECT seq_name FROM poses WHERE frame_idx = 3) AND seq_name NOT IN (SELECT seq_name FROM gt WHERE track_id = 45) GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM det", "det", "gt", "poses")
def p10(det, gt, poses):
    n = predicates.chosen(det, poses.filter("frame_idx = 3"), gt.filter("track_id = 45")).groupBy("seq_name").agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(det.agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("seq_name"), "n"))


@query("p11_run_names", "SELECT seq_name, CASE WHEN frame_idx % 2 = 0 THEN 'base__v' || CAST(frame_idx % 3 AS varchar) || '__global' ELSE 'base__global' END AS run, count(*) AS n FROM frames GROUP BY ALL", "frames")
def p11(frames):
    variant = F.when(C("frame_idx") % 2 == 0, F.concat(F.lit("v"), (C("frame_idx") % 3).cast("string"))).otherwise("")
    return frames.groupBy("seq_name", predicates.run_name(F.lit("base"), variant, True).alias("run")).agg(F.count(F.lit(1)).alias("n"))


POINTS = "SELECT seq_name, frame_idx, cx AS x, cy AS y, cz + 0.05 * (det_id % 20) AS z FROM det"


def points(det):
    return det.select(*KEYS, C("cx").alias("x"), C("cy").alias("y"), (C("cz") + F.lit(0.05) * (C("det_id") % 20)).alias("z"))


@query("p13_height_band", f"SELECT seq_name, frame_idx, count(*) AS n, round(max(z), 6) AS top FROM ({POINTS}) WHERE z BETWEEN 0.92 AND 1.42 GROUP BY ALL", "det")
def p13(det):
    return predicates.between_heights(points(det), 0.92, 1.42).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("z"), 6).alias("top"))


@query("p14_rows_as_json", f"SELECT seq_name, frame_idx, det_id, {r('cx', 'rot_z')}, det_id % 2 = 0 AS scored FROM det", "det")
def p14(det):
    """Rows as JSON with the box as a list or an object and the score where there is one, read back."""
    text = formats.row_json(det.withColumn("score", F.when(C("det_id") % 2 == 0, C("score"))), C("det_id") % 3 == 0)
    rows = text.select(*KEYS, "det_id", formats.box_of(F.get_json_object("value", "$.box")).alias("b"), F.get_json_object("value", "$.score").isNotNull().alias("scored"))
    return rows.select(*KEYS, "det_id", "b.*", "scored").select(*KEYS, "det_id", *rc("cx", "rot_z"), "scored")


@query("o2_first_sequences", "SELECT DISTINCT seq_name FROM frames ORDER BY 1 LIMIT 3", "frames")
def o2(frames):
    return predicates.first_sequences(frames, 3)


@query("u4_sets_of_sequences", "(SELECT seq_name, 'both' AS kind FROM gt WHERE track_id = 38 INTERSECT SELECT seq_name, 'both' FROM gt WHERE track_id = 39) UNION ALL (SELECT seq_name, 'first' FROM gt WHERE track_id = 38 EXCEPT SELECT seq_name, 'first' FROM gt WHERE track_id = 44)", "gt")
def u4(gt):
    of = lambda k: gt.filter(C("track_id") == k).select("seq_name")
    return predicates.in_both(of(38), of(39)).withColumn("kind", F.lit("both")).unionByName(predicates.in_first(of(38), of(44)).withColumn("kind", F.lit("first")))


@query("u6_pooled_scores", "SELECT kind, count(*) AS n, round(avg(score), 6) AS mean FROM (SELECT CASE WHEN det_id % 2 = 0 THEN 'tp' ELSE 'fp' END AS kind, score FROM det) GROUP BY 1", "det")
def u6(det):
    return predicates.pooled_scores(det.filter("det_id % 2 = 0"), det.filter("det_id % 2 = 1")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


# ------------------------------------------------------------------ geometry, layouts, motion

@query("g4_camera_layout", f"SELECT seq_name, frame_idx, track_id, round(-cy, 6) + 0.0 AS to_right, round(-cz, 6) + 0.0 AS down, {r('cx', 'cy', 'cz', 'h')} FROM gt", "gt")
def g4(gt):
    """The camera's order of numbers, and back."""
    rows = gt.withColumn("a", layouts.to_layout("camera"))
    back = layouts.from_layout("camera", C("a"))
    return rows.select(*KEYS, "track_id", r6(F.get("a", F.lit(3)), "to_right"), r6(F.get("a", F.lit(4)), "down"), *(r6(back[c], c) for c in ("cx", "cy", "cz", "h")))


@query("g7_inverse_and_missing_poses", """SELECT g.seq_name, g.frame_idx, g.track_id, round(CASE WHEN p.qw IS NULL THEN cx ELSE (1 - 2 * qz * qz) * (cx - p.x) + 2 * qz * qw * (cy - p.y) END, 6) + 0.0 AS cx,
    round(CASE WHEN p.qw IS NULL THEN rot_z ELSE rot_z + atan2(2 * qw * qz, 1 - 2 * qz * qz) END, 6) + 0.0 AS rot_z
    FROM gt g LEFT JOIN (SELECT * FROM poses WHERE frame_idx % 10 <> 7) p ON g.seq_name = p.seq_name AND g.frame_idx = p.frame_idx""", "gt", "poses")
def g7_inverse(gt, poses):
    moved = joins.to_global(gt, poses.filter("frame_idx % 10 <> 7"), missing="pass", inverse=True)
    return moved.select(*KEYS, "track_id", *rc("cx", "rot_z"))


@query("g8_layouts", f"SELECT seq_name, frame_idx, det_id, round(w, 6) AS record_3, round(rot_z, 6) + 0.0 AS scored_3, 8 AS n_scored, {r('cx', 'l', 'score')} FROM det", "det")
def g8(det):
    rows = det.withColumn("a", layouts.to_layout("record")).withColumn("b", layouts.to_layout("scored"))
    back = layouts.from_layout("scored", C("b"))
    return rows.select(*KEYS, "det_id", F.round(F.get("a", F.lit(3)), 6).alias("record_3"), r6(F.get("b", F.lit(3)), "scored_3"), F.size("b").alias("n_scored"), *(r6(back[c], c) for c in ("cx", "l", "score")))


@query("g10_new_heights", "SELECT seq_name, frame_idx, track_id, round(cz - h / 2, 6) + 0.0 AS bottom, round(cz - h / 2 + (h * 1.1) / 2, 6) + 0.0 AS cz FROM gt", "gt")
def g10(gt):
    return gt.select(*KEYS, "track_id", r6(G.bottom(C("cz"), C("h")), "bottom"), r6(layouts.new_height(C("cz"), C("h"), C("h") * 1.1), "cz"))


@query("g11_areas", "SELECT seq_name, frame_idx, track_id, round(abs(l * w), 6) AS area, round(l * w, 6) AS signed FROM gt", "gt")
def g11_areas(gt):
    corners = G.corners(C("cx"), C("cy"), C("l"), C("w"), C("rot_z"))
    return gt.select(*KEYS, "track_id", F.round(layouts.area(C("l"), C("w")), 6).alias("area"), F.round(layouts.signed_area(corners), 6).alias("signed"))


NEAR = "SELECT g.seq_name, g.frame_idx, g.track_id, d.det_id, g.cz AS gz, d.cz + 0.03 * (d.det_id % 50) AS dz, sqrt((g.cx - d.cx) * (g.cx - d.cx) + (g.cy - d.cy) * (g.cy - d.cy)) AS dist FROM gt g JOIN det d ON g.seq_name = d.seq_name AND g.frame_idx = d.frame_idx WHERE (g.cx - d.cx) * (g.cx - d.cx) + (g.cy - d.cy) * (g.cy - d.cy) <= CAST(0.45 AS double) * CAST(0.45 AS double)"


@query("g13_height_gate", f"SELECT seq_name, frame_idx, track_id, det_id FROM ({NEAR}) WHERE abs(gz - dz) <= 0.605", "gt", "det")
def g13(gt, det):
    return matching.candidates(gt, det.withColumn("cz", C("cz") + F.lit(0.03) * (C("det_id") % 50)), 0.45, z_gate=0.605).select(*KEYS, "track_id", "det_id")


@query("g14_costs", f"SELECT seq_name, frame_idx, track_id, det_id, round((1 - 0.25) * 10 + dist + 0.1 * least(greatest(det_id % 15 - 2, 0), 10), 6) AS cost FROM ({NEAR})", "gt", "det")
def g14(gt, det):
    pairs = matching.candidates(gt, det, 0.45)
    return pairs.select(*KEYS, "track_id", "det_id", F.round(G.association_cost(F.lit(0.25), F.sqrt("dist2"), C("det_id") % 15 - 2), 6).alias("cost"))


@query("g15_evidence_terms", "SELECT seq_name, frame_idx, det_id, round(pow(greatest(0, least(1, (score - 0.6) / 0.4)), 1.5), 6) AS x, round(1 - exp(-(score / 15) / 0.2), 6) AS gain, round(0.5 + 1.0 * least(1, greatest(0, (score - 0.5) / 0.5)), 6) AS window FROM det", "det")
def g15(det):
    return det.select(*KEYS, "det_id", r6(G.evidence(C("score"), 0.6, 1.5), "x"), r6(G.gain(C("score") / 15, 0.2), "gain"), r6(motion.coast_window(C("score"), 0.5, 0.5, 1.5, 1.0), "window"))


@query("g16_gates", "SELECT seq_name, frame_idx, det_id, CAST(CASE WHEN score >= 0.997 THEN 11.829 WHEN score >= 0.995 THEN 10.597 WHEN score >= 0.99 THEN 9.21 ELSE 5.991 END AS double) AS gate, round(sqrt(5.991 * ((l + w) / 2 + sqrt((l - w) * (l - w) / 4 + 0.01))), 6) AS radius FROM det", "det")
def g16(det):
    return det.select(*KEYS, "det_id", motion.gate_of(C("score")).alias("gate"), F.round(motion.safe_radius(F.lit(5.991), C("l"), F.lit(0.1), C("w")), 6).alias("radius"))


@query("g17_heading_covariance", "SELECT seq_name, frame_idx, det_id, round(0.04 + e * ux * ux, 6) AS sxx, round(e * ux * uy, 6) + 0.0 AS sxy, round(0.04 + e * uy * uy, 6) AS syy FROM (SELECT *, CASE WHEN n < 1.5 THEN 0 ELSE 0.09 - 0.04 END AS e, CASE WHEN n < 1e-9 THEN 1 ELSE cx / n END AS ux, CASE WHEN n < 1e-9 THEN 0 ELSE cy / n END AS uy FROM (SELECT *, sqrt(cx * cx + cy * cy) AS n FROM det))", "det")
def g17(det):
    return det.select(*KEYS, "det_id", *(r6(v, k) for k, v in motion.heading_covariance(F.lit(0.3), F.lit(0.2), C("cx"), C("cy"), 1.5).items()))


@query("g18_outlines", "SELECT seq_name, frame_idx, track_id, 12 AS n_edges, round(cz - h / 2, 6) + 0.0 AS low, round(cz + h / 2, 6) + 0.0 AS high, round(cx - (l * abs(cos(rot_z)) + w * abs(sin(rot_z))) / 2, 6) + 0.0 AS left_x, round(cx + 2 * cos(rot_z), 6) + 0.0 AS ahead FROM gt", "gt")
def g18(gt):
    rows = gt.withColumn("e", layouts.edges()).withColumn("o", layouts.outline("xz"))
    return rows.select(*KEYS, "track_id", F.size("e").alias("n_edges"), r6(F.array_min(F.transform("e", lambda x: x["z0"])), "low"), r6(F.array_max(F.transform("e", lambda x: x["z1"])), "high"), r6(C("o")[0]["x"], "left_x"), r6(layouts.heading_segment(2.0)["x1"], "ahead"))


@query("g21_vectors", "SELECT seq_name, frame_idx, det_id, round(sqrt(cx * cx + cy * cy), 6) AS n, round(CASE WHEN sqrt(cx * cx + cy * cy) < 1e-9 THEN 1 ELSE cx / sqrt(cx * cx + cy * cy) END, 6) + 0.0 AS ux, round(cx * l + cy * w, 6) + 0.0 AS d, round(least(2, greatest(1, cx)), 6) AS c FROM det", "det")
def g21(det):
    x, y = C("cx"), C("cy")
    return det.select(*KEYS, "det_id", r6(motion.norm(x, y), "n"), r6(motion.unit(x, y)[0], "ux"), r6(motion.dot(x, y, C("l"), C("w")), "d"), r6(motion.clamp(x, 1, 2), "c"))


@query("g22_motion_models", "SELECT seq_name, frame_idx, det_id, round(cx, 6) + 0.0 AS still_p, round(cy * 0.5, 6) + 0.0 AS still_v, round(cx + cy * 0.2, 6) + 0.0 AS steady_p, round(cx + cy * 0.2 + l * 0.2 * 0.2 / 2, 6) + 0.0 AS driven_p, round(cy + l * 0.2, 6) + 0.0 AS driven_v, CAST(0.018 AS double) AS q, round(-(ln(l * w - 0.01) + score) / 2, 6) + 0.0 AS ll FROM det", "det")
def g22(det):
    of = lambda m: motion.predicted(m, F.lit(0.2), C("cx"), C("cy"), C("l"))
    columns = [r6(of("still")["p"], "still_p"), r6(of("still")["v"], "still_v"), r6(of("steady")["p"], "steady_p"), r6(of("driven")["p"], "driven_p"), r6(of("driven")["v"], "driven_v")]
    return det.select(*KEYS, "det_id", *columns, F.round(motion.process_noise(0.3, F.lit(0.2)), 6).alias("q"), r6(motion.log_likelihood(C("score"), C("l"), F.lit(0.1), C("w")), "ll"))


@query("g23_moved_boxes", "SELECT seq_name, frame_idx, det_id, round(cx + 1, 6) + 0.0 AS cx, round(cy - 1, 6) + 0.0 AS cy, round(cz, 6) AS cz, round(h, 6) AS h FROM det", "det")
def g23(det):
    rows = det.select(*KEYS, "det_id", motion.moved_to(F.struct(*BOX), C("cx") + 1, C("cy") - 1).alias("b")).select(*KEYS, "det_id", "b.*")
    return rows.select(*KEYS, "det_id", *rc("cx", "cy"), F.round("cz", 6).alias("cz"), F.round("h", 6).alias("h"))


# ------------------------------------------------------------------ joins

SHIFTED = "SELECT g.seq_name, g.frame_idx, g.track_id, d.det_id, sqrt((g.cx - d.cx) * (g.cx - d.cx) + (g.cy - d.cy) * (g.cy - d.cy)) AS dist FROM gt g JOIN det d ON g.seq_name = d.seq_name AND g.frame_idx = d.frame_idx WHERE (g.cx + 0.1 - d.cx) * (g.cx + 0.1 - d.cx) + (g.cy - d.cy) * (g.cy - d.cy) <= CAST(0.4 AS double) * CAST(0.4 AS double)"


@query("j3_gate_on_prediction", f"SELECT seq_name, frame_idx, track_id, det_id, round(dist, 6) AS dist FROM ({SHIFTED})", "gt", "det")
def j3(gt, det):
    """Gates around boxes that are believed to be a little ahead, distances to where they are."""
    believed = gt.withColumn("true_cx", C("cx")).withColumn("true_cy", C("cy")).withColumn("cx", C("cx") + 0.1)
    return joins.gated_by_prediction(believed, det, 0.4).select(*KEYS, "track_id", "det_id", F.round("dist", 6).alias("dist"))


@query("j4_gate_on_covariance", "SELECT seq_name, frame_idx, track_id, det_id, round(d2, 6) AS d2 FROM (SELECT g.seq_name, g.frame_idx, g.track_id, d.det_id, (g.cx - d.cx) * (g.cx - d.cx) + (g.cy - d.cy) * (g.cy - d.cy) AS dist2, (0.03 * (d.cx - g.cx) * (d.cx - g.cx) - 2 * 0.005 * (d.cx - g.cx) * (d.cy - g.cy) + 0.02 * (d.cy - g.cy) * (d.cy - g.cy)) / (0.02 * 0.03 - 0.005 * 0.005) AS d2 FROM gt g JOIN det d ON g.seq_name = d.seq_name AND g.frame_idx = d.frame_idx) WHERE dist2 <= CAST(0.45 AS double) * CAST(0.45 AS double) AND d2 <= 5.991", "gt", "det")
def j4(gt, det):
    own = gt.withColumn("sxx", F.lit(0.01)).withColumn("sxy", F.lit(0.005)).withColumn("syy", F.lit(0.02))
    return joins.gated_by_covariance(own, det, 5.991, 0.45, 0.01).select(*KEYS, "track_id", "det_id", F.round("d2", 6).alias("d2"))


@query("j5_strict_poses", "SELECT seq_name, frame_idx, count(*) AS n, round(min(x), 6) AS x FROM gt JOIN poses USING (seq_name, frame_idx) GROUP BY ALL", "gt", "poses")
def j5(gt, poses):
    return joins.with_pose(gt, poses).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("x"), 6).alias("x"))


@query("j7_sequence_pairs", "SELECT seq_name, count(*) AS n, true AS labelled FROM det WHERE seq_name IN (SELECT seq_name FROM gt WHERE track_id = 42) GROUP BY 1 UNION ALL SELECT DISTINCT seq_name, 0, false FROM det WHERE seq_name NOT IN (SELECT seq_name FROM gt WHERE track_id = 42)", "det", "gt")
def j7(det, gt):
    rows, missing = joins.sequence_pairs(det, gt.filter("track_id = 42"))
    return rows.groupBy("seq_name").agg(F.count(F.lit(1)).alias("n")).withColumn("labelled", F.lit(True)).unionByName(missing.select("seq_name", F.lit(0).cast("long").alias("n"), F.lit(False).alias("labelled")))


@query("j10_aligned_to_labels", "SELECT f.seq_name, f.frame_idx, count(d.det_id) AS n FROM (SELECT DISTINCT seq_name, frame_idx FROM gt WHERE track_id = 20) f LEFT JOIN (SELECT * FROM det WHERE frame_idx % 3 <> 0) d ON f.seq_name = d.seq_name AND f.frame_idx = d.frame_idx GROUP BY ALL", "gt", "det")
def j10(gt, det):
    frames = gt.filter("track_id = 20").select(*KEYS).distinct()
    return joins.aligned(frames, det.filter("frame_idx % 3 <> 0")).groupBy(*KEYS).agg(F.count("det_id").alias("n"))


DEGREES = f"SELECT *, count(*) OVER (PARTITION BY seq_name, frame_idx, track_id) AS a, count(*) OVER (PARTITION BY seq_name, frame_idx, det_id) AS b FROM ({NEAR})"


@query("j12_uncontested", f"SELECT seq_name, frame_idx, track_id, det_id FROM ({DEGREES}) WHERE a = 1 AND b = 1", "gt", "det")
def j12_uncontested(gt, det):
    """What the assignment gives to boxes that have one candidate only, which has no other."""
    edges = matching.edges_of(matching.candidates(gt, det, 0.45)).select(*KEYS, "track_id", "det_id", "cost")
    edges = matching.by_frame(edges)
    for c in ("track_id", "det_id"):
        edges = edges.withColumn(f"of_{c}", F.count(F.lit(1)).over(W.partitionBy(*KEYS, c)))
    return matching.assign(edges, "optimal", "of_track_id", "of_det_id").filter("of_track_id = 1 and of_det_id = 1").select(*KEYS, "track_id", "det_id")


@query("j12_weighed_assignment", None, "gt", "det")
def j12_weighed(gt, det):
    """One to one by overlap and distance."""
    return matching.assign(matching.edges_of(matching.candidates(gt, det, 0.45, top_k=8, min_iou=0.0), 0.5))


@query("j8_far_from_labels", f"SELECT seq_name, frame_idx, det_id FROM det EXCEPT SELECT seq_name, frame_idx, det_id FROM ({NEAR})", "gt", "det")
def j8_far(gt, det):
    """Detections that no label is near to."""
    return matching.unmatched(det, matching.candidates(gt, det, 0.45).select(*KEYS, "det_id").distinct()).select(*KEYS, "det_id")


@query("j13_variants_by_sequence", "SELECT seq_name, v.variant, count(*) AS n FROM frames, (VALUES ('clean'), ('x2')) v(variant) GROUP BY ALL", "frames")
def j13(frames):
    return joins.with_variants(frames, ["clean", "x2"]).groupBy("seq_name", "variant").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ ordered, aggregated

@query("w5_epochs_in_seconds", "SELECT seq_name, frame_idx, track_id, gap, sum(CASE WHEN gap / 15.0 > CASE WHEN p THEN 0.5 ELSE 0.2 END THEN 1 ELSE 0 END) OVER (PARTITION BY seq_name, track_id ORDER BY frame_idx)::bigint AS epoch FROM (SELECT *, coalesce(frame_idx - lag(frame_idx) OVER t, 0) AS gap, lag(track_id % 2 = 0) OVER t AS p FROM gt WINDOW t AS (PARTITION BY seq_name, track_id ORDER BY frame_idx))", "gt")
def w5_seconds(gt):
    rows = gt.withColumn("is_static", C("track_id") % 2 == 0)
    return tracks.epochs(rows, 0.2, fps=15.0, static="is_static", static_gap=0.5).select(*KEYS, "track_id", "gap", "epoch")


@query("w11_downsampled_points", f"SELECT seq_name, frame_idx, least(count(*), 10) AS n FROM ({POINTS}) GROUP BY ALL", "det")
def w11(det):
    return formats.downsampled(points(det), 10, 3).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


@query("a6_quantile_calibrator", "SELECT bin, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, round((count(*) FILTER (kind = 'tp') + 1.0) / (count(*) + 2.0), 6) AS precision FROM (SELECT len(list_filter(e, lambda x: x <= score)) AS bin, kind FROM (SELECT CASE WHEN det_id % 2 = 0 THEN 'tp' ELSE 'fp' END AS kind, score FROM det), (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM det)) GROUP BY 1", "det")
def a6_quantile(det):
    scores = det.select(F.when(C("det_id") % 2 == 0, "tp").otherwise("fp").alias("kind"), "score")
    return summaries.quantile_calibrator(scores).select(C("bin").cast("long").alias("bin"), "tp", "fp", F.round("precision", 6).alias("precision"))


@query("a11_status_counts", f"SELECT split, status, count(*) AS n FROM ({STATUS}) GROUP BY ALL", "frame_stats")
def a11(stats):
    n = stats.groupBy("seq_name").agg(F.count(F.lit(1)).alias("n"))
    status = F.when(C("n") % 3 == 0, "error").when(C("n") % 3 == 1, "skipped").otherwise("ok")
    return summaries.status_counts(n.select(F.when(C("seq_name") < "seq_5", "a").otherwise("b").alias("split"), status.alias("status")), "split")


@query("t9_frame_clocks", "SELECT seq_name, frame_idx, round((row_number() OVER (PARTITION BY seq_name ORDER BY frame_idx) - 1) / 15.0, 6) AS seconds, CAST(round_even((row_number() OVER (PARTITION BY seq_name ORDER BY frame_idx) - 1) / 15.0, 0) AS bigint) AS whole FROM frames", "frames")
def t9(frames):
    return tracks.frame_clock(frames, 15.0).select(*KEYS, F.round("seconds", 6).alias("seconds"), "whole")
