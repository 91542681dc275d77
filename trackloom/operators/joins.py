"""Joins of frames, poses, labels and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import motion
from trackloom.functions.geometry import mahalanobis2, rotated, yaw_of_quaternion
from trackloom.operators.matching import KEY, candidates

_Q = ("qx", "qy", "qz", "qw")


def with_pose(boxes: DataFrame, poses: DataFrame, missing: str = "error") -> DataFrame:
    """boxes with the pose of their frame; without one: an 'error' when the row is read, 'drop', or 'pass' on with nulls."""
    if missing not in ("error", "drop", "pass"):
        raise ValueError(f"unknown policy {missing!r}")
    both = boxes.join(poses.withColumn("posed", F.lit(True)), KEY, "inner" if missing == "drop" else "left")
    if missing == "error":
        name = F.concat_ws(" ", F.lit("no pose for"), F.col("seq_name"), F.col("frame_idx").cast("string"))
        both = both.filter(F.when(F.col("posed").isNull(), F.raise_error(name).cast("boolean")).otherwise(True))
    return both.drop("posed")


def to_global(boxes: DataFrame, poses: DataFrame, missing: str = "error", inverse: bool = False) -> DataFrame:
    """boxes moved by the pose of their frame, or back from there; with missing='pass', boxes without a pose stay. The yaw loses the
    pose's yaw, and is not wrapped."""
    both = with_pose(boxes, poses, missing)
    q = [F.col(c) for c in _Q]
    sign = -1 if inverse else 1
    turn = [-c for c in q[:3]] + [q[3]] if inverse else q
    at = [F.col(f"c{a}") - F.col(a) if inverse else F.col(f"c{a}") for a in "xyz"]
    turned = rotated(*turn, *at)
    out = {f"c{a}": t if inverse else t + F.col(a) for a, t in zip("xyz", turned)} | {"rot_z": F.col("rot_z") - sign * yaw_of_quaternion(*q)}
    kept = [c for c in boxes.columns if c not in out]
    return both.select(*kept, *(F.when(F.col("qw").isNull(), F.col(c)).otherwise(v).alias(c) for c, v in out.items()))


def frame_counts(frames: DataFrame, **tables: DataFrame) -> DataFrame:
    """Rows of each table in each frame, 0 where there is none."""
    out = frames.select(*KEY)
    for name, t in tables.items():
        out = out.join(t.groupBy(*KEY).agg(F.count(F.lit(1)).alias(name)), KEY, "left")
    return out.select(*KEY, *(F.coalesce(n, F.lit(0)).alias(n) for n in tables))


def sequence_pairs(dets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detections of sequences that have labels, and the names of those that have none."""
    known = labels.select("seq_name").distinct()
    return dets.join(known, "seq_name", "left_semi"), dets.select("seq_name").distinct().join(known, "seq_name", "left_anti")


def aligned(frames: DataFrame, rows: DataFrame) -> DataFrame:
    """All frames with their rows, one without any for a frame that has none; rows of other frames go."""
    return frames.select(*KEY).join(rows, KEY, "left")


def gated_by_prediction(tracks: DataFrame, dets: DataFrame, radius: float, top_k: int | None = None, z_gate: float | None = None) -> DataFrame:
    """Candidates around where tracks(..., box, true_cx, true_cy) are believed to be, with `dist` measured to where they are."""
    pairs = candidates(tracks, dets, radius, top_k, z_gate)
    pairs = pairs.join(tracks.select(*KEY, "track_id", "true_cx", "true_cy"), [*KEY, "track_id"])
    return pairs.withColumn("dist", motion.norm(F.col("true_cx") - F.col("b_cx"), F.col("true_cy") - F.col("b_cy")))


def gated_by_covariance(tracks: DataFrame, dets: DataFrame, gate: float, most: float, noise: float, top_k: int | None = None) -> DataFrame:
    """Candidates within a squared Mahalanobis distance `gate` of tracks(..., box, sxx, sxy, syy), and at most `most` metres away.

    noise: variance of a measurement, added to the tracks' own. Cells of the join are as wide as `most`, and no pair that the
    track's covariance allows is left out within that.
    """
    own = tracks.select(*KEY, "track_id", (F.col("sxx") + noise).alias("sxx"), "sxy", (F.col("syy") + noise).alias("syy"), motion.safe_radius(F.lit(gate), F.col("sxx") + noise, F.col("sxy"), F.col("syy") + noise).alias("reach"))
    pairs = candidates(tracks, dets, most, None).join(own, [*KEY, "track_id"]).filter("dist2 <= reach * reach")
    pairs = pairs.withColumn("d2", mahalanobis2(F.col("b_cx") - F.col("a_cx"), F.col("b_cy") - F.col("a_cy"), F.col("sxx"), F.col("sxy"), F.col("syy"))).filter(F.col("d2") <= gate)
    if top_k is not None:
        from pyspark.sql import Window as W

        pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy(*KEY, "track_id").orderBy("d2", "det_id"))).filter(F.col("rank") <= top_k).drop("rank")
    return pairs


def timed(frames: DataFrame, poses: DataFrame) -> DataFrame:
    """frames with `seconds`, the time of their pose; null for a frame without a pose, and frames given twice stay twice."""
    clock = poses.select(*KEY, (F.col("timestamp_ns") * 1e-9).alias("seconds"))
    return frames.drop("seconds").join(clock, KEY, "left")


def with_variants(rows: DataFrame, names: list[str]) -> DataFrame:
    """Each row once for each variant, by an array of their names instead of a cross join; no names, no rows."""
    return rows.withColumn("variant", F.explode(F.lit(names) if names else F.array().cast("array<string>")))
