"""Ordered operators on tracks and frames: gaps and epochs, displacement, smoothing, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators.scans import affine_scan


def by_track():
    return W.partitionBy("seq_name", "track_id").orderBy("frame_idx")


def epochs(rows: DataFrame, max_gap: float, stride: int = 100_000, fps: float = 1.0, static: str | None = None, static_gap: float | None = None) -> DataFrame:
    """gap: frames since the track was last seen; epoch: rises after a gap over max_gap; epoch_id: a new id for each.

    Limits are in frames, or in seconds if fps is given. static names a column that says whether a track stood still: then static_gap
    is its limit, by its row before the gap.
    """
    gap = F.col("frame_idx") - F.lag("frame_idx").over(by_track())
    out = rows.withColumn("gap", F.coalesce(gap, F.lit(0)))
    limit = F.lit(float(max_gap))
    if static is not None:
        limit = F.when(F.lag(static).over(by_track()), float(static_gap)).otherwise(limit)
    out = out.withColumn("late", F.when(F.col("gap") / fps > limit, 1).otherwise(0))
    out = out.withColumn("epoch", F.sum("late").over(by_track())).drop("late")
    return out.withColumn("epoch_id", F.col("track_id") + F.col("epoch") * stride)


def displacement(rows: DataFrame) -> DataFrame:
    """dx, dy since the frame just before; null if the track was not in it."""
    near = F.lag("frame_idx").over(by_track()) == F.col("frame_idx") - 1
    return rows.withColumn("dx", F.when(near, F.col("cx") - F.lag("cx").over(by_track()))).withColumn("dy", F.when(near, F.col("cy") - F.lag("cy").over(by_track())))


def static_flag(rows: DataFrame, window: int = 15, radius: float = 0.3, epoch: str | None = None) -> DataFrame:
    """Centre and largest radius of the last `window` positions; static if enough of them lie within `radius`. Radii are compared by their first five decimals, so that
    rounding errors of the centre don't decide about places exactly `radius` away. epoch names a column that positions are forgotten by when it changes."""
    last = W.partitionBy("seq_name", "track_id", *([epoch] if epoch else [])).orderBy("frame_idx").rowsBetween(1 - window, 0)
    rows = rows.withColumn("points", F.collect_list(F.struct("cx", "cy")).over(last))
    rows = rows.withColumn("mx", F.avg("cx").over(last)).withColumn("my", F.avg("cy").over(last))
    far = F.array_max(F.transform("points", lambda p: F.sqrt((p["cx"] - F.col("mx")) ** 2 + (p["cy"] - F.col("my")) ** 2)))
    rows = rows.withColumn("n", F.size("points")).withColumn("max_radius", far).drop("points")
    return rows.withColumn("is_static", (F.col("n") >= max(3, window // 2)) & (F.round("max_radius", 5) <= radius))


def smoothed_speed(rows: DataFrame, alpha: float, fps: float) -> DataFrame:
    """The exponential mean of each track's speed at its last row, in metres a second; gaps count with their length. A track of one row has none."""
    rows = rows.withColumn("before", F.lag(F.struct("frame_idx", "cx", "cy")).over(by_track())).filter("before is not null")
    speed = F.sqrt((F.col("cx") - F.col("before.cx")) ** 2 + (F.col("cy") - F.col("before.cy")) ** 2) * fps / (F.col("frame_idx") - F.col("before.frame_idx"))
    states = affine_scan(rows, F.lit(1 - alpha), alpha * speed)
    return states.groupBy("seq_name", "track_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max_by("state", "frame_idx").alias("speed"))


def with_missed(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """rows with the frames of their sequence in which the track was missed, as numbers: `missed` since its row before, `after` between the row and the sequence's
    last frame. Frames without the track are no rows. Rows whose frame isn't in frames(seq_name, frame_idx), which names each frame once, go."""
    whole = W.partitionBy("seq_name")
    places = frames.select("seq_name", "frame_idx", F.row_number().over(whole.orderBy("frame_idx")).alias("place"), F.count(F.lit(1)).over(whole).alias("of"))
    rows = rows.join(places, ["seq_name", "frame_idx"])
    missed = F.coalesce(F.col("place") - F.lag("place").over(by_track()) - 1, F.lit(0))
    return rows.withColumn("missed", missed).withColumn("after", F.col("of") - F.col("place")).drop("place", "of")


def evidence_of(rows: DataFrame, score: str, rise: float, decay: float, confirm: float, least_hits: int) -> DataFrame:
    """Evidence by track: a hit takes it towards its score, a miss (null) towards 0; hits, and whether it was ever confirmed: with so
    many hits and so much evidence at once. Evidence runs along the track in blocks of frames. Where rows have with_missed()'s columns, those misses count, too."""
    hit = F.col(score).isNotNull()
    gaps = "missed" in rows.columns
    lost = lambda n: F.pow(F.lit(1 - decay), F.col(n)) if gaps else F.lit(1.0)
    rows = rows.withColumn("hits", F.sum(hit.cast("int")).over(by_track().rowsBetween(W.unboundedPreceding, 0)))
    states = affine_scan(rows, lost("missed") * F.when(hit, 1 - rise).otherwise(1 - decay), F.when(hit, rise * F.col(score)).otherwise(0.0), into="evidence")
    ok = F.max(hit & (F.col("hits") >= least_hits) & (F.col("evidence") >= confirm))
    last = F.max_by(F.col("evidence") * lost("after"), "frame_idx")
    return states.groupBy("seq_name", "track_id").agg(F.max("hits").cast("int").alias("hits"), last.alias("evidence"), ok.alias("confirmed"))


def fresh_ids(boxes: DataFrame) -> DataFrame:
    """A new id for every detection, in frame order within its sequence."""
    return boxes.withColumn("new_id", F.row_number().over(W.partitionBy("seq_name").orderBy("frame_idx", "det_id")))


def contiguous_frames(frames: DataFrame) -> DataFrame:
    return frames.withColumn("out_idx", F.dense_rank().over(W.partitionBy("seq_name").orderBy("frame_idx")) - 1)


def warm_up(frames: DataFrame, n: int) -> DataFrame:
    return frames.withColumn("is_warmup", F.row_number().over(W.partitionBy("seq_name").orderBy("frame_idx")) <= n)


def frame_clock(frames: DataFrame, fps: float) -> DataFrame:
    """Seconds of each frame since its sequence's first, by its place in order, and the whole second nearest to it, an even one of two (`whole`)."""
    out = frames.withColumn("seconds", (F.row_number().over(W.partitionBy("seq_name").orderBy("frame_idx")) - 1) / fps)
    return out.withColumn("whole", F.bround("seconds", 0).cast("long"))


def by_label(boxes: DataFrame) -> DataFrame:
    """(seq_name, track_id, rows): each track's boxes in order of frames."""
    box = F.struct("frame_idx", "cx", "cy", "cz", "l", "w", "h", "rot_z")
    return boxes.groupBy("seq_name", "track_id").agg(F.array_sort(F.collect_list(box)).alias("rows"))
