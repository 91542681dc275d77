"""Run statistics, score distributions and calibrated precision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators.quantiles import at_ranks, quantiles, with_quantiles
from trackloom.plans.storage import written


def run_stats(frames: DataFrame) -> DataFrame:
    """By sequence: frames, total seconds, frames a second and step times without warm-up; 0 instead of null."""
    step = F.when(~F.col("is_warmup"), F.col("step_ms"))
    out = frames.groupBy("seq_name").agg(F.count(F.lit(1)).alias("num_frames"), F.coalesce(F.sum(step) / 1000, F.lit(0.0)).alias("total_time_s"), F.count(step).alias("timed"), F.coalesce(F.avg(step), F.lit(0.0)).alias("mean_step_ms"))
    wanted = {"p50_step_ms": 0.5, "p90_step_ms": 0.9, "p99_step_ms": 0.99}
    out = with_quantiles(out, frames.select("seq_name", step.alias("step_ms")), "step_ms", ["seq_name"], wanted).fillna(0.0, list(wanted))
    return out.withColumn("fps", F.when(F.col("total_time_s") > 0, F.col("timed") / F.col("total_time_s")).otherwise(0.0)).drop("timed")


def split_stats(runs: DataFrame, *by: str) -> DataFrame:
    """By split: fps over sequences and weighted by frames, means of step times."""
    weighted = F.sum("num_frames") / (F.sum(F.col("num_frames") * F.col("mean_step_ms")) / 1000)
    out = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("num_sequences"), F.avg("fps").alias("fps_mean"), F.min("fps").alias("fps_min"), F.max("fps").alias("fps_max"), weighted.alias("fps_weighted"), F.avg("mean_step_ms").alias("step_mean"), F.avg("p99_step_ms").alias("p99_mean"))
    out = with_quantiles(out, runs, "fps", by, {"fps_median": 0.5})
    return with_quantiles(out, runs, "mean_step_ms", by, {"step_p90": 0.9})


def timing(frames: DataFrame) -> DataFrame:
    """By sequence: total, mean, fps and the nearest-rank 95th percentile, its rank rounded half to even."""
    totals = frames.groupBy("seq_name").agg(F.count(F.lit(1)).alias("n"), F.sum("step_ms").alias("total_ms"))
    found = at_ranks(frames, "step_ms", ["seq_name"], {"p95_ms": F.bround(0.95 * (F.col("_n") - 1), 0)}).drop("_n")
    return totals.join(found, "seq_name").select("seq_name", "n", "total_ms", (F.col("total_ms") / F.col("n")).alias("mean_ms"), (F.col("n") * 1000 / F.col("total_ms")).alias("fps"), "p95_ms")


def numeric_summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    return with_quantiles(out, rows, value, by, {"p05": 0.05, "p50": 0.5, "p95": 0.95})


def tp_fp_counts(scores: DataFrame) -> DataFrame:
    """By split and, with split null, pooled: true and false positives."""
    return scores.rollup("split").agg(F.count_if(F.col("kind") == "tp").alias("tp"), F.count_if(F.col("kind") == "fp").alias("fp"))


def calibrator(scores: DataFrame, bins: int = 20, laplace: float = 1.0) -> DataFrame:
    """scores(kind, score in [0, 1]): uniform bins with smoothed precision; an empty bin has the base rate."""
    at = F.least(F.floor(F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    counts = scores.groupBy(at.alias("bin")).agg(F.count_if(F.col("kind") == "tp").alias("tp"), F.count_if(F.col("kind") == "fp").alias("fp"))
    return calibrated(counts, bins, laplace)


def calibrated(counts: DataFrame, bins: int, laplace: float) -> DataFrame:
    """counts(bin, tp, fp) with all bins and their precision; null if nothing was counted at all."""
    every = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    rows = every.join(counts, "bin", "left").select("bin", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fp", F.lit(0)).alias("fp"))
    all_ = W.partitionBy()  # as many rows as bins
    base = F.try_divide(F.sum("tp").over(all_), F.sum(F.col("tp") + F.col("fp")).over(all_))
    n = F.col("tp") + F.col("fp")
    return rows.withColumn("precision", F.when(n == 0, base).otherwise((F.col("tp") + laplace) / (n + 2 * laplace)))


def isotonic(rows: DataFrame) -> DataFrame:
    """rows(bin, value, weight), a few dozen: the closest non-decreasing values, as the largest over starts up to a bin of the
    least weighted mean over ends from it on."""
    sums = rows.withColumn("sw", F.sum("weight").over(W.orderBy("bin"))).withColumn("sv", F.sum(F.col("weight") * F.col("value")).over(W.orderBy("bin")))
    a = sums.select(F.col("bin").alias("first"), (F.col("sw") - F.col("weight")).alias("w0"), (F.col("sv") - F.col("weight") * F.col("value")).alias("v0"))
    b = sums.select(F.col("bin").alias("last"), F.col("sw").alias("w1"), F.col("sv").alias("v1"))
    means = a.join(b, F.col("first") <= F.col("last")).withColumn("mean", (F.col("v1") - F.col("v0")) / (F.col("w1") - F.col("w0")))
    low = means.join(rows.select("bin"), (F.col("first") <= F.col("bin")) & (F.col("bin") <= F.col("last"))).groupBy("bin", "first").agg(F.min("mean").alias("m"))
    fit = low.groupBy("bin").agg(F.max("m").alias("fitted"))
    return rows.join(fit, "bin")


def quantile_calibrator(scores: DataFrame, bins: int = 10, laplace: float = 1.0) -> DataFrame:
    """As calibrator(), with bins of about as many scores each: their edges are quantiles of all scores."""
    wanted = {f"q{i}": i / bins for i in range(1, bins)}
    edges = (quantiles(scores, "score", [], wanted).first() or []) if wanted else []  # one row
    at = sum((F.when(F.col("score") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    rows = scores.select(at.alias("bin"), "kind")
    counts = rows.groupBy("bin").agg(F.count_if(F.col("kind") == "tp").alias("tp"), F.count_if(F.col("kind") == "fp").alias("fp"))
    return counts.withColumn("precision", (F.col("tp") + laplace) / (F.col("tp") + F.col("fp") + 2 * laplace))


def score_sample(scores: DataFrame, *kinds: str, most: int = 2000) -> dict[str, list[float]]:
    """At most so many scores of each kind, chosen by a hash of their values and numbers, for drawing from. scores are read once, for all kinds."""
    out, every = {}, written(scores.filter(F.col("kind").isin(*kinds)).groupBy("kind", "score").agg(F.count(F.lit(1)).alias("k")))
    for kind in kinds:
        counts = every.filter(F.col("kind") == kind).select("score", "k")
        total = counts.agg(F.sum("k")).first()[0] or 0
        share = max(1.0, total / most)
        rows = counts.select("score", F.ceil(F.col("k") / share).cast("int").alias("k")).orderBy(F.xxhash64("score")).limit(most).collect()
        out[kind] = sorted(s for s, k in rows for _ in range(k))
    return out


def extents(rows: DataFrame, axes: dict[str, str], margin: float, padding: float, *by: str) -> DataFrame:
    """Ends of each axis with a margin; an axis without any extent gets padding, too."""
    agg = rows.groupBy(*by).agg(*(f(c).alias(f"{a}{e}") for a, c in axes.items() for f, e in ((F.min, 0), (F.max, 1))))
    room = lambda a: margin + F.when(F.col(f"{a}1") - F.col(f"{a}0") < 1e-6, padding).otherwise(0.0)
    return agg.select(*by, *((F.col(f"{a}{e}") + (2 * e - 1) * room(a)).alias(f"{a}{e}") for a in axes for e in (0, 1)))


def id_ranks(rows: DataFrame) -> DataFrame:
    """(seq_name, track_id, shade): the ids of each sequence, evenly spaced over [0, 1] in their order."""
    ids = rows.select("seq_name", "track_id").distinct()
    by = W.partitionBy("seq_name")
    return ids.select("seq_name", "track_id", ((F.dense_rank().over(by.orderBy("track_id")) - 1) / F.greatest(F.count(F.lit(1)).over(by) - 1, F.lit(1))).alias("shade"))


def status_counts(status: DataFrame, *by: str) -> DataFrame:
    """status(by..., status) of a run's sequences, counted: (by..., status, n)."""
    return status.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))
