"""Score pools, variant manifests, frame statistics, run summaries, and what is left to do of a run."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.batches import starts, whole_groups
from trackloom.sources.formats import DETECTION_KEYS, LABEL_KEYS, read_boxes, track_lines, true_text

#: Where files of scores hold those of true and false detections, tried in this order.
POOL_PATHS = (("$.tp_scores", "$.fp_scores"), ("$.scores.tp", "$.scores.fp"), ("$.tp", "$.fp"))
#: Columns of frame statistics and of run summaries, in order.
FRAME_STATS = ("frame_id string", "frame_idx int", "timestamp_s double", "step_ms double", "fps_inst double", "num_det_in int", "num_tracks_out int", "num_gt int", "is_warmup boolean")
RUN_SUMMARY = ("seq_name", "status", "num_frames", "fps", "mean_step_ms", "p50_step_ms", "p90_step_ms", "p99_step_ms")


def score_pools(docs: DataFrame) -> DataFrame:
    """docs(value), JSON texts of one of three shapes, as (kind, score): finite scores, clipped to [0, 1]."""
    keys = [c for c in docs.columns if c != "value"]

    def of(kind: int) -> Column:
        return F.from_json(F.coalesce(*(F.get_json_object("value", paths[kind]) for paths in POOL_PATHS)), "array<double>")

    both = docs.select(*keys, F.lit("tp").alias("kind"), F.explode(of(0)).alias("score")).unionByName(docs.select(*keys, F.lit("fp").alias("kind"), F.explode(of(1)).alias("score")))
    number = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    return both.filter(number).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))


def pools_json(scores: DataFrame, *by: str) -> DataFrame:
    """(kind, score) as one JSON text for each group; a group's scores are those of one calibration."""
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("score"))))
    return scores.groupBy(*by).agg(of("tp").alias("tp_scores"), of("fp").alias("fp_scores")).select(*by, F.to_json(F.struct("tp_scores", "fp_scores")).alias("value"))


def manifest(variants: DataFrame, seed: int, *by: str) -> DataFrame:
    """variants(name, settings) as one JSON text: {seed, variants: [{name, resolved_cfg}]}, in order of names."""
    entry = F.struct("name", F.col("settings").alias("resolved_cfg"))
    return variants.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("variants")).select(*by, F.to_json(F.struct(F.lit(seed).alias("seed"), "variants")).alias("value"))


def read_spec(spark: SparkSession, path: str) -> dict:
    """A spec of variants from a file of JSON, or of YAML where its library is installed. A spec is a few settings, for the driver."""
    (row,) = spark.read.text(path, wholetext=True).limit(2).collect()
    try:
        return json.loads(row["value"])
    except json.JSONDecodeError:
        import yaml

        return yaml.safe_load(row["value"])


def variant_names(docs: DataFrame) -> DataFrame:
    """The names of the variants that manifests list."""
    keys = [c for c in docs.columns if c != "value"]
    return docs.select(*keys, F.explode(F.from_json(F.get_json_object("value", "$.variants"), "array<struct<name: string>>")).alias("v")).select(*keys, F.col("v.name").alias("variant"))


def sequences_of(files: DataFrame) -> DataFrame:
    """files(file_name) of JSON documents, hidden ones left out, as sequence names: what stands before the ending."""
    shown = files.filter(F.col("file_name").endswith(".json") & ~F.col("file_name").startswith("."))
    return shown.select(F.regexp_extract("file_name", r"^(.*)\.json$", 1).alias("seq_name")).distinct()


def read_pair(spark: SparkSession, detections: str, labels: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Detections, labels, and the frames that either has."""
    dets, gt = read_boxes(spark, detections, DETECTION_KEYS), read_boxes(spark, labels, LABEL_KEYS)
    return dets, gt, dets.select("seq_name", "frame_idx").union(gt.select("seq_name", "frame_idx")).distinct()


def frame_stats_lines(stats: DataFrame) -> DataFrame:
    """(seq_name, frame_idx, value): a CSV line for each frame, with all columns; a missing value is empty."""
    have = set(stats.columns)
    columns = [(F.col(c.split()[0]) if c.split()[0] in have else F.lit(None)).cast(c.split()[1]).alias(c.split()[0]) for c in FRAME_STATS]
    return stats.select("seq_name", "frame_idx", F.to_csv(F.struct(*columns)).alias("value"))


def parse_frame_stats(lines: DataFrame) -> DataFrame:
    """The inverse; what counts as true is written in several ways."""
    schema = ", ".join(c.replace("boolean", "string") for c in FRAME_STATS)
    return lines.select("seq_name", F.from_csv("value", schema).alias("s")).select("seq_name", "s.*").withColumn("is_warmup", true_text(F.col("is_warmup")))


def write_frame_stats(stats: DataFrame, path: str) -> None:
    """One folder of CSV files with a header for each sequence."""
    have = set(stats.columns)
    columns = [(F.col(c.split()[0]) if c.split()[0] in have else F.lit(None)).cast(c.split()[1]).alias(c.split()[0]) for c in FRAME_STATS]
    stats.select("seq_name", *columns).repartition("seq_name").sortWithinPartitions("seq_name", "frame_idx").write.partitionBy("seq_name").option("header", True).mode("overwrite").csv(path)


def run_summary(runs: DataFrame, status: DataFrame, *by: str) -> DataFrame:
    """One row for each split: sequences known, run and failed, and its statistics as JSON."""
    rows = status.join(runs, "seq_name", "left")
    ok = F.col("status") == "ok"
    agg = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_sequences"), F.count_if(ok).alias("num_ok"), F.count_if(F.col("status") == "error").alias("num_error"), F.count_if(F.col("status") == "skipped").alias("num_skipped"),
        F.coalesce(F.sum(F.when(ok, F.col("num_frames"))), F.lit(0)).alias("num_frames"), F.coalesce(F.avg(F.when(ok, F.col("fps"))), F.lit(0.0)).alias("fps_mean"),
    )
    return agg.withColumn("value", F.to_json(F.struct(*by, "num_sequences", "num_ok", "num_error", "num_skipped", "num_frames", "fps_mean")))


def pending(sequences: DataFrame, done: DataFrame) -> DataFrame:
    """Sequences without an output yet."""
    return sequences.join(done.select("seq_name").distinct(), "seq_name", "left_anti")


def with_status(rows: DataFrame, work: Callable[[pd.DataFrame], Mapping[str, object]], columns: Mapping[str, str], by: Sequence[str] = ("seq_name",)) -> DataFrame:
    """work(group) for each group, as one row with `columns`, status and error. A group that fails is a row with its error and nulls; others go on.

    A group is held whole, as it is where the work itself fails or succeeds as a whole; a task takes the groups of a batch one after the other.
    """
    by = list(by)

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, by):
            at, done = starts(pdf, by), []
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(pdf)]):
                try:
                    done.append({**work(pdf.iloc[a:b].reset_index(drop=True)), "status": "ok", "error": None})
                except Exception as e:  # the row says what happened
                    done.append({**dict.fromkeys(columns), "status": "error", "error": f"{type(e).__name__}: {e}"})
            yield pdf.iloc[at][by].reset_index(drop=True).assign(**{c: pd.Series([d[c] for d in done], dtype=object) for c in (*columns, "status", "error")})

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), *(f"{c} {k}" for c, k in columns.items()), "status string", "error string"])
    return rows.repartition(*by).sortWithinPartitions(*by).mapInPandas(groups, schema)


def label_lines(boxes: DataFrame) -> DataFrame:
    """Track lines of labels: the class in lower case, an unknown angle and image box (-1), and no score."""
    lines = track_lines(boxes.withColumn("score", F.lit(None).cast("double")), kind="pedestrian", alpha=-1.0)
    parts = F.split("value", " ")
    value = F.concat_ws(" ", F.concat(F.slice(parts, 1, 6), F.array(*[F.lit("-1")] * 4), F.slice(parts, 11, 7)))
    return lines.withColumn("value", value)
