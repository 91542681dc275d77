"""An order over whole tables, by ranges instead of one window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators.quantiles import same
from trackloom.plans.storage import written
from trackloom.sources.formats import frame_order


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], into: str, parts: int | None = None) -> DataFrame:
    """rows with their number from 0 on within each group, in order, nulls first; rows equal in `order` have numbers of their own, in no order that is promised.

    Rows are dealt to ranges of (by, order) and sorted there; what a range holds of each group shifts the numbers of those after it. A group of any size is the work of many tasks,
    and without `by` the whole table is.
    """
    by, spark = list(by), rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    ranges = written(ranges).withColumn("_part", F.shiftright("_at", 33))
    starts = ranges.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_k"))
    # as many rows as ranges, and one more for each group that begins inside of one
    before = F.sum("_k").over(W.partitionBy(*by).orderBy("_part")) - F.col("_k")
    starts = starts.select(*(F.col(c).alias(f"_s_{c}") for c in by), F.col("_part").alias("_s_part"), (before - F.col("_first")).alias("_shift"))
    joined = ranges.join(starts, same(ranges, starts, by, "_s_") & (F.col("_part") == F.col("_s_part")))
    return joined.select(*(c for c in rows.columns if c != into), (F.col("_at") + F.col("_shift")).alias(into))


def ordered_frames(frames: DataFrame, parts: int | None = None) -> DataFrame:
    """frames(seq_name, frame_id, ...) with `frame_ord`, the place of each frame in its sequence: by all digits of its id as a number, ids without digits last, then by the id. Frames
    given twice have places of their own."""
    keyed = frames.withColumn("_key", frame_order(F.col("frame_id")))
    return numbered(keyed, ["seq_name"], ["_key", "frame_id"], "frame_ord", parts).drop("_key")
