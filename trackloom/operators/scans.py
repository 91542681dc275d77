"""First-order recurrences along tracks as scans: a step is an affine map, maps compose, and compositions are made for blocks of frames apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Frames of a block.
BLOCK = 256
_TRACK = ("seq_name", "track_id")


def doubled(rows: DataFrame, a: str, b: str, by: Sequence[str], order: str, most: int) -> DataFrame:
    """rows with a, b replaced by the composition of all maps s -> a s + b from the first row of their group through theirs, groups having at most `most`
    rows. Each pass composes every row with the one as far before it as the last pass reached: log2(most) passes over rows sorted once, no sums whose
    terms cancel, and none that grow."""
    window, reach = W.partitionBy(*by).orderBy(order), 1
    while reach < most:
        before = F.lag(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), reach).over(window)
        rows = rows.withColumn("_p", before)
        new_b = F.when(F.col("_p").isNull(), F.col(b)).otherwise(F.col(a) * F.col("_p.b") + F.col(b))
        new_a = F.when(F.col("_p").isNull(), F.col(a)).otherwise(F.col(a) * F.col("_p.a"))
        rows = rows.select(*(c for c in rows.columns if c not in (a, b, "_p")), new_a.alias(a), new_b.alias(b))
        reach *= 2
    return rows


def most_blocks(rows: DataFrame, by: Sequence[str], order: str, block: int) -> int:
    """Blocks of the group that has most, by a count of blocks, not rows."""
    counts = rows.select(*by, F.floor(F.col(order) / block).alias("_block")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("k"))
    return counts.agg(F.max("k")).first()[0] or 0


def affine_scan(rows: DataFrame, a: Column, b: Column, start: float = 0.0, into: str = "state", by: Sequence[str] = _TRACK, order: str = "frame_idx", block: int = BLOCK) -> DataFrame:
    """rows with a column of the state after each of them: s -> a s + b at each row in order, from `start` on.

    A group's rows in one block of `block` frames (order div block) are composed apart from all others, so a long track is the work of many tasks and its rows are never
    gathered. A block's last composition stands for it; those are composed in the same way, and each block begins from the state in which the one before it ends. Rows of one group must
    differ in `order`, which is not null; null a or b make the states from there on null. A group by null keys is a group like any other.
    """
    by = list(by)
    rows = rows.withColumn("_block", F.floor(F.col(order) / block).cast("long")).withColumn("_a", a.cast("double")).withColumn("_b", b.cast("double"))
    inside = doubled(rows, "_a", "_b", [*by, "_block"], order, block)
    last = inside.groupBy(*by, "_block").agg(F.max_by(F.struct("_a", "_b"), order).alias("_end")).select(*by, "_block", "_end._a", "_end._b")
    upto = doubled(last, "_a", "_b", by, "_block", most_blocks(rows, by, order, block))
    window = W.partitionBy(*by).orderBy("_block")
    state = F.col("_a") * F.lit(float(start)) + F.col("_b")
    begins = upto.select(*(F.col(c).alias(f"_s_{c}") for c in by), F.col("_block").alias("_s_block"), F.when(F.row_number().over(window) == 1, F.lit(float(start))).otherwise(F.lag(state).over(window)).alias("_from"))
    same = inside["_block"] == begins["_s_block"]
    for c in by:
        same = same & inside[c].eqNullSafe(begins[f"_s_{c}"])
    kept = [c for c in rows.columns if c not in ("_block", "_a", "_b", into)]
    return inside.join(begins, same).select(*kept, (F.col("_a") * F.col("_from") + F.col("_b")).alias(into))


def running_count(rows: DataFrame, what: Column, into: str, by: Sequence[str] = _TRACK, order: str = "frame_idx", block: int = BLOCK) -> DataFrame:
    """rows with the number of rows up to theirs for which `what` holds, by blocks as in affine_scan()."""
    by = list(by)
    rows = rows.withColumn("_block", F.floor(F.col(order) / block).cast("long")).withColumn("_one", F.when(what, 1).otherwise(0))
    totals = rows.groupBy(*by, "_block").agg(F.sum("_one").alias("_total"))
    window = W.partitionBy(*by).orderBy("_block")
    before = totals.select(*(F.col(c).alias(f"_s_{c}") for c in by), F.col("_block").alias("_s_block"), (F.sum("_total").over(window) - F.col("_total")).alias("_before"))
    inside = rows.withColumn("_inside", F.sum("_one").over(W.partitionBy(*by, "_block").orderBy(order)))
    same = inside["_block"] == before["_s_block"]
    for c in by:
        same = same & inside[c].eqNullSafe(before[f"_s_{c}"])
    kept = [c for c in rows.columns if c not in ("_block", "_one", into)]
    return inside.join(before, same).select(*kept, (F.col("_before") + F.col("_inside")).alias(into))
