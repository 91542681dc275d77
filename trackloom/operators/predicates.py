"""Filters, checks and set operations on tables of boxes, frames and sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MEMBERS = ("cx", "cy", "cz", "l", "w", "h", "rot_z")


def of_class(rows: DataFrame, name: str, exact: bool = False) -> DataFrame:
    """Rows of a class, by its name in any case unless exact. A row without a label is of none."""
    label, name = (F.col("label"), F.lit(name)) if exact else (F.lower("label"), F.lower(F.lit(name)))
    return rows.filter(label == name)


def scored_at_least(rows: DataFrame, least: float, missing: str = "drop") -> DataFrame:
    """Rows with that score; those without one are dropped, kept, or count as 1 ('one')."""
    if missing not in ("drop", "keep", "one"):
        raise ValueError(f"unknown policy {missing!r}")
    score = F.coalesce("score", F.lit(1.0)) if missing == "one" else F.col("score")
    ok = score >= least
    return rows.filter(ok | score.isNull() if missing == "keep" else ok)


def is_finite(rows: DataFrame) -> Column:
    """Whether all members of a box are numbers."""
    bad = F.lit(False)
    for m in MEMBERS:
        c = F.col(m).cast("double")
        bad = bad | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return ~bad


def finite(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose box is made of numbers, and the others."""
    return rows.filter(is_finite(rows)), rows.filter(~is_finite(rows))


def repeated_ids(rows: DataFrame, *by: str) -> DataFrame:
    """Ids that more than one row of a frame has, with their number."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def checked(rows: DataFrame, key: Sequence[str] = ("seq_name", "frame_idx", "track_id")) -> DataFrame:
    """The same rows; a box that isn't made of numbers, or an id that a frame has twice, is an error when they are read."""
    n = F.count(F.lit(1)).over(W.partitionBy(*key))
    said = F.concat_ws(" ", *(F.col(c).cast("string") for c in key))
    wrong = F.when(~is_finite(rows), F.concat(F.lit("not a box: "), said)).when(n > 1, F.concat(F.lit("id given twice: "), said))
    return rows.withColumn("wrong", wrong).filter(F.when(F.col("wrong").isNotNull(), F.raise_error("wrong").cast("boolean")).otherwise(True)).drop("wrong")


def chosen(rows: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None, on: str = "seq_name") -> DataFrame:
    """Rows of the names to include, if any are given, without those to exclude."""
    if include is not None:
        rows = rows.join(include.select(on).distinct(), on, "left_semi")
    return rows if exclude is None else rows.join(exclude.select(on).distinct(), on, "left_anti")


def first_sequences(names: DataFrame, n: int | None = None) -> DataFrame:
    """Sequence names in order, the first n of them if n is given."""
    out = names.select("seq_name").distinct().orderBy("seq_name")
    return out if n is None else out.limit(n)


def run_name(base: Column, variant: Column, is_global: bool) -> Column:
    """base__variant__global, without what doesn't apply."""
    return F.concat_ws("__", base, F.when(variant != "", variant), F.lit("global" if is_global else None).cast("string"))


def between_heights(points: DataFrame, low: float, high: float) -> DataFrame:
    return points.filter(F.col("z").between(low, high))


def all_frames(*tables: DataFrame) -> DataFrame:
    """Frames that any of the tables has, once each."""
    out = tables[0].select("seq_name", "frame_idx")
    for t in tables[1:]:
        out = out.union(t.select("seq_name", "frame_idx"))
    return out.distinct()


def pooled_scores(true: DataFrame, false: DataFrame) -> DataFrame:
    """(kind, score) of true and false detections together."""
    return true.select(F.lit("tp").alias("kind"), "score").unionByName(false.select(F.lit("fp").alias("kind"), "score"))


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sequences that both tables have, once each; a null name is a name like any other."""
    return a.select("seq_name").intersect(b.select("seq_name"))


def in_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sequences of the first table that the second has not, once each."""
    return a.select("seq_name").subtract(b.select("seq_name"))
