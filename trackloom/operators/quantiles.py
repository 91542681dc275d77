"""Exact quantiles of groups of any size, from counts by value instead of gathered values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that the values of a group are parted in, of equal width.
RANGES = 4096


def same(a: DataFrame, b: DataFrame, by: Sequence[str], prefix: str) -> Column:
    """Equal keys, nulls too; b has them with a prefix."""
    out = F.lit(True)
    for c in by:
        out = out & a[c].eqNullSafe(b[f"{prefix}{c}"])
    return out


def at_ranks(rows: DataFrame, value: str, by: Sequence[str], ranks: Mapping[str, Column]) -> DataFrame:
    """(by..., _n, name...): of each group the number of its values and those that stand at the given ranks, from 0 on; a rank is an expression of _n. Null values
    count as none; a group without values has no row, but without `by` there always is one, of nulls then.

    Values are counted first, before rows travel. A group's range from least to largest value is parted in RANGES equal ones, whose sizes say in which of them a
    rank falls; only the distinct values of those are ordered. So the ordering of a group is the work of as many tasks as it has ranks, and its
    other values are never sorted. NaN is larger than all numbers, as Spark has it.
    """
    by = list(by)
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    usual = F.when(~F.isnan("_v") & (F.abs("_v") < float("inf")), F.col("_v"))
    ends = counts.groupBy(*by).agg(F.min(usual).alias("_low"), F.max(usual).alias("_high"), F.sum("_k").alias("_n"))
    ends = ends.select(*(F.col(c).alias(f"_e_{c}") for c in by), "_low", "_high", "_n")
    # of values as far apart as doubles can be, the halves are
    share = (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
    part = F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).cast("int")
    part = F.when(F.isnan("_v") | (F.col("_v") == float("inf")), RANGES).when(F.col("_v") == float("-inf"), -1).when(F.col("_high") > F.col("_low"), part).otherwise(0)
    placed = counts.join(ends, same(counts, ends, by, "_e_")).select(*by, "_v", "_k", part.alias("_part"))
    sizes = placed.groupBy(*by, "_part").agg(F.sum("_k").alias("_size"))
    sizes = sizes.withColumn("_before", F.sum("_size").over(W.partitionBy(*by).orderBy("_part")) - F.col("_size"))
    named = F.array(*(F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, r in ranks.items()))
    wanted = ends.select(*(f"_e_{c}" for c in by), "_n", F.explode(named).alias("_w"))
    hits = sizes.join(wanted, same(sizes, wanted, by, "_e_") & (F.col("_before") <= F.col("_w.rank")) & (F.col("_w.rank") < F.col("_before") + F.col("_size")))
    hits = hits.groupBy(*(F.col(c).alias(f"_h_{c}") for c in by), F.col("_part").alias("_h_part")).agg(F.first("_n").alias("_n"), F.first("_before").alias("_before"), F.collect_list("_w").alias("_w"))
    inside = placed.join(hits, same(placed, hits, by, "_h_") & (F.col("_part") == F.col("_h_part")))
    upto = F.col("_before") + F.sum("_k").over(W.partitionBy(*by, "_part").orderBy("_v"))
    inside = inside.withColumn("_upto", upto).select(*by, "_v", "_k", "_upto", "_n", F.explode("_w").alias("_w"))
    found = inside.filter((F.col("_upto") - F.col("_k") <= F.col("_w.rank")) & (F.col("_w.rank") < F.col("_upto")))
    return found.groupBy(*by).agg(F.first("_n").alias("_n"), *(F.max(F.when(F.col("_w.name") == name, F.col("_v"))).alias(name) for name in ranks))


def quantiles(rows: DataFrame, value: str, by: Sequence[str], wanted: Mapping[str, float]) -> DataFrame:
    """(by..., name...): of each group the quantiles between values, in proportion where a quantile falls between two of them."""
    place = {name: F.lit(float(q)) * (F.col("_n") - 1) for name, q in wanted.items()}
    ranks = {f"_{side}_{name}": f(p) for name, p in place.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    found = at_ranks(rows, value, by, ranks)
    between = {name: F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (p - F.floor(p)) for name, p in place.items()}
    return found.select(*by, *(F.when(F.col(f"_low_{n}") == F.col(f"_high_{n}"), F.col(f"_low_{n}")).otherwise(b).alias(n) for n, b in between.items()))


def with_quantiles(groups: DataFrame, rows: DataFrame, value: str, by: Sequence[str], wanted: Mapping[str, float]) -> DataFrame:
    """groups(by..., ...) with quantiles of rows; null for a group without values."""
    found = quantiles(rows, value, by, wanted).select(*(F.col(c).alias(f"_q_{c}") for c in by), *wanted)
    if not by:
        return groups.join(found, F.lit(True), "left")  # one row each
    return groups.join(found, same(groups, found, by, "_q_"), "left").select(*groups.columns, *wanted)
