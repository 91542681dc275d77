"""Links and groups of near-duplicates: candidate pairs from buckets without all pairs, connected components."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import dropped, stored

#: A key is spread over tasks if more than one in so many rows has it; so at most as many keys are.
SPREAD = 1000


def components(edges: DataFrame) -> DataFrame:
    """(id, component): of each id in edges(a, b), the smallest id that it reaches.

    Alternating large-star and small-star steps, each an aggregation and a join, until the edges stay the same.
    What an aggregation finds is stored before it is joined, so that the edges are one side of a join of two exchanges, in which Spark
    splits a node with very many neighbours over tasks; they are never gathered.
    """
    now = stored(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v").distinct())
    before = None
    while True:
        # large star: every larger neighbour of u goes to the smallest around u
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: every smaller neighbour of u, and u, go to the smallest around u
        dropped(least)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = stored(small.filter("u <> v").distinct())
        state = small.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(now), dropped(large), dropped(least)
        now = small
        if state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before = state


def always(a: Column, b: Column) -> Column:
    return F.lit(True)


def spread_join(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows(key, id, ...) joined with one(key, k, ...), which has a row for each key and says how many rows have it.

    The rows of a frequent key are parted by their ids, and each part finds a copy of the key's one row.
    """
    total = one.agg(F.sum("k")).first()[0] or 0
    share = max(1, total // SPREAD)
    hot = one.filter(F.col("k") > share).select("key", F.ceil(F.col("k") / share).cast("int").alias("copies")).collect()  # SPREAD rows at most
    if not hot:
        return rows.join(one.drop("k"), "key")
    hot = F.broadcast(rows.sparkSession.createDataFrame(hot, "key long, copies int"))
    parted = rows.join(hot, "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("copies")), F.lit(0).cast("long"))).drop("copies")
    copied = one.drop("k").join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("copies") - 1, F.lit(0)).cast("long")))).drop("copies")
    return parted.join(copied, ["key", "part"]).drop("part")


def shared(members: DataFrame, may: Callable[[Column, Column], Column] = always, parts: int = 1) -> DataFrame:
    """members(key, id, n) of buckets with more than one id; n is an id's size, and a member may be named several times.
    Buckets of two that may(n of a, n of b) excludes go as well. With `parts`, so many parts of the keys go through their exchange one after
    another, so that the disk holds one part of it at a time; members is read for each, so it should be stored."""
    if parts > 1:
        found = [shared(members.filter(F.pmod("key", F.lit(parts)) == part), may) for part in range(parts)]
        return reduce(DataFrame.unionByName, found)
    members = members.repartition("key")  # once: what follows finds the rows of a key together
    ends = members.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.min_by("n", "id").alias("n_x"), F.max_by("n", "id").alias("n_y"), F.count(F.lit(1)).alias("k"))
    keys = ends.filter((F.col("x") < F.col("y")) & ((F.col("k") > 2) | may(F.col("n_x"), F.col("n_y")))).select("key")
    return stored(members.join(keys.hint("shuffle_hash"), "key", "left_semi").groupBy("key", "id").agg(F.min("n").alias("n")))


def bucket_links(left: DataFrame, confirm: Callable[[DataFrame], DataFrame], pairs_left: Callable[[DataFrame], DataFrame], may: Callable[[Column, Column], Column] = always) -> DataFrame:
    """Links (a, b), confirmed, that join whatever the pairs inside the buckets of shared() members join.

    may(n of a, n of b) tells by the sizes whether a pair is a candidate at all.

    First each member is compared with one other, the smallest that heads a bucket of its own; of a group of copies
    that leaves one component. Then every bucket has one centre, twice, which is compared with all its members that are
    not in the centre's component yet; the centre has then met everyone and leaves the bucket. A bucket is done as soon as
    its members are in one component. So copies of one text cost one comparison each and never all pairs. What is
    left are members of different components that have met no centre in common: pairs_left gets them as (key, id, n,
    component) and returns the pairs to compare, without those of which it can prove that they aren't linked.
    """

    def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """rows of buckets that have several components."""
        rows = rows.join(labels, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
        rows = stored(rows)
        open_ = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
        kept = stored(rows.join(open_, "key", "left_semi"))
        dropped(rows)
        return kept

    heads = stored(left.groupBy("key").agg(F.min("id").alias("head"), F.min_by("n", "id").alias("n_b"), F.count(F.lit(1)).alias("k")))
    near = spread_join(left, heads).filter((F.col("id") != F.col("head")) & may(F.col("n"), F.col("n_b")))
    pairs = stored(near.groupBy("id").agg(F.min("head").alias("head")).select(F.col("head").alias("a"), F.col("id").alias("b")))
    links = stored(confirm(pairs))
    dropped(heads), dropped(pairs)
    labels = stored(components(links))
    left = labelled(left, labels)
    for pick, pick_by in ((F.min, F.min_by), (F.max, F.max_by)):  # so that centres lie apart
        if left.isEmpty():
            return links
        centres = stored(left.groupBy("key").agg(pick("id").alias("centre"), pick_by("component", "id").alias("of"), pick_by("n", "id").alias("n_b"), F.count(F.lit(1)).alias("k")))
        both = spread_join(left, centres)
        near = (F.col("component") != F.col("of")) & may(F.col("n"), F.col("n_b"))
        pairs = stored(both.filter(near).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct())
        if not pairs.isEmpty():
            links = links.union(stored(confirm(pairs)))
            dropped(labels)
            labels = stored(components(links))
        rest = labelled(both.filter("id <> centre").select("key", "id", "n"), labels)
        dropped(left), dropped(centres), dropped(pairs)
        left = rest
    if left.isEmpty():
        return links
    pairs = stored(pairs_left(left))
    dropped(left), dropped(labels)
    return links if pairs.isEmpty() else links.union(stored(confirm(pairs)))
