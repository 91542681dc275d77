from pyspark.sql import functions as F

from trackloom.llm import decontaminate
from trackloom.llm.decontaminate import contained, items_of, rare_shingles

STEM = "which of the following is the best answer to the question about"


def test_a_stem_of_many_items_is_no_key(spark):
    """Items with one stem against documents that hold the stem alone: no candidates, so nothing that grows with both."""
    items = spark.range(200).select(F.col("id").alias("item_id"), F.concat_ws(" ", F.lit(STEM), *(F.concat(F.lit(f"w{j}x"), F.col("id").cast("string")) for j in range(6))).alias("text"))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some"), F.lit(STEM), F.lit("nothing at all"), F.col("id").cast("string")).alias("text"))
    whole = items.filter("item_id < 3").select((F.col("item_id") + 1000).alias("doc_id"), F.concat_ws(" ", F.lit("before it"), "text", F.lit("and after")).alias("text"))
    keys = rare_shingles(items_of(items, "item_id", "text"), 0.8)
    stem = {r.h for r in spark.range(1).select(F.explode(decontaminate.shingles(F.lit(STEM))).alias("h")).collect()}
    assert not stem & {r.value for r in keys.collect()}
    got = sorted((r.doc_id, r.item_id, r.n_found) for r in contained(docs.union(whole), items).collect())
    n = 12 + 6 - 4
    assert got == [(1000 + i, i, n) for i in range(3)]
