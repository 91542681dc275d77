"""Operator 7, benchmark decontamination by containment search.

Test items are parted by size: a partition holds items whose number of shingles lies between a bound and half of it.
Documents are cut, for each partition, into overlapping windows of one and a half times that bound, so that whatever is as long as an
item lies inside a window in which it is a good part of all shingles; a document's own length does not matter then.
Windows get MinHash registers: the hashes of a few blocks of shingles are reduced once for all partitions, and a window's
registers are the least of its blocks'. A window and an item that agree in a register are candidates; they are
verified by the exact share of the item's shingles in the document around the window.

Items of up to BLOCK shingles are too small a part of any window: they have their shingles as keys instead. A document with
CONTAINED of them has at least one of any n - CONTAINED n + 1, so those of the item that many are joined with all of the document's: the ones
that the fewest items have, so that a stem which many items share brings no document to all of them.

Registers are the least of hash XOR mask, for a mask by register. All of it is built-in functions.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import small, stored
from trackloom.llm.fingerprints import let, shingle_hashes

#: Words of a shingle, share of an item's shingles that a document must have, and registers.
SHINGLE, CONTAINED, REGISTERS = 5, 0.8, 20
#: Shingles of a block: all windows consist of whole blocks.
BLOCK = 16
#: Size bounds of items for which they are broadcast: rows and bytes.
FEW_ROWS, FEW_BYTES = 100_000, 8_000_000

#: The partition of items of up to BLOCK shingles.
SMALL = 0

_MASKS = np.random.default_rng(90125).integers(-(2**63), 2**63 - 1, REGISTERS).tolist()


def normal_words(text: Column) -> Column:
    """Hashes of the words of a text in lower case, without the marks around them."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(text: Column) -> Column:
    """One hash for each SHINGLE words; a shorter text has one, of all its words."""
    return let(normal_words(text), lambda w: shingle_hashes(w, SHINGLE))


def registers(hashes: Column) -> Column:
    def register(mask: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(mask))))

    return F.array(*(register(mask) for mask in _MASKS))


def least(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def window_blocks(size: int) -> tuple[int, int]:
    """Blocks of a window, and blocks from one to the next, for items of up to `size` shingles: size is BLOCK * 2**i, i > 0."""
    step = size // 2 // BLOCK
    return 3 * step, step


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, hashes, size, item): the distinct shingles of each item, its partition's bound and a key of both. Items
    without words are none."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.array_distinct(shingles(F.col(text_col))).alias("hashes")).filter(F.size("hashes") > 0)
    bound = F.when(F.size("hashes") > BLOCK, F.pow(F.lit(2), F.ceil(F.log2(F.size("hashes"))))).otherwise(SMALL).cast("int")
    return stored(items.select("item_id", "hashes", bound.alias("size"), F.struct("item_id", F.xxhash64("hashes").alias("h")).alias("item")).dropDuplicates(["item"]))


def windows(blocks: Column, sizes: list[int]) -> Column:
    """(size, registers) of each window for items of up to each of `sizes` shingles, from the registers of a document's blocks.

    Registers of 2, 4, 8 and more blocks come from those of half as many, so that a window of 3 * 2**i blocks takes two of them and
    the plan grows with the logarithm of the longest item. Windows at a text's end are shorter.
    """

    def from_(runs: Column, i: Column) -> Column:
        return F.get(runs, i)

    def both(a: Column, i: Column, b: Column, j: Column) -> Column:
        """The registers of the run of blocks at i and of that at j, if there is one."""
        return F.when(j < F.size(blocks), least(from_(a, i), from_(b, j))).otherwise(from_(a, i))

    def some(runs: Column, n: int) -> Column:
        """All windows that begin with n blocks, 2 n and more; runs has the registers of n blocks from each place on."""
        sizes_left = [s for s in sizes if window_blocks(s)[1] >= n]
        if not sizes_left:
            return F.array().cast("array<struct<size: int, registers: array<long>>>")

        def longer(twice: Column) -> Column:
            size = 2 * n * BLOCK
            rest = some(twice, 2 * n)
            if size not in sizes:
                return rest
            starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(blocks) - 2 * n - 1), F.lit(n))
            return F.concat(F.transform(starts, lambda i: F.struct(F.lit(size).alias("size"), both(twice, i, runs, i + 2 * n).alias("registers"))), rest)

        return let(F.transform(runs, lambda x, i: both(runs, i, runs, i + n)), longer)

    return some(blocks, 1)


def rare_shingles(items: DataFrame, share: float) -> DataFrame:
    """(item, size, register, value): so many shingles of each item that a document with `share` of all has one of them, those that the fewest items have."""
    rows = items.select(F.xxhash64("item").alias("item"), F.size("hashes").alias("n"), F.explode("hashes").alias("value"))
    counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("k"))
    lists = rows.join(counts, "value").groupBy("item", "n").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("s"))  # BLOCK at most
    some = F.slice("s", F.lit(1), F.floor(F.col("n") * (1 - share) + 1e-9).cast("int") + 1)
    return stored(lists.select("item", F.lit(SMALL).alias("size"), F.lit(0).alias("register"), F.explode(some).alias("x")).select("item", "size", "register", "x.value"))


def contained(documents: DataFrame, benchmark: DataFrame, share: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found): documents with at least `share` of a test item's distinct shingles.

    Found are items that stand in one piece, inserts and edits included, which a window holds. Texts are compared by
    their words in lower case. Null and empty texts contain nothing and are contained nowhere. Rows that repeat an id are compared each, and
    every doc_id and item is returned once, with the largest n_found. A null id is an id like any other. Texts and items may be of any length;
    empty tables give an empty result. Further columns are ignored, whatever their names.
    """
    items = items_of(benchmark, item_id, item_text)
    sizes = [r["size"] for r in items.select("size").distinct().orderBy("size").collect()]  # powers of 2: a few dozen at most
    if not sizes:
        return items.join(documents.select(F.col(id_col).alias("doc_id")).limit(0)).select("doc_id", "item_id", F.lit(0).alias("n_shingles"), F.lit(0).alias("n_found"))
    register_of = F.when(F.col("size") == SMALL, 0).otherwise(F.col("register"))  # a shingle has no place
    few = small(items.select("item_id", F.array_join("hashes", ",")), FEW_ROWS, FEW_BYTES)
    large = items.filter(F.col("size") != SMALL).select(F.xxhash64("item").alias("item"), "size", F.posexplode(registers(F.col("hashes"))).alias("register", "value"))
    keys = rare_shingles(items.filter(F.col("size") == SMALL), share).unionByName(large)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.hash(F.col(text_col)).alias("h"), F.col(text_col).alias("text")).filter(F.length("text") > 0)

    def of_blocks(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / BLOCK).cast("int")), lambda i: registers(F.slice(hashes, i * BLOCK + 1, BLOCK)))

    def of_windows(hashes: Column) -> Column:
        parts = [F.array(F.struct(F.lit(SMALL).alias("size"), F.array_distinct(hashes).alias("registers")))] if SMALL in sizes else []
        if sizes != [SMALL]:
            parts.append(let(of_blocks(hashes), lambda blocks: windows(blocks, [size for size in sizes if size != SMALL])))
        return F.when(F.size(hashes) > 0, F.concat(*parts))

    found = docs.select("doc_id", "h", F.explode(let(shingles(F.col("text")), of_windows)).alias("w")).select("doc_id", "h", "w.size", F.posexplode("w.registers").alias("register", "value")).withColumn("register", register_of)
    pairs = stored(found.join(F.broadcast(keys) if few else keys, ["size", "register", "value"]).select("doc_id", "h", "item").distinct())
    known = items.select(F.xxhash64("item").alias("item"), "item_id", "hashes")
    asked = pairs.join(F.broadcast(known) if few else known, "item").groupBy(F.col("doc_id").alias("pair_id"), F.col("h").alias("pair_h")).agg(F.collect_list(F.struct("item_id", "hashes")).alias("asked"))
    both = docs.join(asked, docs["doc_id"].eqNullSafe(asked["pair_id"]) & (docs["h"] == asked["pair_h"]))
    # a text's shingles are made once, whatever it is asked for
    n_found = lambda own: F.transform("asked", lambda x: F.struct(x["item_id"].alias("item_id"), F.size(x["hashes"]).alias("n_shingles"), F.size(F.array_intersect(x["hashes"], own)).alias("n_found")))
    answers = F.filter(let(shingles(F.col("text")), n_found), lambda x: x["n_found"] >= x["n_shingles"] * share)
    found = both.select("doc_id", F.explode(answers).alias("x")).select("doc_id", "x.*")
    return found.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_found").alias("n_found"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: By exact containment of all shingles.
SQL = r"""
WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT id AS doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) > 0),
bs AS (SELECT DISTINCT id AS item_id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY 1)
SELECT doc_id, bs.item_id, CAST(any_value(n_shingles) AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_found
FROM bs JOIN ds USING (s) JOIN n ON n.item_id = bs.item_id
GROUP BY doc_id, bs.item_id HAVING count(*) >= 0.8 * any_value(n_shingles)
"""
