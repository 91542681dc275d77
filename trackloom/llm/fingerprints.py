"""Operator 10, document fingerprints by one-permutation MinHash.

Each 5-word shingle is hashed once. The hash's upper bits choose one of 256 bins, and each bin keeps its least hash.
An empty bin borrows from a full one by optimal densification: it asks bins in an order that depends on its own number
alone, until one is full, so two texts that agree on which bins are full borrow alike. Of each bin 4 bits of a hash of bin and
value are kept, packed into 16 longs. Equal bins, less those that agree by chance (1 in 16), estimate the similarity.

All of it is built-in array functions: texts stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm.common import row_key, same_row, stored

#: Words of a shingle, bins, bits of a bin's number, and bits that are kept of each bin.
SHINGLE, BINS, BIN_BITS, KEPT_BITS = 5, 256, 8, 4
#: Bins that an empty one asks by table; if all are empty, it takes the full one with the least hash of both numbers.
ASKED = 8
_PER_LONG = 64 // KEPT_BITS

_ORDERS = np.random.default_rng(1701).integers(0, BINS, (ASKED, BINS)).tolist()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, size: int) -> Column:
    """From word hashes: one hash for each `size` words; for fewer words one of them all, for none none."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(size))))
    return F.when(F.size(words) >= size, each).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<long>"))


def bin_of(h: Column) -> Column:
    """0 to BINS - 1, rising with h."""
    return F.shiftright(h, 64 - BIN_BITS) + BINS // 2


def least_of_bins(hashes: Column) -> Column:
    """The least hash of each bin that has any, in order."""
    return let(F.sort_array(hashes), lambda s: F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1)))))


def densified(least: Column) -> Column:
    """BINS hashes, from the least hashes of the full bins in order."""
    gap = lambda h, i: bin_of(h) - F.when(i == 0, 0).otherwise(bin_of(F.get(least, i - 1)) + 1)
    null = F.lit(None).cast("long")
    placed = F.flatten(F.transform(least, lambda h, i: F.concat(F.array_repeat(null, gap(h, i).cast("int")), F.array(h))))
    orders = [F.lit(order) for order in _ORDERS]

    def borrowed(bins: Column) -> Column:
        def asked(i: Column) -> Column:
            nearest = F.array_min(F.transform(least, lambda h: F.struct(F.xxhash64(i, bin_of(h)).alias("rank"), h.alias("h"))))
            return F.coalesce(F.get(bins, i), *(F.get(bins, F.get(order, i)) for order in orders), nearest["h"])

        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), asked)

    return let(placed, borrowed)


def packed(hashes: Column) -> Column:
    """Some bits of BINS hashes, _PER_LONG to a long. They depend on the bin, too: bins that hold one hash, borrowed ones, do not agree
    with another text's by one and the same chance."""
    mask = F.lit((1 << KEPT_BITS) - 1).cast("long")
    hashes = F.transform(hashes, lambda h, i: F.xxhash64(h, i))
    one = lambda j: F.aggregate(F.slice(hashes, j * _PER_LONG + 1, _PER_LONG), F.lit(0).cast("long"), lambda a, h: F.shiftleft(a, KEPT_BITS).bitwiseOR(h.bitwiseAND(mask)))
    return F.transform(F.sequence(F.lit(0), F.lit(BINS // _PER_LONG - 1)), one)


def fingerprint(text: Column, size: int = SHINGLE) -> Column:
    """The packed fingerprint of a text as an array of longs; an empty array for a text without words."""
    hashes = let(word_hashes(F.coalesce(text, F.lit(""))), lambda w: shingle_hashes(w, size))
    return let(hashes, lambda s: F.when(F.size(s) > 0, let(least_of_bins(s), lambda b: let(densified(b), packed))).otherwise(F.array().cast("array<long>")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two packed fingerprints, 0 to 1. Without words, texts are like each other only."""
    low = F.lit(int("1" * 16, 16)).cast("long")

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(low))

    equal = 1 - F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda n, x: n + x) / F.lit(float(BINS))
    chance = 2.0**-KEPT_BITS
    known = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(known)


def as_text(packed_longs: Column) -> Column:
    return F.array_join(F.transform(packed_longs, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def successors(rows: DataFrame, parts: int) -> DataFrame:
    """rows(doc_id, h, ...) distinct, each with next_id and next_h: the row with the next smaller (doc_id, h), after the
    smallest the largest. Ranges of ids are ordered apart; of each range only its largest row goes to the others."""
    ranges = stored(rows.repartitionByRange(parts, "doc_id", "h").withColumn("part", F.spark_partition_id()))
    order = W.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), F.desc("h"))
    # a row for each range, as many as there are partitions
    tops = ranges.groupBy("part").agg(F.max_by(F.struct("doc_id", "h"), F.struct(F.col("doc_id").isNotNull(), "doc_id", "h")).alias("top"))
    around = W.orderBy("part")
    tops = tops.select("part", F.coalesce(F.lag("top").over(around), F.last("top").over(around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("below"))
    out = ranges.withColumn("next", F.lead(F.struct("doc_id", "h")).over(order)).join(F.broadcast(tops), "part")
    after = F.coalesce("next", "below")
    return out.select(*rows.columns, after["doc_id"].alias("next_id"), after["h"].alias("next_h"))


def fingerprinted(documents: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts, and of each text whose last third is replaced by the beginning of the next one's.

    Returns (doc_id, h, next_id, next_h, n_chars, edited, fingerprint, edited_fingerprint); fingerprints are packed longs, h
    tells apart rows that repeat a doc_id, and next_id, next_h name the next text, for compared().
    The next text is that of the next smaller doc_id; after the smallest comes the largest, so a single text is its own next.
    A null text is empty. A null doc_id is smaller than all others; rows that repeat a doc_id go on by a hash of their
    texts; rows equal in both are each in the result, and one in the order. An empty table gives an empty result. Further columns are ignored, whatever their names.
    A very long text is one row like any other; what travels of it is its first third.
    """
    docs = documents.select(*row_key(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = docs.sparkSession
    rows = docs.select("doc_id", "h", F.floor(F.length("text") / 3).cast("int").alias("cut")).distinct()
    rows = stored(successors(rows, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # the beginnings travel, not whole texts
    wanted = docs.join(rows, docs["doc_id"].eqNullSafe(rows["next_id"]) & docs["h"].eqNullSafe(rows["next_h"]))
    wanted = wanted.select(rows["doc_id"], rows["h"], "cut", "next_id", "next_h", F.expr("substring(text, 1, cut)").alias("beginning"))
    wanted = wanted.groupBy("doc_id", "h", "cut", "next_id", "next_h").agg(F.first("beginning").alias("beginning"))
    both = docs.join(wanted, same_row(docs, wanted)).select(docs["doc_id"], docs["h"], "next_id", "next_h", "text", F.expr("concat(substring(text, 1, length(text) - cut), beginning)").alias("edited"))
    out = both.select("doc_id", "h", "next_id", "next_h", F.length("text").cast("long").alias("n_chars"), "edited", fingerprint(F.col("text"), size).alias("fingerprint"), fingerprint(F.col("edited"), size).alias("edited_fingerprint"))
    return out


def compared(rows: DataFrame) -> DataFrame:
    """rows of fingerprinted() with near_edited and near_next, the likeness of a text to its edited form and to the next."""
    other = rows.groupBy(F.col("doc_id").alias("id_b"), F.col("h").alias("h_b")).agg(F.first("fingerprint").alias("fingerprint_b"))
    joined = rows.join(other, F.col("next_id").eqNullSafe(F.col("id_b")) & F.col("next_h").eqNullSafe(F.col("h_b")))
    return joined.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).withColumn("near_next", likeness(F.col("fingerprint"), F.col("fingerprint_b")))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprinted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = stored(out.withColumn("edited_sha256", F.sha2(F.col("edited"), 256)).drop("edited"))
    return compared(out).select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fingerprint")).alias("fingerprint"), as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
