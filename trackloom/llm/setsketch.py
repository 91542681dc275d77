"""Operator 9, near-duplicates by SetSketch.

A set's sketch has M registers. Register i is floor(1 - log_b(x)) for the least x of the set's elements, which get
exponentially distributed values by the i-th hash; it is cut to 16 bits. The larger of two registers is the register
of the union, so sketches merge. Two sets agree in a register with a chance that rises with their similarity: bands of
registers make the candidates, from the counts of larger, smaller and equal registers the similarity is estimated
by likelihood, and what may reach the threshold is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import chunks, stored, utf8
from trackloom.llm.hashing import Prefixes, mixed, words_of
from trackloom.llm.links import bucket_links, components, shared

#: Registers in a band, and bands. A pair with similarity 0.85 misses all bands in 1 of 40 million cases.
ROWS, BANDS = 5, 30
#: Base of the registers' scale, rate of the exponential values, and the largest register.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Pairs whose estimate is below the threshold by more than this go without confirmation: seven standard errors at least.
MARGIN = 0.3
#: Bytes of text made into numpy arrays at once. A worker keeps what it once took, and the next stage's tasks run in the same workers.
AT_ONCE = 250_000

_FACTORS = mixed(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def registers(least: np.ndarray) -> np.ndarray:
    """Registers from the least 64-bit hashes: the value of a hash u in (0, 1) is -ln(1 - u) / RATE, which rises with u."""
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def likely(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, m: int = ROWS * BANDS) -> np.ndarray:
    """The similarity under which so many registers of a are larger and smaller than those of b is likeliest.

    A register of a is larger with chance p(u - vJ) and smaller with p(v - uJ), where p(x) = -log_b(1 - x (b - 1) / b)
    and u, v are the sets' shares of n_a + n_b. The logarithm of the likelihood is concave: golden section finds its top.
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(u / v, v / u)
    equal = m - larger - smaller

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p = [np.maximum(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-12) for x in (u - v * j, v - u * j)]
        return larger * np.log(p[0]) + smaller * np.log(p[1]) + equal * np.log(np.maximum(1 - p[0] - p[1], 1e-12))

    low, high, g = np.zeros_like(most), most.copy(), (5**0.5 - 1) / 2
    for _ in range(30):
        x, y = high - g * (high - low), low + g * (high - low)
        right = log_likelihood(x) < log_likelihood(y)
        low, high = np.where(right, x, low), np.where(right, high, y)
    return (low + high) / 2


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of k-word shingles of each row; with fewer words that of all its words, without words none."""
    symbols, places = words_of(data, offsets, lower=True)
    prefixes = Prefixes(symbols)
    every = prefixes.every(k)
    for a, b in zip(places[:-1].tolist(), places[1:].tolist()):
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield prefixes.hashes(np.array([a]), np.array([b]))
        else:
            yield every[:0]


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(id, h, n, d1, d2, sketch) of docs(id, h, text): the set's size, its digest and its registers (empty set: null)."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            n, digests, out = [], [], []
            for a, b in chunks(offsets, AT_ONCE):
                for shingles in shingle_sets(data, offsets[a : b + 1], k):
                    n.append(len(shingles))
                    digests.append([int(x) for x in (np.sum(mixed(shingles)), np.sum(mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))))] if len(shingles) else [0, 0])
                    if not len(shingles):
                        out.append(None)
                        continue
                    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
                    for at in range(0, len(shingles), 2048):
                        np.minimum(least, (_FACTORS[:, None] * shingles[None, at : at + 2048]).min(axis=1), out=least)
                    out.append(registers(least).tobytes())
            digests = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(out, pa.binary())], names=["id", "h", "n", "d1", "d2", "sketch"])

    return docs.mapInArrow(sketched, "id long, h int, n long, d1 long, d2 long, sketch binary")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets, AT_ONCE):
                found = [x.view(np.int64) for x in shingle_sets(data, offsets[a : b + 1], k)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], names=["id", "shingles"])

    return docs.mapInArrow(sets, "id long, shingles array<long>")


def estimated(pairs: DataFrame) -> DataFrame:
    """pairs(a, b, n_a, n_b, sketch_a, sketch_b) with the estimate `similarity` in place of the sketches."""

    def joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, ROWS * BANDS) for c in ("sketch_a", "sketch_b"))
            sizes = [batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "n_a", "n_b")), pa.array(likely((x > y).sum(axis=1), (x < y).sum(axis=1), *sizes))], names=["a", "b", "n_a", "n_b", "similarity"])

    return pairs.mapInArrow(joint, "a long, b long, n_a long, n_b long, similarity double")


def near_duplicates(documents: DataFrame, k: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by 100 * |intersection| >= percent * |union| of their sets of k-word shingles.

    Returns (id, n_shingles, component): component is the smallest id that id reaches over links, itself included.
    Texts without words, null and empty ones are linked with nothing. Rows that repeat an id are each in the
    result as one node, for which of several texts the one with the smallest hash is compared; a row whose id is null is
    alone and has the component null. Further columns are ignored, whatever their names. Documents with the same set are one class, so copies are never compared.
    A very long text is shingled in one task, and its whole set is compared. An empty table gives an empty result.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.hash(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    rows = stored(sketches(docs, k))
    # stored, so that the rows of a set with very many copies can be split where they are joined with it
    classes = stored(rows.filter("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")))
    found = rows.filter("n > 0 and id is not null").join(classes, ["d1", "d2", "n"])
    member = stored(found.select("id", "rep"))
    reps = found.filter("id = rep").groupBy("id").agg(F.min(F.struct("h", "n", "sketch")).alias("x"))
    reps = stored(reps.select("id", "x.h", "x.n", "x.sketch"))
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.expr("sketch").substr(i * 2 * ROWS + 1, F.lit(2 * ROWS)))).alias("band", "value")
    may = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    buckets = shared(reps.select("id", "n", band).select(F.xxhash64("band", "value").alias("key"), "id", "n"), may)

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a")), "a")
        pairs = pairs.join(reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b")), "b")
        pairs = stored(estimated(pairs).filter(F.col("similarity") * 100 >= percent - 100 * MARGIN))
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(reps.select("id", "h"), "id")
        sets = stored(full_sets(docs.join(ids, ["id", "h"], "left_semi"), k))
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        both = both.withColumn("i", F.size(F.array_intersect("x", "y")).cast("long"))
        return both.filter(F.col("i") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("i")) * percent).select("a", "b")

    def pairs_left(left: DataFrame) -> DataFrame:
        """Pairs of different components that may be linked, by prefix and position: with all shingles in one order, rare
        ones first, the first shingle that linked texts share lies so early in both that enough may follow it. So a copy
        with many edits of its own is settled without meeting the thousands that it resembles; no link is lost."""
        of = left.select("id", "component").distinct().join(reps.select("id", "h", "n"), "id")
        sets = stored(full_sets(docs.join(of, ["id", "h"], "left_semi"), k)).dropDuplicates(["id"])
        shingles = sets.select("id", F.explode("shingles").alias("t"))
        ordered = shingles.join(stored(shingles.groupBy("t").agg(F.count(F.lit(1)).alias("df"))), "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("s"))
        early = F.slice("s", 1, (F.floor(F.size("s") * (100 - percent) / 100) + 1).cast("int"))
        first = ordered.select("id", F.posexplode(early).alias("i", "x")).select("id", "i", F.col("x.t").alias("t"))
        first = stored(first.join(of.select("id", "component", "n"), "id"))
        sizes = first.groupBy("t", "component").agg(F.count(F.lit(1)).alias("k"))
        main = stored(sizes.groupBy("t").agg(F.max_by("component", "k").alias("main"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("t", "main"))
        # of each shingle's components the largest only answers: its texts need not meet each other
        ask = stored(first.join(main, "t").filter("component <> main").drop("main"))
        answer = stored(first.join(main, "t", "left_semi").select("t", *(F.col(c).alias(f"{c}_b") for c in ("id", "component", "n", "i"))))
        most = 1 + F.least(F.col("n") - F.col("i") - 1, F.col("n_b") - F.col("i_b") - 1)
        may = (F.col("component") != F.col("component_b")) & (most * (100 + percent) >= (F.col("n") + F.col("n_b")) * percent)
        return ask.join(answer, (ask["t"] == answer["t"]) & may).select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct()

    links = bucket_links(buckets, confirm, pairs_left, may)
    same = member.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    labels = components(links.union(same))
    return rows.join(labels, "id", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
