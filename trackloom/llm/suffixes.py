"""Operator 5, substring dedup with a logarithmic family of suffix arrays.

Of all suffixes of the texts' bytes the index holds those at minimizers: any `length` equal bytes hold the same
minimizer at the same place, so the sampled suffixes find every long match while only one suffix in about 170 bytes is
sorted (a sparse suffix array). Suffixes are ordered by the fingerprint of their first bytes, so those that begin alike
stand side by side, wherever they come from; equal neighbours are held as one entry with their number.

Documents come in batches. Each new batch gets an array of its own; it is merge-scanned against every level that
exists, which finds its long matches with all earlier batches; then it joins the family, and as long as two levels
have equal size they merge into one of twice the size. An entry is thus rewritten once for each doubling.

The matches say which suffixes repeat. From their source coordinates the runs of repeated windows are settled whole
where copies agree. Where they part, a run is cut into blocks of a few windows at fixed distances from the minimizer:
a block whose bytes repeat as a whole is settled, one whose common bytes stand nowhere else has no repeated window, and
only in the others, at the very ends of matches, is each window looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import arrow_batches, chunks, dropped, row_key, same_row, stored, utf8
from trackloom.llm.hashing import BYTE_VALUES, Prefixes, super_runs

#: Bytes whose fingerprint orders the suffixes; of a window, the minimizer is the run of so many bytes with the least hash.
ANCHOR = 64
#: Windows of a block.
BLOCK = 16
#: Batches that a table is fed to the index in.
BATCHES = 4

_RUNS = "doc_id long, h int, batch int, mh long, sh long, start int, n int, at int"
_RUNS_ARROW = pa.schema([("doc_id", pa.int64()), ("h", pa.int32()), ("batch", pa.int32()), ("mh", pa.int64()), ("sh", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("at", pa.int32())])
_BLOCKS_ARROW = pa.schema([("doc_id", pa.int64()), ("h", pa.int32()), ("mh", pa.int64()), ("block", pa.int32()), ("low", pa.int32()), ("core", pa.int64()), ("full", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
_WINDOWS_ARROW = pa.schema([("doc_id", pa.int64()), ("h", pa.int32()), ("mh", pa.int64()), ("wh", pa.int64()), ("start", pa.int32())])


def sampled_suffixes(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """A row for each suffix at a minimizer of docs(doc_id, h, batch, text): mh, the fingerprint of its first bytes, and
    the run of n windows that have this minimizer, the first at `start`, with the fingerprint sh of all bytes under it."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = {c: batch.column(c) for c in ("doc_id", "h", "batch")}
            for a, b in chunks(offsets):
                found = super_runs(BYTE_VALUES[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], length, anchor)
                rows = pa.array(found["row"] + a)
                yield from arrow_batches({**found, **{c: x.take(rows) for c, x in ids.items()}}, _RUNS_ARROW)

    return docs.mapInArrow(runs, _RUNS)


class SuffixFamily:
    """Levels of sorted suffix entries (mh, k): level i holds 2**i batches. Every level is a table in the shared folder."""

    def __init__(self):
        self.levels: dict[int, DataFrame] = {}
        self.matches: list[DataFrame] = []

    def add(self, suffixes: DataFrame) -> None:
        """Index a batch of suffixes(mh), and note the fingerprints that it repeats or shares with earlier batches."""
        array = stored(suffixes.groupBy("mh").agg(F.sum("k").alias("k")).sortWithinPartitions("mh"))
        found = array.filter("k > 1").select("mh")
        for level in self.levels.values():
            found = found.union(array.join(level.select("mh"), "mh", "left_semi").select("mh"))
        self.matches.append(stored(found))
        size = 0
        while size in self.levels:
            older = self.levels.pop(size)
            merged = stored(array.union(older).groupBy("mh").agg(F.sum("k").alias("k")).sortWithinPartitions("mh"))
            dropped(older), dropped(array)
            array, size = merged, size + 1
        self.levels[size] = array

    def repeated(self) -> DataFrame:
        """The fingerprints that start more than one suffix of all batches."""
        out = self.matches[0]
        for more in self.matches[1:]:
            out = out.union(more)
        return stored(out.distinct())


def with_text(docs: DataFrame, runs: DataFrame, *columns: str) -> DataFrame:
    """docs(doc_id, h, text) that have runs, with those as lists."""
    lists = runs.groupBy("doc_id", "h").agg(F.collect_list(F.struct(*columns)).alias("runs"))
    return docs.join(lists, same_row(docs, lists)).select(docs["doc_id"], docs["h"], "text", "runs")


def each_text(batch: pa.RecordBatch, most: int = 500) -> Iterator[tuple[Prefixes, list[np.ndarray], dict[str, pa.Scalar]]]:
    """Of each row of with_text(): the hashes of its text, at most so many of its runs as arrays, and its key."""
    data, offsets = utf8(batch.column("text"))
    lists = batch.column("runs")
    for i in range(len(lists)):
        columns = [x.to_numpy().astype(np.int64) for x in lists[i].values.flatten()]
        prefixes = Prefixes(BYTE_VALUES[data[offsets[i] : offsets[i + 1]]])
        for a in range(0, len(columns[0]), most):
            yield prefixes, [x[a : a + most] for x in columns], {c: batch.column(c)[i] for c in ("doc_id", "h")}


def repeated(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0 n[0] times, 1 n[1] times and so on, and counts from 0 on within each."""
    each = np.repeat(np.arange(len(n)), n)
    return each, np.arange(len(each)) - (np.cumsum(n) - n)[each]


def blocks_of(docs: DataFrame, runs: DataFrame, length: int, size: int) -> DataFrame:
    """The blocks of runs(doc_id, h, mh, start, n, at). A window's distance is that from its start to the minimizer;
    block j has distances j * size up to the next block's, as far as the run has them: n windows from `start` on, the least
    distance `low`. core: hash of the bytes that all windows of a whole block have in common; full: of all its bytes."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for prefixes, (mh, start, n, at), key in each_text(batch):
                least = at - n + 1
                first = least // size
                each, j = repeated(at // size - first + 1)
                j += first[each]
                low, high, place = np.maximum(j * size, least[each]), np.minimum(j * size + size - 1, at[each]), (start + at)[each]
                core = prefixes.hashes(place - j * size, place - j * size - size + 1 + length)
                full = prefixes.hashes(place - high, place - low + length)
                key = {c: pa.repeat(x, len(j)) for c, x in key.items()}
                yield from arrow_batches({**key, "mh": mh[each], "block": j, "low": low, "core": core.view(np.int64), "full": full.view(np.int64), "start": place - high, "n": high - low + 1}, _BLOCKS_ARROW)

    return with_text(docs, runs, "mh", "start", "n", "at").mapInArrow(blocks, "doc_id long, h int, mh long, block int, low int, core long, full long, start int, n int")


def windows_of(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """Each window of runs(doc_id, h, mh, start, n), with the hash of its bytes."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for prefixes, (mh, start, n), key in each_text(batch):
                each, place = repeated(n)
                place += start[each]
                key = {c: pa.repeat(x, len(place)) for c, x in key.items()}
                yield from arrow_batches({**key, "mh": mh[each], "wh": prefixes.hashes(place, place + length).view(np.int64), "start": place}, _WINDOWS_ARROW)

    return with_text(docs, runs, "mh", "start", "n").mapInArrow(windows, "doc_id long, h int, mh long, wh long, start int")


def several(rows: DataFrame, *key: str) -> DataFrame:
    """The keys that more than one row has."""
    return stored(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(*key))


def repeated_spans(docs: DataFrame, length: int = 400, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """Spans of bytes (doc_id, h, start, length) of docs(doc_id, h, text) under windows of `length` bytes that also
    start elsewhere, in the same text or another. Spans may overlap and touch."""
    docs = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "h"), F.lit(batches)).cast("int"))
    suffixes = stored(sampled_suffixes(docs, length, min(anchor, length)), "batch")
    family = SuffixFamily()
    for batch in range(batches):
        family.add(suffixes.filter(F.col("batch") == batch).select("mh", F.lit(1).cast("long").alias("k")))
    docs = docs.drop("batch")
    runs = stored(suffixes.join(family.repeated(), "mh", "left_semi").drop("batch"))
    paths = stored(runs.groupBy("mh", "sh").agg(F.count(F.lit(1)).alias("k")))
    forks = stored(paths.groupBy("mh").agg(F.count(F.lit(1)).alias("j")).filter("j > 1").select("mh", F.lit(True).alias("fork")))
    known = stored(runs.join(paths, ["mh", "sh"]).join(forks, "mh", "left"))
    whole = known.filter("k > 1").select("doc_id", "h", "start", (F.col("n") + length - 1).alias("length"))
    # of the copies of a run that parts from others, one stands for all: their own windows are settled already
    keep = known.filter("fork and k > 1").groupBy("mh", "sh").agg(F.min(F.struct("doc_id", "h", "start", "n", "at")).alias("x")).select("x.doc_id", "x.h", "mh", "x.start", "x.n", "x.at")
    alone = known.filter("fork and k = 1").select("doc_id", "h", "mh", "start", "n", "at")
    size = max(1, min(BLOCK, length // 4))
    blocks = stored(blocks_of(docs, alone.unionByName(keep), length, size))
    blocks = stored(blocks.join(several(blocks, "mh", "block", "core"), ["mh", "block", "core"], "left_semi"))
    settled = several(blocks, "mh", "block", "low", "n", "full").withColumn("settled", F.lit(True))
    blocks = stored(blocks.join(settled, ["mh", "block", "low", "n", "full"], "left"))
    agreed = blocks.filter("settled").select("doc_id", "h", "start", (F.col("n") + length - 1).alias("length"))
    # as above, one of those that agree stands for all
    ends = blocks.filter("settled is null").select("doc_id", "h", "mh", "start", "n")
    ends = ends.unionByName(blocks.filter("settled").groupBy("mh", "block", "low", "n", "full").agg(F.min(F.struct("doc_id", "h", "start")).alias("x")).join(blocks.filter("settled is null").select("mh", "block").distinct(), ["mh", "block"], "left_semi").select("x.doc_id", "x.h", "mh", "x.start", "n"))
    windows = stored(windows_of(docs, ends, length))
    single = windows.join(several(windows, "mh", "wh"), ["mh", "wh"], "left_semi").select("doc_id", "h", "start", F.lit(length).alias("length"))
    return stored(whole.unionByName(agreed).unionByName(single))


def without_repeats(documents: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """documents without every byte that lies in a run of `length` bytes which also starts anywhere else.

    Returns (doc_id, n_bytes, n_removed, spans, kept): spans are the maximal removed runs as (start, end), kept the
    bytes left (binary, as a cut may fall inside a character). A null text is empty; a null doc_id is a key like any
    other. Rows that repeat a doc_id are texts of their own; equal rows repeat each other. Further columns are ignored,
    whatever their names. An empty table gives an empty result. A very long text is worked on in one task, as arrays of a few times its bytes.
    """
    docs = documents.select(*row_key(F.col(id_col).cast("long"), F.col(text_col)), F.col(text_col).alias("text"))
    spans = repeated_spans(docs, length, anchor, batches)
    spans = spans.groupBy("doc_id", "h").agg(F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            removed, spans, kept = [], [], []
            for i, (starts, lengths) in enumerate(zip(batch.column("starts"), batch.column("lengths"))):
                text = data[offsets[i] : offsets[i + 1]]
                if not starts.is_valid:
                    removed.append(0), spans.append([]), kept.append(text.tobytes())
                    continue
                gone = np.zeros(len(text) + 2, np.int32)
                np.add.at(gone, starts.values.to_numpy() + 1, 1)
                np.add.at(gone, starts.values.to_numpy() + lengths.values.to_numpy() + 1, -1)
                gone = np.cumsum(gone) > 0
                edges = np.flatnonzero(gone[1:] != gone[:-1])
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                removed.append(int(gone.sum())), kept.append(text[~gone[1:-1]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )

    joined = docs.join(spans, same_row(docs, spans), "left").select(docs["doc_id"], "text", "starts", "lengths")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))
