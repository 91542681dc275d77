"""Operator 3, substring dedup by compaction of a de Bruijn graph of token k-mers.

Every run of `window` words is an edge of the graph. Edges are held as super-k-mers: the longest runs of
consecutive edges that share a minimizer, so one row stands for about twenty edges of a path. A minimizer that only
ever stands in one super-k-mer is a path without branches and stays compact: its copies are settled by one join. Where
paths branch (a passage begins or ends, a copy was edited), the super-k-mers are spelled out into single edges, and a
second join settles those. Rows are checked by hashes of the words under them (64 bits beside the 64 bits of the
minimizer); source coordinates (doc_id and word) name the passage that each span repeats.

The smaller side of each join is written first, so that both sides are plain exchanges which Spark may split where a
minimizer or an edge is very frequent. Nothing is gathered: every step is an aggregation with map-side combine or a join that Spark may split, so a
passage that stands in a third of all documents is one row for each task that has seen it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import arrow_batches, chunks, row_key, same_row, stored, utf8
from trackloom.llm.hashing import Prefixes, super_runs, words_of

#: Words of a minimizer: of a window, the run of so many words with the least hash.
ANCHOR = 12

_RUNS = "doc_id long, h int, mh long, sh long, start int, n int"
_RUNS_ARROW = pa.schema([("doc_id", pa.int64()), ("h", pa.int32()), ("mh", pa.int64()), ("sh", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
_EDGES_ARROW = pa.schema([("doc_id", pa.int64()), ("h", pa.int32()), ("mh", pa.int64()), ("wh", pa.int64()), ("start", pa.int32())])


def super_kmers(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """One row for each super-k-mer of docs(doc_id, h, text)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids, h = (batch.column(c) for c in ("doc_id", "h"))
            for a, b in chunks(offsets):
                found = super_runs(*words_of(data, offsets[a : b + 1]), window, anchor)
                rows = pa.array(found["row"] + a)
                yield from arrow_batches({**found, "doc_id": ids.take(rows), "h": h.take(rows)}, _RUNS_ARROW)

    return docs.mapInArrow(runs, _RUNS)


def spelled_out(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """The single edges of runs(doc_id, h, mh, start, n): their place and the hash of their words."""
    lists = runs.groupBy("doc_id", "h").agg(F.collect_list("mh").alias("mh"), F.collect_list("start").alias("start"), F.collect_list("n").alias("n"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets):
                symbols, places = words_of(data, offsets[a : b + 1])
                prefixes = Prefixes(symbols)
                row, mh, start, n = [], [], [], []
                for i in range(a, b):
                    lists = [batch.column(c)[i].values.to_numpy() for c in ("mh", "start", "n")]
                    row.append(np.repeat(i, len(lists[0]))), mh.append(lists[0]), start.append(lists[1] + places[i - a]), n.append(lists[2])
                row, mh, start, n = (np.concatenate(x) for x in (row, mh, start, n))
                each = np.repeat(np.arange(len(n)), n)
                at = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                rows = row[each]
                yield from arrow_batches(
                    {
                        "doc_id": batch.column("doc_id").take(pa.array(rows)),
                        "h": batch.column("h").take(pa.array(rows)),
                        "mh": mh[each],
                        "wh": prefixes.hashes(at, at + window).view(np.int64),
                        "start": at - places[rows - a],
                    },
                    _EDGES_ARROW,
                )

    joined = docs.join(lists, same_row(docs, lists)).select(docs["doc_id"], docs["h"], "text", "mh", "start", "n")
    return joined.mapInArrow(edges, "doc_id long, h int, mh long, wh long, start int")


def repeated_spans(docs: DataFrame, window: int = 50, anchor: int = ANCHOR) -> DataFrame:
    """Spans of words of docs(doc_id, h, text) under windows that also start in a document with a smaller doc_id.

    Returns (doc_id, h, start, length, src_doc_id): words start .. start + length of that row stand in document
    src_doc_id < doc_id: the smallest that has the whole span. Spans may overlap and touch.
    """
    anchor = min(anchor, window)
    runs = stored(super_kmers(docs, window, anchor))
    shared = stored(runs.groupBy("mh").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("mh"))
    runs = stored(runs.join(shared, "mh", "left_semi"))
    paths = stored(runs.groupBy("mh", "sh").agg(F.min("doc_id").alias("src_doc_id")))
    forks = stored(paths.groupBy("mh").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("mh", F.lit(True).alias("fork")))
    known = stored(runs.join(paths, ["mh", "sh"]).join(forks, "mh", "left"))
    whole = known.filter("src_doc_id < doc_id").select("doc_id", "h", "start", (F.col("n") + window - 1).alias("length"), "src_doc_id")
    edges = stored(spelled_out(docs, known.filter("src_doc_id = doc_id and fork").select("doc_id", "h", "mh", "start", "n"), window))
    first = stored(edges.groupBy("mh", "wh").agg(F.min("doc_id").alias("src_doc_id"), F.max("doc_id").alias("b")).filter("src_doc_id < b").drop("b"))
    single = edges.join(first, ["mh", "wh"]).filter("src_doc_id < doc_id")
    return whole.unionByName(single.select("doc_id", "h", "start", F.lit(window).alias("length"), "src_doc_id"))


def keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(*row_key(F.col(id_col).cast("long"), F.col(text_col)), F.col(text_col).alias("text"))


def without_repeats(documents: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", anchor: int = ANCHOR) -> DataFrame:
    """documents without the words that an earlier document (by doc_id) has in a run of `window` words.

    Returns (doc_id, n_words, n_removed, kept): kept is the words left, joined by one space. Further columns of
    the input are ignored, whatever their names. A null text has no words. A row whose doc_id is null keeps all
    words and is nobody's source. Rows with one doc_id are one document as far as sources go: they don't repeat each other.
    An empty table gives an empty result. A very long text is worked on in one task, as arrays of its words.
    """
    docs = keyed(documents, id_col, text_col)
    spans = repeated_spans(docs, window, anchor)
    spans = spans.groupBy("doc_id", "h").agg(F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            columns = (batch.column(c) for c in ("text", "starts", "lengths"))
            for text, starts, lengths in zip(*columns):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                if starts.is_valid:
                    gone = np.zeros(len(words) + 1, np.int32)
                    np.add.at(gone, starts.values.to_numpy(), 1)
                    np.add.at(gone, starts.values.to_numpy() + lengths.values.to_numpy(), -1)
                    stay = np.cumsum(gone)[:-1] == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    joined = docs.join(spans, same_row(docs, spans), "left").select(docs["doc_id"], "text", "starts", "lengths")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
