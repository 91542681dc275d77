"""Operator 1, toxicity by bags of subwords.

A word is the bag of its byte n-grams and itself; each has an embedding in a hashed table. The embeddings of a few
neighbouring words are averaged into a linear softmax, and a document is as toxic as its most toxic neighbourhood, so
that one insult counts alike in a short text and in a long one. Embeddings and softmax are trained jointly in numpy, on
a bounded sample of labelled rows; a misspelt or inflected word shares n-grams with those seen and so its score.

The softmax is linear, so after training an n-gram adds a fixed number to the difference of both classes' logits. Texts
are scored with that one number for each entry of the table, where they are read: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm.common import chunks, stored, utf8
from trackloom.llm.hashing import BYTE_VALUES, Prefixes, lowered, word_spans

#: Lengths of n-grams in bytes, entries of the table (a power of two), and an embedding's length.
GRAMS, TABLE, SIZE = (3, 4, 5, 6), 1 << 18, 12
#: Words of a neighbourhood.
NEAR = 5
#: Bounds of the training sample: rows of either label, and bytes of text in all, of which each label may have half.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_BYTES = 1500, 2000, 12_000_000
#: Rounds of training, and steps in each.
EPOCHS, BATCHES = 12, 50


_LOWER = lowered(np.arange(256, dtype=np.uint8))
_LOWER[[9, 10, 11, 12, 13]] = 32
_SPREAD, _HIGH = np.uint64(0xD6E8FEB86659FD93), np.uint64(64 - TABLE.bit_length() + 1)


def entries(raw: np.ndarray) -> np.ndarray:
    return ((raw * _SPREAD) >> _HIGH).astype(np.int32)


class Bags:
    """The n-grams of a few texts: word scores from the table's numbers, and their gradients back."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        # a blank before and after each text, so that n-grams tell where a word begins and ends
        at = offsets - offsets[0]
        data = _LOWER[np.insert(data[offsets[0] : offsets[-1]], at, 32)]
        at = at + np.arange(len(at))
        starts, ends = word_spans(data, at)
        self.places = np.searchsorted(starts, at)
        prefixes = Prefixes(BYTE_VALUES[data])
        self.grams = [entries(prefixes.raw(np.arange(len(data) - n + 1), np.arange(n, len(data) + 1))) if len(data) >= n else np.zeros(0, np.int32) for n in GRAMS]
        self.whole = entries(prefixes.raw(starts - 1, ends + 1))
        self.starts, self.ends = starts.astype(np.int32), ends.astype(np.int32)
        self.size = 1.0 + sum(b - a for _, a, b in self.spans())

    def spans(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length the entries of all n-grams, and of each word the first and the end of its own."""
        for n, grams in zip(GRAMS, self.grams):
            first = np.minimum(self.starts - 1, len(grams))
            yield grams, first, np.minimum(np.maximum(self.ends + 2 - n, first), len(grams))

    def words(self, numbers: np.ndarray) -> np.ndarray:
        """The mean of the numbers of each word's n-grams."""
        total = numbers[self.whole].astype(float)
        for grams, a, b in self.spans():
            sums = np.zeros(len(grams) + 1)
            np.cumsum(numbers[grams], out=sums[1:])
            total += sums[b] - sums[a]
        return total / self.size

    def back(self, gradient: np.ndarray) -> np.ndarray:
        """The table's gradient from that of the words' means."""
        gradient = gradient / self.size
        out = np.bincount(self.whole, gradient, TABLE)
        for grams, a, b in self.spans():
            if not len(grams):
                continue
            each = np.zeros(len(grams) + 1)
            np.add.at(each, a, gradient)
            np.add.at(each, b, -gradient)
            each = np.cumsum(each[:-1])
            used = np.flatnonzero(np.abs(each) > 1e-12)
            out += np.bincount(grams[used], each[used], TABLE)
        return out

    def neighbourhoods(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word the mean over it and the NEAR - 1 words after it in its text; the first and the end word of each."""
        row_end = np.repeat(self.places[1:], np.diff(self.places))
        # of a text's last words, the neighbourhood is the last full one
        row_start = np.repeat(self.places[:-1], np.diff(self.places))
        first = np.maximum(np.minimum(np.arange(len(words)), row_end - NEAR), row_start)
        end = np.minimum(first + NEAR, row_end)
        sums = np.concatenate([[0.0], np.cumsum(words)])
        return (sums[end] - sums[first]) / (end - first), first, end

    def most(self, numbers: np.ndarray) -> np.ndarray:
        """The largest mean of each text's neighbourhoods; 0 for a text without words."""
        near, _, _ = self.neighbourhoods(self.words(numbers))
        out, full = np.zeros(len(self.places) - 1), np.diff(self.places) > 0
        if full.any():
            out[full] = np.maximum.reduceat(near, self.places[:-1][full])
        return out


@dataclass
class Model:
    """numbers: what each entry of the table adds; bias: of the difference of both logits; empty: score without words."""

    numbers: np.ndarray
    bias: float
    empty: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bags = Bags(data, offsets)
        score = 1 / (1 + np.exp(-np.clip(bags.most(self.numbers) + self.bias, -50, 50)))
        return np.where(np.diff(bags.places) > 0, score, self.empty)


def trained(texts: pa.Array, toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Embeddings and softmax, from random ones, together by Adagrad. The neighbourhoods of a text share its gradient by a softmax over them, which
    sharpens until the most toxic ones have it alone. With one class only, every score is 0 or 1."""
    if len(set(toxic.tolist())) < 2:
        constant = float(toxic[0]) if len(toxic) else 0.0
        return Model(np.zeros(TABLE, np.float32), 50.0 if constant else -50.0, constant)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.02, (TABLE, SIZE))
    softmax = rng.normal(0, 0.2, (SIZE, 2))
    bias = np.zeros(2)
    steps = [np.full(x.shape, 1e-8) for x in (table, softmax, bias)]
    data, offsets = utf8(texts)
    weight = np.where(toxic == 1, 0.5 / (toxic == 1).mean(), 0.5 / (toxic == 0).mean())  # both labels weigh alike
    ranges = list(chunks(offsets, int(offsets[-1] - offsets[0]) // BATCHES + 1))
    batches = [Bags(data, offsets[a : b + 1]) for a, b in ranges]
    for epoch in range(epochs):
        sharp = 1.0 + epoch
        for i in rng.permutation(len(batches)):
            bags, (a, b) = batches[i], ranges[i]
            full = np.flatnonzero(np.diff(bags.places) > 0)
            if not len(full):
                continue
            w = softmax[:, 1] - softmax[:, 0]
            near, first, end = bags.neighbourhoods(bags.words(table @ w))
            at, counts = bags.places[:-1][full], np.diff(bags.places)[full]
            top = np.maximum.reduceat(near, at)
            share = np.exp(sharp * (near - np.repeat(top, counts)))
            share /= np.repeat(np.add.reduceat(share, at), counts)
            logit = np.add.reduceat(share * near, at) + bias[1] - bias[0]
            error = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - toxic[a:b][full]) * weight[a:b][full] / len(full)
            each = np.repeat(error, counts) * share / (end - first)
            words = np.zeros(len(near) + 1)
            np.add.at(words, first, each)
            np.add.at(words, end, -each)
            g = bags.back(np.cumsum(words[:-1]))
            used = np.flatnonzero(g)
            ds = table[used].T @ g[used]
            db = error.sum()
            dt = g[used, None] * w
            steps[0][used] += dt**2
            table[used] -= 0.15 * dt / np.sqrt(steps[0][used])
            for x, dx, s, rate in ((softmax, np.stack([-ds, ds], axis=1), steps[1], 0.1), (bias, np.array([-db, db]), steps[2], 0.1)):
                s += dx**2
                x -= rate * dx / np.sqrt(s)
    numbers = (table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
    return Model(numbers, float(bias[1] - bias[0]), float(toxic.mean()))


def labelled_sample(documents: DataFrame, labels: DataFrame, keep) -> DataFrame:
    """(order, doc_id, text, toxic) of at most TOXIC_ROWS and CLEAN_ROWS labelled rows with a text and half of SAMPLE_BYTES each, chosen by a hash of doc_id.

    Labels of one doc_id that disagree count as toxic; of rows that repeat a doc_id one is taken. Of each label the shortest
    texts go in first, so that a long one costs only itself; of a label none of whose texts fits, the beginning of the shortest goes in. Ids are chosen
    before texts are read, so that texts stay where they are.
    """
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & keep(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    ids = ids.filter("toxic = 1").orderBy(order, "doc_id").limit(TOXIC_ROWS).union(ids.filter("toxic = 0").orderBy(order, "doc_id").limit(CLEAN_ROWS))
    rows = documents.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic").filter("text is not null")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.octet_length("text"), F.xxhash64("text"))).alias("text"))
    rows = stored(rows.withColumn("order", F.xxhash64("doc_id", "text")).withColumn("bytes", F.octet_length("text")))
    shortest = W.partitionBy("toxic").orderBy("bytes", "order", "doc_id")  # the bounded sample alone
    rows = rows.withColumn("total", F.sum("bytes").over(shortest)).withColumn("rank", F.row_number().over(shortest))
    most = SAMPLE_BYTES // 2
    # a character has four bytes at most
    rows = rows.withColumn("text", F.when(F.col("bytes") > most, F.substring("text", 1, most // 4)).otherwise(F.col("text")))
    return rows.filter((F.col("total") <= most) | (F.col("rank") == 1)).select("order", "doc_id", "text", "toxic")


def held_in(doc_id):
    return F.crc32(doc_id.cast("string")) % 3 != 1


def fitted(documents: DataFrame, labels: DataFrame, keep=held_in) -> Model:
    """The model of a sample of labelled documents. One task trains it, whose input is bounded, so that the driver holds
    the model alone; a lost executor only means that another one trains it again, with the same result."""
    sample = labelled_sample(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")), keep)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("order", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int32())])).combine_chunks()
        texts = table.column("text").chunk(0) if table.num_rows else pa.array([], pa.string())
        model = trained(texts, table.column("toxic").to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([model.numbers.astype(np.float32).tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.empty])], names=["numbers", "bias", "empty"])

    # labels and lengths mixed, for training
    rows = sample.coalesce(1).sortWithinPartitions("order", "doc_id").mapInArrow(train, "numbers binary, bias double, empty double").collect()
    numbers, bias, empty = rows[0] if rows else (np.zeros(TABLE, np.float32).tobytes(), -50.0, 0.0)
    return Model(np.frombuffer(numbers, np.float32), bias, empty)


def scored(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """documents with `score`, from 0 to 1; columns of the input stay, but for one named score.

    A text without words, empty or null, gets the share of toxic rows in the training sample. Very long texts are scored whole, in
    parts of a batch of their own. Rows that repeat an id are scored each; an empty table gives an empty result.
    """
    columns = [c for c in documents.columns if c != "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text_col))
            parts = [model.scores(data, offsets[a : b + 1]) for a, b in chunks(offsets, 500_000)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else [], pa.float64())], names=[*columns, "score"])

    out = documents.select(*columns)
    return out.mapInArrow(score, T.StructType([*out.schema, T.StructField("score", T.DoubleType())]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fitted(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(documents.select("doc_id", "text"), model)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
