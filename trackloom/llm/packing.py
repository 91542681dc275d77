"""Operator 8, best-fit packing planned on the histogram of lengths.

How documents are packed depends on their lengths alone, and there are at most `capacity` lengths. So the plan is made
for counts: longest first, each length fills the fullest sequences that still have room, many equal ones at a time. The
plan's rows say which ranks of a length go to which sequences, and pieces take their slots by joining on their rank
within their length. The histogram (at most `capacity` rows) is all that the driver sees, whatever the size of the input.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm.common import stored

#: Distinct words that a Python worker keeps with their ids, about 150 bytes each; then it forgets the later half, as frequent words come early.
KNOWN_WORDS = 1_000_000
#: Parts in which the ranks of a length are counted, so that a frequent length is no single task's work.
RANK_PARTS = 256


class WordIds(dict):
    """Words, which are UTF-8 without ASCII white space, to their ids as bytes, special tokens in the text included. Right for tokenizers that lower case, drop
    white space, never join what it parts, and part letters from marks: the ids of a text are then those of its words in a row."""

    #: Stands between words that are encoded in one go; its ids tell where each word ends. Words that hold it go alone.
    BETWEEN = b"\x01"
    #: Special tokens hold it, which are found as they are written, before lower case. Words with it go alone, too.
    SPECIAL = b"<|"

    def __init__(self, path: str, most: int | None = None):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread would keep memory of its own
        from tokenizers import Tokenizer

        self.path, self.most, self.tokenizer = path, most or KNOWN_WORDS, Tokenizer.from_file(path)
        (self.between,) = self.encoded([self.BETWEEN])[0]
        self.marks = {m: np.array(self.encoded([bytes([m])])[0], "<u4").tobytes() for m in b",."}

    def encoded(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words that are not known. They are kept for later texts, if they are not too many for that; what was known goes when it is."""
        # a comma or full stop after a letter is a token of its own
        stems = {w: w[:-1] if len(w) > 1 and w[-1] in self.marks and 97 <= w[-2] <= 122 else w for w in words}
        found = {w: self[w] for w in stems.values() if w in self}
        new = [w for w in dict.fromkeys(stems.values()) if w not in found]
        groups = [new[at : at + 200] for at in range(0, len(new), 200)]
        alone = {w for w in new if self.BETWEEN in w or self.SPECIAL in w}
        groups = [[w for w in g if w not in alone] for g in groups] + [[w] for w in new if w in alone]
        for group, ids in zip(groups, self.encoded([(b" " + self.BETWEEN + b" ").join(g) for g in groups])):
            ids = np.array(ids, "<u4")
            ends = [*(np.flatnonzero(ids == self.between) if len(group) > 1 else ()), len(ids)]
            raw, start = ids.tobytes(), 0
            for word, end in zip(group, ends):
                found[word], start = raw[4 * start : 4 * end], end + 1
        for word, stem in stems.items():
            if word is not stem:
                found[word] = found[stem] + self.marks[word[-1]]
        if len(self) + len(found) > self.most:
            for word in list(islice(self, self.most // 2, None)):
                del self[word]
        if len(self) + len(found) <= self.most:
            self.update(found)
        return found

    def ids(self, text: str) -> bytes:
        data = text.encode()
        if b"\xcc" not in data and b"\xcd" not in data:  # no combining marks, so A-Z may be lowered before they would compose
            words = data.lower().split() if self.SPECIAL not in data else [w if self.SPECIAL in w else w.lower() for w in data.split()]
        else:
            words = data.split()
        parts = list(map(self.get, words))
        if None in parts:
            found = self.learn(list({w for w, p in zip(words, parts) if p is None}))
            parts = [found[w] if p is None else p for w, p in zip(words, parts)]
        return b"".join(parts)


_known: WordIds | None = None


def word_ids(path: str, most: int | None = None) -> WordIds:
    """One table for each worker process, which serves all its tasks."""
    global _known
    if _known is None or (_known.path, _known.most) != (path, most or KNOWN_WORDS):
        _known = WordIds(path, most)
    return _known


def pieces_of(docs: DataFrame, ids_of: Callable[[str], bytes], capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs(doc_id, text): each document's ids and the end id, cut to pieces."""
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = ids_of(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, on counts. Rows (length, rank, n, sequence, each, offset): the n pieces of that length
    from `rank` on go to the sequences from `sequence` on, `each` to a sequence, the first one at `offset` there.

    One piece after another, best fit would fill a sequence with as many pieces of the length as it takes before
    it opens the next with the same room: so that many go in at once. Equal sequences are held as ranges.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free places: ranges of sequences, as (first, number)
    opened, out = 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def place(first: int, number: int, free: int) -> tuple[int, int]:
            """Fill a range of sequences; returns how many stay untouched and how many pieces went in."""
            each = free // length
            full, rest = divmod(min(left, number * each), each)
            at = capacity - free
            if full:
                out.append((length, rank, full * each, first, each, at))
                room.setdefault(free - each * length, []).append((first, full))
            if rest:
                out.append((length, rank + full * each, rest, first + full, rest, at))
                room.setdefault(free - rest * length, []).append((first + full, 1))
            return number - full - (rest > 0), full * each + rest

        for free in sorted(f for f in room if f >= length):
            ranges = room.pop(free)
            while ranges and left:
                first, number = ranges.pop()
                untouched, n = place(first, number, free)
                left, rank = left - n, rank + n
                if untouched:
                    ranges.append((first + number - untouched, untouched))
            if ranges:
                room.setdefault(free, []).extend(ranges)
            if not left:
                break
        if left:
            number = -(-left // (capacity // length))
            place(opened, number, capacity)
            opened += number
    return out


def ranked(pieces: DataFrame, parts: int) -> DataFrame:
    """pieces with `rank`, from 0 on within each length. Ranks are counted in `parts` parts of each length and then shifted."""
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(W.partitionBy("length").orderBy("part")) - F.col("k")
    inside = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    out = pieces.withColumn("inside", inside).join(stored(counts.withColumn("before", before).drop("k")), ["length", "part"])
    return out.withColumn("rank", F.col("inside") + F.col("before")).drop("part", "inside", "before")


def packed(pieces: DataFrame, capacity: int = 2048, parts: int = RANK_PARTS) -> DataFrame:
    """pieces(length, ...) with sequence_id and offset: gapless in each sequence, at most `capacity` tokens in each.

    Pieces of full length need no plan: each is a sequence. An empty table gives an empty result; equal rows are
    pieces of their own.
    """
    pieces = stored(pieces)
    histogram = {r["length"]: r["k"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("k")).collect()}
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    slots = pieces.sparkSession.createDataFrame(plan(histogram, capacity), "length long, first_rank long, n long, sequence long, each long, at long")
    slots = slots.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first_rank", "n", "sequence", "each", "at"))).alias("slots"))
    rows = ranked(pieces, parts).join(F.broadcast(slots), "length")  # at most `capacity` rows
    rows = rows.withColumn("slot", F.expr("filter(slots, s -> s.first_rank <= rank and rank < s.first_rank + s.n)[0]")).withColumn("k", F.expr("rank - slot.first_rank"))
    rows = rows.withColumn("sequence_id", F.expr("slot.sequence + k div slot.each")).withColumn("offset", F.expr("slot.at + (k % slot.each) * length"))
    return rows.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", known_words: int | None = None) -> DataFrame:
    """documents as pieces (doc_id, piece, start, length, ids_crc32) with their place (sequence_id, offset).

    A document's ids are those of the tokenizer's file and then end_id; only documents longer than `capacity` are
    cut. A null text is empty and thus one end id. Null ids and rows that repeat an id are packed like all others.
    A very long text is encoded in one task and cut into many pieces. An empty table gives an empty result. Further columns are ignored, whatever their names.
    A worker keeps the ids of `known_words` words (KNOWN_WORDS by default), which decides its memory and speed, not the result.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return packed(pieces_of(docs, lambda text: word_ids(tokenizer, known_words).ids(text), capacity, end_id), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
