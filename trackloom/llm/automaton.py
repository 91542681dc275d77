"""Operator 11, byte-pair encoding and decoding by an automaton over tokens.

The automaton reads tokens, and accepts a row of tokens exactly if it is how the merges leave some text. It starts with one
state and an arc for each byte, and takes in one merge after another: for a merge of u and v, all arcs u get as their target a copy of it that has
no arc v, so that u is no longer followed by v, and whoever has an arc u gets an arc uv to where v leads. All arcs
of a token have the same target, which so stands for the token, and a copy differs from what it was copied from
by the arc that it lost. That is all that is held: for each state the merge that made it, and what it is a copy of.

A word is encoded by going along arcs whose labels it begins with, the longest first, and back where none goes on. The merges leave each beginning
of a word as one row of tokens, so each place in it is reached by one path only, and a place that leads nowhere is left for good: the steps are at most
as many as bytes times lengths of tokens. Arcs that were asked for are kept in a table, and words with their ids, so that most of a text is looked up. Decoding goes
along the arcs again and emits their labels.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, and arcs, that a Python worker keeps; then those that were not asked for since as many others came go.
KNOWN = 200_000
#: Characters of the longest word that is kept.
KEPT = 64
#: The split of words before merges, which files of this kind imply.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that stand for themselves in the file; the others follow, in order, from 256 on.
_SHOWN = (*range(33, 127), *range(161, 173), *range(174, 256))


class Automaton:
    """Tokens are numbered as in the file. made[t] is the merge that made a token, -1 for a byte; state 0 is the start."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        """labels: the bytes of each token; merges: (u, v, uv) in order. Each token is a byte or made by one merge."""
        self.labels = labels
        self.made = {t: -1 for t, label in labels.items() if len(label) == 1}
        self.left: dict[int, int] = {}
        self.alive = set(self.made)  # tokens that have arcs
        # of each state: the merge that made it, and the token whose arcs lead to it
        self.since, self.owner = [-1], [-1]
        self.first = dict.fromkeys(self.made, 0)  # the state that a token's arcs led to at first
        self.states: dict[int, list[int]] = {t: [] for t in self.made}  # those that they led to later on
        self.lost: dict[tuple[int, int], int] = {}  # the merge by which u lost its arc v
        self.arcs: dict[tuple[int, int], bool] = {}
        for i, (u, v, uv) in enumerate(merges):
            self.gadget(i, u, v, uv)
        self.arcs.clear()
        self.of_label = {label: t for t, label in labels.items() if t in self.alive}
        self.leads = {t: self.state(t) for t in self.alive}
        # by their first two bytes, how long tokens can be, longest first
        found: dict[bytes, set[int]] = {}
        for label in self.of_label:
            found.setdefault(label[:2], {1}).add(len(label))
        self.lengths = {start: tuple(sorted(x, reverse=True)) for start, x in found.items()}

    def state(self, token: int) -> int:
        """Where all arcs of a token lead."""
        return self.states[token][-1] if self.states[token] else self.first[token]

    def gadget(self, i: int, u: int, v: int, uv: int) -> None:
        if uv in self.made:
            raise ValueError(f"two merges make token {uv}")
        self.made[uv], self.left[uv], self.states[uv], self.first[uv] = i, u, [], 0
        if u not in self.alive or v not in self.alive or not self.has_arc(self.state(u), v):
            return  # no text has u before v by now
        copy = len(self.since)
        self.since.append(i), self.owner.append(u)
        self.lost[u, v] = i
        self.first[uv] = self.state(v)  # if u and v are one token, where it led before: after uv another one may follow
        self.states[u].append(copy)
        self.alive.add(uv)

    def has_arc(self, state: int, token: int) -> bool:
        """Whether a token may follow: as soon as the later one of the two, the state and the token, is taken back to what it was made from."""
        key, found = (state, token), self.arcs.get((state, token))
        if found is not None:
            return found
        while True:
            if token not in self.alive:
                found = False
                break
            if state == 0:
                found = True
                break
            u, since, made = self.owner[state], self.since[state], self.made[token]
            lost = self.lost.get((u, token))
            if lost is not None and lost <= since:
                found = False
                break
            chain = self.states[u]
            if self.since[chain[0]] <= made:
                # the last state of u that is not later than the token has its arc if it has that of the token's left part
                state = chain[bisect_right(chain, min(made, since), key=self.since.__getitem__) - 1]
                token = self.left[token]
            else:
                state = self.first[u]
        if len(self.arcs) >= KNOWN:
            self.arcs.clear()
        self.arcs[key] = found
        return found

    def encode(self, word: bytes) -> list[int]:
        """The one accepted row of tokens whose labels make up the word."""
        whole = self.of_label.get(word)
        if whole is not None:
            return [whole]
        n, tokens, steps, failed = len(word), [], [], set()
        at, state, lengths = 0, 0, iter(self.lengths.get(word[:2], (1,)))
        while at < n:
            for length in lengths:
                end = at + length
                if end > n or end in failed:
                    continue
                token = self.of_label.get(word[at:end])
                if token is None:
                    continue
                arc = self.arcs.get((state, token))
                if arc or arc is None and self.has_arc(state, token):
                    steps.append((at, state, lengths)), tokens.append(token)
                    at, state, lengths = end, self.leads[token], iter(self.lengths.get(word[end : end + 2], (1,)))
                    break
            else:
                # no row of tokens goes on from here, whatever follows; only one leads here, so nothing else has to come back
                failed.add(at)
                if not steps:
                    raise ValueError(f"no tokens for {word[:40]!r}")
                (at, state, lengths), _ = steps.pop(), tokens.pop()
        return tokens


def token_labels(held: dict) -> tuple[dict[str, int], dict[int, bytes], dict[str, int]]:
    """Of a tokenizer's file: tokens by their text there, the bytes of each, and special tokens by their text."""
    hidden = [b for b in range(256) if b not in _SHOWN]
    byte_of = {chr(b): b for b in _SHOWN} | {chr(256 + k): b for k, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in held["added_tokens"]}
    ids = {w: t for w, t in held["model"]["vocab"].items() if w not in special}
    return ids, {t: bytes(byte_of[c] for c in w) for w, t in ids.items()}, special


class ByteDecoder:
    """Decoding of whole texts by a tokenizer's JSON file: the labels of its arcs alone."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            _, labels, special = token_labels(json.load(f))
        self.labels = labels | {t: w.encode() for w, t in special.items()}

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class ByteTokenizer:
    """Encoding of whole texts by a tokenizer's JSON file of byte-level merges without normalizer or prefix space."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, split = held["model"], held["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or held["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} is not a byte-level tokenizer as this one reads them")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in held["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take more than their own text")
        ids, labels, special = token_labels(held)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.path = path
        self.automaton = Automaton(labels, [(ids[a], ids[b], ids[a + b]) for a, b in pairs])
        self.words = regex.compile(WORDS)
        # the longest of several that begin at one place
        self.special = regex.compile("(" + "|".join(regex.escape(w) for w in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.special_ids = {w: np.array([t], "<u4").tobytes() for w, t in special.items()}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        found = self.older.get(word) or np.array(self.automaton.encode(word.encode()), "<u4").tobytes()
        if len(word) <= KEPT:
            if len(self.known) >= KNOWN:
                self.known, self.older = {}, self.known
            self.known[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = []
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                out.append(self.special_ids[part])
            else:
                out += [self.known.get(w) or self.word(w) for w in self.words.findall(part)]
        return b"".join(out)


_known: dict[type, ByteTokenizer | ByteDecoder] = {}


def of_worker(kind: type, path: str):
    """One tokenizer or decoder for each worker process, which serves all its tasks."""
    if kind not in _known or _known[kind].path != path:
        _known[kind] = kind(path)
    return _known[kind]


def encoded(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): whole texts as ids, in 4 bytes each, little-endian. Special tokens in a text have their own ids. A null text is empty; a very long one is
    encoded in time proportional to its length, however its words are. Rows that repeat an id are encoded like all others, a null one too; an empty table gives an
    empty result. Further columns are ignored, whatever their names."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = of_worker(ByteTokenizer, tokenizer)
        for batch in batches:
            ids = [known.encode(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "doc_id long, ids binary")


def decoded(rows: DataFrame, tokenizer: str) -> DataFrame:
    """rows(doc_id, ids) with the text that their ids stand for, special tokens as they are written. Null ids give a null text; bytes that
    are no UTF-8 become replacement characters."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = of_worker(ByteDecoder, tokenizer)
        for batch in batches:
            texts = [known.decode(i.as_py()) if i.is_valid else None for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids binary, text string")


def op11_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = decoded(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    n = (F.octet_length("ids") / 4).cast("long")
    return rows.select("doc_id", n.alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("text"), 256).alias("decoded_sha256"))
