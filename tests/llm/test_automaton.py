import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trackloom.llm.automaton import Automaton, ByteDecoder, ByteTokenizer, decoded, encoded, op11_bpe_automaton

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return ByteTokenizer(PATH), ByteDecoder(PATH), Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def same(both, text):
    ours, decoder, theirs = both
    ids = ours.encode(text)
    want = ids_of(theirs, text)
    assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
    assert decoder.decode(ids) == theirs.decode(want, skip_special_tokens=False)


def by_merging(word, merges):
    """The merges one after another, each from the left."""
    tokens = list(word)
    for u, v, uv in merges:
        i = 0
        while i < len(tokens) - 1:
            if (tokens[i], tokens[i + 1]) == (u, v):
                tokens[i : i + 2] = [uv]
            i += 1
    return tokens


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_any_merges(data):
    """Random merges of three letters, also such that never apply."""
    labels, merges = {0: b"a", 1: b"b", 2: b"c"}, []
    for _ in range(data.draw(st.integers(0, 12))):
        u, v = data.draw(st.sampled_from(sorted(labels))), data.draw(st.sampled_from(sorted(labels)))
        if labels[u] + labels[v] not in labels.values():
            merges.append((u, v, len(labels)))
            labels[len(labels)] = labels[u] + labels[v]
    automaton = Automaton(labels, merges)
    for word in data.draw(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=14), min_size=1, max_size=5)):
        assert automaton.encode(b"".join(labels[x] for x in word)) == by_merging(word, merges)


def test_odd_texts(both):
    for text in ("", " ", "a", "\n\n  x\t", "I'll don't 'S 12345 ½ ²", "<|endoftext|>", "a<|endoftext|><|endoftext|> <|endoftext", "naïve 日本語 ไทย é é ​﻿ \x00\x1c\x1d\x85 x", "aaaa" * 1000, " " * 5000, "\U0001f600" * 50, "x" * 100_000 + "12" * 5000):
        same(both, text)


def test_every_character(both):
    """The split of words knows each character as the library does."""
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 500):
        same(both, "".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}x  " for c in points[at : at + 500]))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_random_texts(both, text):
    same(both, text)


def test_random_letters(both):
    rng = random.Random(7)
    for _ in range(3000):
        same(both, "".join(rng.choice("etaoin shrdlu ETA.,'\n0é") for _ in range(rng.randrange(1, 60))))


def test_tables(spark):
    rows = [(1, None), (2, ""), (2, "twice twice"), (None, "no id <|endoftext|>"), (5, "word " * 200_000)]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, ids string, n_tokens int")
    got = decoded(encoded(df, PATH), PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((a, b or "") for a, b in rows), key=repr)
    assert encoded(df.limit(0), PATH).collect() == []
    broken = spark.createDataFrame([(1, bytearray(np.array([0x80, 188], "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    assert [r.text for r in decoded(broken, PATH).sort("doc_id").collect()] == [Tokenizer.from_file(PATH).decode([0x80, 188], skip_special_tokens=False), None]


def test_query(spark, sf):
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = ids_of(tokenizer, r.text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, op11_bpe_automaton(spark, sf).collect())) == sorted(want)
