import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trackloom.llm.packing import op8_best_fit_packing, pack_documents, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths, capacity):
    """One piece after another, longest first; returns the rooms left."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@given(st.lists(st.integers(1, 20), max_size=120))
def test_plan_is_best_fit(lengths):
    filled, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, sequence, each, at in plan(Counter(lengths), 20):
        for k in range(n):
            filled[sequence + k // each].append((at + k % each * length, length))
            ranks[length].append(rank + k)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in Counter(lengths).items()}
    for places in filled.values():
        at = 0
        for start, length in sorted(places):
            assert start == at
            at += length
        assert at <= 20
    assert sorted(20 - sum(n for _, n in p) for p in filled.values()) == best_fit(lengths, 20)


def check(rows, docs, capacity, places=True):
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc_id, i, s, min(capacity, len(ids) - s), zlib.crc32(ids[s : s + capacity].tobytes())) for i, s in enumerate(range(0, len(ids), capacity))]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for start, length in sorted(places):
            assert start == at
            at += length
        assert at <= capacity
    assert len(filled) == len(best_fit([w[3] for w in want], capacity))


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "word " * 100), (None, "a b\x1cc İΣ ΑΣ é x's don't 12"), (4, "<|endoftext|> hi"), (4, "<|endoftext|> hi"), (5, "x y　z\u0085q ß ﬁ " + "é" * 50)]
    docs += [(6, "H\u0331 A\u030a I\u0307 a, b. c., D. \x01 x\x01y, ., it's. \x01"), (7, "\u3000 a"), (8, "Σ, ΑΣ. ΣΑ q.. w,x, É, 1, 2.")]
    df = spark.createDataFrame([(a, b, 3, 4) for a, b in docs], "doc_id long, text string, length int, rank int")
    check(pack_documents(df, PATH, 16).collect(), docs, 16)
    assert pack_documents(df.limit(0), PATH, 16).collect() == []


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(op8_best_fit_packing(spark, sf).collect(), docs, 2048)
