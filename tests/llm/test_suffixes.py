import hashlib
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trackloom.llm.suffixes import op5_suffix_array_dedup, without_repeats


def brute(rows, length):
    texts = [(a, (b or "").encode()) for a, b in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc_id, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def run(spark, rows, length, anchor):
    df = spark.createDataFrame([(a, b, 1, None) for a, b in rows], "doc_id long, text string, k int, sh long")
    return sorted(((r[0], r[1], r[2], len(r[3]), bytes(r[4])) for r in without_repeats(df, length, anchor=anchor).collect()), key=repr)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("aéb", max_size=40), max_size=8))
def test_bytes_of_small_alphabets(spark, texts):
    rows = list(enumerate(texts))
    assert run(spark, rows, 6, 2) == brute(rows, 6)


def test_edge_cases(spark):
    long = "".join(chr(97 + i * i % 23 % 7) for i in range(5000))
    rows = [(1, None), (2, ""), (3, long), (3, "abcdefgh"), (4, "xabcdefg"), (None, "abcdefgz"), (None, None), (5, "qqqqqqqqqq"), (6, "same row here"), (6, "same row here")]
    assert run(spark, rows, 6, 3) == brute(rows, 6)
    assert run(spark, [], 6, 3) == []


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(a, b, c, d, hashlib.sha256(e).hexdigest()) for a, b, c, d, e in brute(docs, 400)]
    assert sorted(map(tuple, op5_suffix_array_dedup(spark, sf).collect())) == sorted(want)
