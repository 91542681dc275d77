import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trackloom.llm.substring import op3_substring_dedup, repeated_spans, keyed, without_repeats

SCHEMA = "doc_id long, text string, start int, mh long"


def brute(rows, window):
    first, out = {}, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if doc_id is not None and first.setdefault(key, doc_id) < doc_id:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), kept.decode()))
    return sorted(out, key=repr)


def run(spark, rows, window, anchor):
    df = spark.createDataFrame([(a, b, 7, None) for a, b in rows], SCHEMA)
    return sorted((tuple(r) for r in without_repeats(df, window, anchor=anchor).collect()), key=repr)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=25).map(" ".join), max_size=8))
def test_words_of_small_alphabets(spark, texts):
    rows = list(enumerate(texts))
    assert run(spark, rows, 5, 2) == brute(rows, 5)


def test_edge_cases(spark):
    long = " ".join(f"w{i % 9973}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, long), (9, "x y " + long), (4, "a b c d e f"), (5, "z a b c d e\tq"), (4, "a b c d e f"), (None, "a b c d e f"), (7, " \n a  b c\x0bd e ")]
    assert run(spark, rows, 5, 2) == brute(rows, 5)
    assert run(spark, rows, 50, 12) == brute(rows, 50)
    assert run(spark, [], 5, 2) == []


def test_sources(spark):
    df = keyed(spark.createDataFrame([(3, "a b c d e f"), (8, "q a b c d e"), (9, "q a b c d e")], "doc_id long, text string"), "doc_id", "text")
    assert {(r.doc_id, r.src_doc_id) for r in repeated_spans(df, 5, 2).collect()} == {(8, 3), (9, 8)}  # 8 has all that 9 has


def test_query(spark, sf):
    from pyspark.sql import functions as F

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in brute(docs, 50)]
    assert sorted(map(tuple, op3_substring_dedup(spark, sf).orderBy(F.col("doc_id")).collect()), key=repr) == want
