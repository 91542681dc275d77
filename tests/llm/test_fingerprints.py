import hashlib
import re
import struct

import xxhash
from pyspark.sql import functions as F

from trackloom.llm.fingerprints import _ORDERS, as_text, compared, fingerprint, fingerprinted, likeness, op10_document_fingerprints


def hashes(text):
    words = [w for w in re.split(r"[ \t-\r]+", text or "") if w]
    words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    words = [w - 2**64 if w >= 2**63 else w for w in words]
    return [_chain(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def _chain(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
    return seed - 2**64 if seed >= 2**63 else seed


def brute(text):
    bins = [None] * 256
    for h in hashes(text):
        b = (h >> 56) + 128
        bins[b] = h if bins[b] is None else min(h, bins[b])
    if all(b is None for b in bins):
        return ""
    out = []
    for i in range(256):
        ask = [i] + [o[i] for o in _ORDERS]
        h = next((bins[b] for b in ask if bins[b] is not None), None)
        if h is None:
            h = min((_chain_int_long(i, b), bins[b]) for b in range(256) if bins[b] is not None)[1]
        out.append("0123456789abcdef"[_kept(h, i)])
    return "".join(out)


def _chain_int_long(i, b):
    seed = xxhash.xxh64_intdigest(struct.pack("<i", i), seed=42)
    seed = xxhash.xxh64_intdigest(struct.pack("<q", b), seed=seed)
    return seed - 2**64 if seed >= 2**63 else seed


def _kept(h, i):
    seed = xxhash.xxh64_intdigest(struct.pack("<q", h), seed=42)
    return xxhash.xxh64_intdigest(struct.pack("<i", i), seed=seed) & 15


TEXTS = [None, "", " \n", "one", "a b c d", "a b c d e", "a b  c\td e f", "é " * 30, " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(90_000))]


def test_bins_and_densification(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    got = {r.i: r.f for r in df.select("i", as_text(fingerprint(F.col("text"))).alias("f")).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [brute(t) for t in TEXTS]


def test_estimates(spark):
    rows = []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        for k in range(30):
            n = 700
            a, b = ([f"{k}-{share}-{i}" for i in range(n)], [f"{k}-{share}-{i}" if i < share * n else f"x{k}-{i}" for i in range(n)])
            rows.append((share, " ".join(a), " ".join(b)))
    got = spark.createDataFrame(rows, "share double, a string, b string").groupBy("share").agg(F.avg(likeness(fingerprint(F.col("a")), fingerprint(F.col("b")))).alias("x")).collect()
    for r in got:
        assert abs(r.x - r.share / (2 - r.share)) < 0.03


def test_short_texts_without_a_word_in_common(spark):
    rows = [(" ".join(f"a{i}{j}" for j in range(n)), " ".join(f"b{i}{j}" for j in range(n))) for i in range(300) for n in (1, 3, 5, 6)]
    near = spark.createDataFrame(rows, "a string, b string").select(likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("x"))
    assert near.agg(F.max("x")).first()[0] < 0.15


def check(rows, docs):
    """docs: distinct (doc_id, text) with distinct ids."""
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0), reverse=True)
    follow = {a[0]: b[1] or "" for a, b in zip(order, order[1:] + order[:1])}
    rows = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        text = text or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follow[doc_id][:cut]
        r = rows[doc_id]
        f, g, h = brute(text), brute(edited), brute(follow[doc_id])
        near = lambda x, y: float(x == y) if not x or not y else max(0.0, (sum(map(str.__eq__, x, y)) / 256 - 1 / 16) / (1 - 1 / 16))
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), f, g)
        assert abs(r.near_edited - near(f, g)) < 1e-9 and abs(r.near_next - near(f, h)) < 1e-9


def test_edge_cases(spark):
    docs = [(10 * i, t) for i, t in enumerate(TEXTS)] + [(None, "null id 🙂 text"), (-5, "x y z 🙂🙂 w v u")]
    df = spark.createDataFrame([(a, b, "c", 1) for a, b in docs], "doc_id long, text string, edited string, h int")
    rows = compared(fingerprinted(df)).withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("fingerprint", as_text(F.col("fingerprint"))).withColumn("edited_fingerprint", as_text(F.col("edited_fingerprint")))
    check(rows.collect(), docs)
    assert compared(fingerprinted(df.limit(0))).count() == 0
    same = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "d e f"), (2, "a b c")], "doc_id long, text string")
    out = compared(fingerprinted(same)).collect()
    assert sorted((r.doc_id, r.n_chars) for r in out) == [(1, 5), (1, 5), (1, 5), (2, 5)]
    assert len({tuple(r.fingerprint) for r in out}) == 2


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(op10_document_fingerprints(spark, sf).collect(), docs)
