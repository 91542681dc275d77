import random

import numpy as np
from pyspark.sql import functions as F

from trackloom.llm.links import SPREAD, bucket_links, components, shared, spread_join
from trackloom.llm.setsketch import BANDS, ROWS, likely, near_duplicates, op9_minhash_near_dedup, registers


def shingles(text, k=3):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = lower.split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k=3, percent=85):
    sets = {a: shingles(b, k) for a, b in rows}
    parent = {a: a for a in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = {}
    for a, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(a)
    tested = set()
    for a, s in sets.items():
        for b in {b for x in s for b in holders[x]}:
            if a < b and (a, b) not in tested:
                tested.add((a, b))
                if 100 * len(s & sets[b]) >= percent * len(s | sets[b]):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return sorted((a, len(s), root(a)) for a, s in sets.items())


def run(spark, rows):
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, n int, a int")
    return sorted((tuple(r) for r in near_duplicates(df).collect()), key=repr)


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return words


def test_chains_copies_and_large_groups(spark):
    rng = random.Random(5)
    rows, words = [], [f"w{rng.randrange(900)}" for _ in range(150)]
    for i in range(60):  # a chain: neighbours are linked, the ends are far apart
        words = edited(words, rng, 2)
        rows.append((1000 - i, " ".join(words)))
    base = [f"v{i}" for i in range(200)]
    rows += [(2000 + i, " ".join(edited(base, rng, i % 5))) for i in range(150)]
    rows += [(i, " ".join(f"u{rng.random()}" for _ in range(rng.randrange(12)))) for i in range(200, 260)]
    spread = [f"s{i}" for i in range(100)]
    rows += [(4000 + i, " ".join(edited(spread, rng, i % 12))) for i in range(80)]  # many are near each other's threshold
    rows += [(300, None), (301, ""), (302, "A b"), (303, "a B"), (304, "a"), (305, " \t")]
    assert run(spark, rows) == sorted(brute(rows), key=repr)


def test_edge_cases(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, "a b c"), (1, "a b c"), (1, "a b c")]) == sorted([(None, 1, None), (1, 1, 1), (1, 1, 1)], key=repr)
    assert run(spark, [(1, "x y z"), (1, "p q r"), (2, "p q r")]) == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1)], key=repr)
    long = " ".join(f"w{i}" for i in range(100_000))
    assert run(spark, [(5, long), (4, long + " end")]) == sorted([(5, 99_998, 4), (4, 99_999, 4)], key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {200: 200, 201: 200}


def test_every_pair_of_components_meets(spark):
    members = [(1, i) for i in range(12)]
    seen = []

    def confirm(pairs):
        seen.extend(map(tuple, pairs.collect()))
        return pairs.filter("a % 3 = b % 3 and a + 3 = b")

    def pairs_left(left):
        other = left.select(*(F.col(c).alias(f"{c}_b") for c in left.columns))
        return left.join(other, F.expr("key = key_b and component < component_b")).select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct()

    left = shared(spark.createDataFrame(members, "key long, id long").withColumn("n", F.lit(1)))
    links = bucket_links(left, confirm, pairs_left)
    got = dict(map(tuple, components(links).collect()))
    assert got == {i: i % 3 for i in range(12)}


def test_frequent_keys_are_spread(spark):
    rows = spark.createDataFrame([(1 if i % 3 == 0 else i, i) for i in range(9 * SPREAD)], "key long, id long")
    one = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("least"))
    got = sorted(map(tuple, spread_join(rows, one).select("key", "id", "least").collect()))
    assert got == sorted((1 if i % 3 == 0 else i, i, 0 if i % 3 == 0 else i) if i != 1 else (1, 1, 0) for i in range(9 * SPREAD))
    assert spread_join(rows.limit(0), one.limit(0)).collect() == []


def test_joint_estimate():
    rng = np.random.default_rng(1)
    for j in (0.0, 0.5, 0.85):
        x = []
        for _ in range(40):
            n, both = 400, round(2 * 400 * j / (1 + j))
            h = rng.integers(0, 2**63, (2 * n - both, ROWS * BANDS)).astype(np.uint64) * np.uint64(2)
            a, b = registers(h[:n].min(axis=0)), registers(h[n - both :].min(axis=0))
            x.append(likely(*(np.array([v]) for v in ((a > b).sum(), (a < b).sum(), 400.0, 400.0)))[0])
        assert abs(np.mean(x) - j) < 0.03


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in op9_minhash_near_dedup(spark, sf).collect())
    assert got == [(a, n, c, a == c) for a, n, c in brute(docs)]
