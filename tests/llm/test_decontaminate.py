import random
import re

import duckdb

from trackloom.llm.decontaminate import SQL, contained, op7_benchmark_decontamination


def shingles(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs, items):
    out = set()
    for d, text in docs:
        s = shingles(text)
        for i, item in items:
            t = shingles(item)
            if t and len(s & t) >= 0.8 * len(t):
                out.add((d, i, len(t), len(s & t)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "doc_id long, text string, item_id int, size int")
    b = spark.createDataFrame([(a, b, 3, 4) for a, b in items], "item_id long, text string, doc_id int, hashes int")
    return sorted((tuple(r) for r in contained(d, b).collect()), key=repr)


def test_items_of_many_sizes_in_long_documents(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 9, 20, 33, 60, 150, 400])))) for i in range(60)]
    docs = []
    for d in range(120):
        words = [word() for _ in range(rng.choice([0, 10, 300, 5000]))]
        at = rng.randrange(len(words) + 1)
        item = items[rng.randrange(60)][1].split()
        if d % 3 == 1 and len(item) > 20:
            item[len(item) // 2] = "edited"  # five shingles go
        if d % 3 == 2:
            item = item[: len(item) * 2 // 3]
        docs.append((d, " ".join(words[:at] + [w.upper() + "," for w in item] + words[at:])))
    want = [r for r in brute(docs, items) if r[2] > 1]  # a single shingle stands alone in no longer text
    assert [r for r in run(spark, docs, items) if r[2] > 1] == want and len(want) > 40


def test_edge_cases(spark):
    items = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (None, "x y z u v w"), (4, "..")]
    docs = [(1, "q a b c d e f"), (1, "q a b c d e f"), (2, None), (3, ""), (None, "a b c d e f"), (5, "x y z u v w " * 3000), (6, "!!")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_query(spark):
    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    assert sorted(tuple(r) for r in op7_benchmark_decontamination(spark, sf).collect()) == sorted(con.sql(SQL).fetchall())
