import re
from collections import Counter

from pyspark.sql import functions as F

from trackloom.llm import licenses


def test_every_paragraph_is_counted(spark):
    """All paragraphs of a table far above any bound of rows count, by their features; notices don't."""
    texts = [f"text {i} of the {'public' if i % 3 else 'software'}\n\nany person {i}" for i in range(3000)] + ["All rights reserved.", None, "Released under the MIT License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    unknown, rows = len(licenses.FAMILIES) - 1, licenses.counted(docs, "doc_id", "text").collect()
    got = Counter()
    for r in rows:
        if r.label == unknown:
            got[tuple(r.found)] += r.k
    known, want = set(licenses.vocabulary()), Counter()
    for line in "\n".join(t or "" for t in texts[:3000]).split("\n"):
        words = re.findall(r"[^\W_]+", line.lower())
        if words:
            want[tuple(sorted(known & {*words, *map(" ".join, zip(words, words[1:]))}))] += 1
    assert got == want and sum(want.values()) == 6000
    assert sum(r.k for r in rows if r.label != unknown) == sum(r.k for r in rows if r.label == unknown and not r.apart)


def test_lead_is_that_of_all(spark):
    margins = spark.range(20_000).select((F.col("id") / 100).alias("m"), F.lit(2).alias("k"))
    lead = licenses.passing(margins)
    assert margins.filter(F.col("m") > lead).count() <= 20 <= margins.filter(F.col("m") > lead - licenses.STEP - 0.01).count()
    assert licenses.passing(margins.limit(0)) == 0.0
