import random
import zlib

import numpy as np
import pyarrow as pa

from trackloom.llm.toxicity import fitted, op1_toxicity, scored, trained
from trackloom.llm.common import utf8


def corpus(n, rng, forms=("grumbly", "GRUMBLED,", "vexatious", "vexation.")):
    syllables = ["la", "mi", "ro", "tan", "ke", "su", "bel", "or", "ne"]
    out = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(5, 400))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(forms))
        out.append((" ".join(words), float(toxic)))
    return out


def test_held_out_and_misspelt_words():
    rng = random.Random(3)
    rows = corpus(1200, rng)
    model = trained(pa.array([t for t, _ in rows]), np.array([y for _, y in rows]))
    for forms in (("grumbly", "vexatious"), ("grumblies", "vexatioux!")):  # the second are unseen forms
        held = corpus(400, rng, forms)
        data, offsets = utf8(pa.array([t for t, _ in held]))
        score, label = model.scores(data, offsets), np.array([y for _, y in held]) == 1
        assert (score[label][:, None] > score[~label][None]).mean() > 0.9


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a grumbly text", 0.5, 1), (2, None, 0.5, 1), (3, "", 0.5, None), (None, "x", 0.5, 1), (1, "a grumbly text", 0.5, 1), (4, "word " * 60000, 1.0, 0)], "doc_id long, text string, score double, toxic int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (4, 0), (99, 1)], "doc_id long, toxic int")
    rows = scored(docs, fitted(docs, labels, lambda c: c.isNotNull())).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    nothing = fitted(docs.limit(0), labels.limit(0))
    assert {r.score for r in scored(docs, nothing).collect()} == {0.0} or max(r.score for r in scored(docs, nothing).collect()) < 1e-9
    assert scored(docs.limit(0), nothing).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op1_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    caught = [p for p, y in held if y == 1]
    assert sum(caught) / len(caught) > 0.65  # a few hundred toxic rows with many rare stems
    assert sum(p for p, y in held if y == 0) / len(held) < 0.01
