from collections import Counter

from pyspark.sql import functions as F

from trackloom.operators.summaries import score_sample


def test_scores_are_read_once_for_all_kinds(spark):
    """Each row adds one to an accumulator when it is read."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "fp").otherwise("tp").alias("kind"), (F.col("id") % 50 / 50.0).alias("score"))
    out = score_sample(rows.mapInPandas(counted, rows.schema), "tp", "fp", "none", most=500)
    assert read.value == 3000
    assert 450 <= len(out["tp"]) <= 550 and 450 <= len(out["fp"]) <= 550 and out["none"] == []
    assert set(Counter(out["tp"])) <= {i / 50 for i in range(50)} and out == score_sample(rows, "tp", "fp", "none", most=500)
