from pyspark.sql import functions as F

from trackloom.llm.toxicity import SAMPLE_BYTES, fitted, labelled_sample, scored


def always(c):
    return c.isNotNull()


def test_a_long_text_costs_only_itself(spark):
    ids = spark.range(40).withColumnRenamed("id", "doc_id")
    docs = ids.withColumn("text", F.when(F.col("doc_id") < 3, F.repeat(F.lit("long "), SAMPLE_BYTES // 5 + 1)).otherwise(F.concat(F.lit("text "), F.col("doc_id").cast("string"))))
    docs = docs.union(docs.filter("doc_id > 30"))  # rows that repeat an id count once
    labels = ids.withColumn("toxic", (F.col("doc_id") % 4 == 0).cast("int"))
    got = sorted((r.text, r.toxic) for r in labelled_sample(docs, labels, always).collect())
    assert got == sorted((f"text {i}", int(i % 4 == 0)) for i in range(3, 40))
    # of labels that have long texts alone the shortest is cut, so that there is something to learn from
    cut = labelled_sample(docs.filter("doc_id < 3"), labels, always).collect()
    assert sorted(r.toxic for r in cut) == [0, 1]
    assert {r.text for r in cut} == {("long " * SAMPLE_BYTES)[: SAMPLE_BYTES // 8]}


def test_labels_of_long_texts_alone(spark):
    docs = spark.createDataFrame([(0, "bad " * 1_700_000), (4, "bad " * 1_800_000), (1, "good day"), (2, "fine day")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in (0, 1, 2, 4)], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in scored(docs, fitted(docs, labels, always)).collect()}
    assert scores[0] > scores[1] and scores[4] > scores[2]
