import random

import public_tokenizers

import trackloom.llm.packing as packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_few_words_are_kept_and_ids_stay(spark):
    """A worker's table stays within its bound, keeps what came first, and the pieces are the same whatever the bound."""
    rng = random.Random(5)
    texts = [" ".join(["the", "and", *(f"w{rng.randrange(10**6)}x" for _ in range(30))]) for _ in range(60)]
    few, many = packing.WordIds(PATH, 100), packing.WordIds(PATH)
    for text in texts:
        assert few.ids(text) == many.ids(text) and len(few) <= 100
    assert b"the" in few and len(many) > 1000
    long = " ".join(f"v{i}" for i in range(300))
    assert few.ids(long) == many.ids(long) and len(few) <= 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = (sorted(map(tuple, packing.pack_documents(df, PATH, 64, known_words=n).select("doc_id", "piece", "length", "ids_crc32").collect())) for n in (100, None))
    assert a == b
