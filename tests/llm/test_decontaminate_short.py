import random

from test_decontaminate import brute, run


def test_short_items_in_long_documents(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    items = [(i, " ".join(word() for _ in range(5 + i % 18))) for i in range(72)]
    docs = []
    for d in range(216):
        words = [word() for _ in range(3000)]
        at = rng.randrange(len(words))
        item = items[d % 72][1].split()
        if d >= 144 and len(item) > 8:
            item = item[: len(item) - (len(item) - 4) // 5]  # as many shingles go as may
        elif d >= 72:
            item[-1] = "edited"
        docs.append((d, " ".join(words[:at] + item + words[at:])))
    want = brute(docs, items)
    assert run(spark, docs, items) == want and len(want) > 120 and sum(r[2] == 1 for r in want) >= 4


def test_items_of_any_length(spark):
    rng = random.Random(9)
    item = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate((21, 37, 68, 70, 133, 300, 3000, 50_000))]
    docs = [(i, f"{item(5 * i)} {t} {item(900)}") for i, t in items]
    docs += [(100 + i, " ".join(t.split()[len(t.split()) // 6 :])) for i, t in items]
    docs += [(200 + i, " ".join(t.split()[len(t.split()) // 3 :])) for i, t in items]
    assert run(spark, docs, items) == brute(docs, items)
    assert {r[0] for r in run(spark, docs, items)} == {*range(8), *range(100, 108)}
