import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from trackloom.llm.merkle import SQL, dataset_manifest, numbered, op13_merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, hash string, tree int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [row[0], row[1], row[2], None if row[3] is None else row[3] + more, row[4]]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(leaves, i):
    """The root over leaves, and the siblings of leaf i with their sides, level by level."""
    path = []
    while len(leaves) > 1:
        path.append((leaves[i ^ 1] if i ^ 1 < len(leaves) else "", i & 1))
        leaves = [sha(*leaves[k : k + 2]) for k in range(0, len(leaves), 2)]
        i //= 2
    return leaves[0], path


def brute(rows, tampered):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: x[:3])
    subroots = [climbed([x[2] for x in groups[n]], 0)[0] for n in names]
    out = []
    for k, name in enumerate(names):
        for i, x in enumerate(groups[name]):
            subroot, path = climbed([y[2] for y in groups[name]], i)
            root, rest = climbed(subroots, k)
            folded = leaf(x[3], 1) if tampered(x[3][0]) else x[2]
            for sibling, right in path + rest:
                folded = sha(sibling, folded) if right else sha(folded, sibling)
            out.append((x[3][0], x[2], subroot, root, sha(*(s for s, _ in path + rest)), folded, folded == root))
    return out


def by_seven(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0


def result(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def rows_of(n):
    """Hot and rare langs, nulls, empty and long texts, repeated ids and equal rows."""
    rows = [(i * 37 % n, "s" if i % 3 else None, "en" if i % 2 else ("de", None, "")[i % 3], None if i % 11 == 0 else i, (None, "", "é x" * 50_000)[i % 3] if i < 9 else f"text {i}") for i in range(n)]
    return rows + [(3, "a", "en", 4, "twice"), (3, "a", "en", 4, "twice"), (3, "a", "en", 4, "other"), (None, None, None, None, None), (8, "x", "one", 1, "alone")]


@pytest.mark.parametrize("n, bits, stride", [(0, 10, 5), (40, 2, 1), (75, 2, 3), (75, 3, 5), (300, 10, 5)])
def test_same_as_brute_force(spark, n, bits, stride):
    rows = rows_of(n)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    assert result(dataset_manifest(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, bits, stride)) == sorted(brute(rows, by_seven), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_smallest_tables(spark, n):
    rows = [(i, "a", "en", 5, "t") for i in range(n)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    assert result(dataset_manifest(df, F.lit(None).cast("boolean"))) == sorted(brute(rows, lambda _: False), key=repr)


def test_numbers_of_a_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), F.col("id"))).alias("g"), (-F.col("id")).alias("x"))
    found = numbered(rows, ["g"], ["x"], 7).collect()
    hot = sorted((r for r in found if r.g == "hot"), key=lambda r: r.x)
    assert [r.pos for r in hot] == list(range(4000))
    assert all(r.pos == 0 for r in found if r.g != "hot") and len(found) == 5000


def test_query(spark, sf):
    got = result(op13_merkle_manifest(spark, sf))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got == sorted(brute([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()], by_seven), key=repr)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    assert got == sorted(con.sql(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({SQL})").fetchall(), key=repr)
    assert 0 < sum(not r[-1] for r in got) < len(got)
