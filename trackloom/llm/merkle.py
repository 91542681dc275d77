"""Operator 13, a Merkle manifest of a dataset, whose proofs a recursive query climbs.

Every row is a leaf, the leaves of a group make a tree, and the groups' roots make one tree more. Levels are built in blocks of
2**BITS neighbours, so that no task ever holds more of a tree, and the blocks' tops are the next round's leaves. What is built
is stored as node rows: a node's row names its ancestor STRIDE levels above it (with a stride of 1 its parent) and has the
siblings on the way there. A recursive query starts from the leaves' rows; in each step it joins every leaf with the node that it has reached, appends
the siblings, and folds its hash with them, until it stands at the root.

A node above a block has a row for each block below it, so a step joins at most 2**BITS climbing leaves with one row, at the root too: no
node is everybody's join key. Such rows are few, one for STRIDE levels and a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackloom.llm.common import dropped, small, stored

#: Leaves of a block, as a power of two, and levels that a row of the climb ascends.
BITS, STRIDE = 10, 8

_STEP = "struct<hash: binary, left: boolean>"


def leaf_of(*columns: Column) -> Column:
    """SHA-256 of values, each as `-` if null, else as its length in bytes, a colon and itself."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text)), 256)


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], parts: int, name: str = "pos") -> DataFrame:
    """rows with their numbers from 0 on within each group, in an order with nulls first. Ranges of rows are sorted apart, and shifted by what lies
    before them, so a group of any size is no single task's work."""
    rows = stored(rows.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    starts = rows.groupBy(*group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_k"))
    before = F.sum("_k").over(W.partitionBy(*group).orderBy("_part")) - F.col("_k")
    starts = starts.select(*(F.col(c).alias(f"_{c}") for c in group), "_part", (before - F.col("_first")).alias("_shift"))
    same = part == F.col("_part")
    for c in group:
        same = same & rows[c].eqNullSafe(F.col(f"_{c}"))
    # a row for each range and each group that begins in one
    starts = F.broadcast(starts) if small(starts, 100_000, 8_000_000) else starts
    return rows.join(starts, same).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift", *(f"_{c}" for c in group))


def next_level(nodes: Column) -> Column:
    """Every two neighbours hashed together, the last one alone if it has none."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))), 256))


def depth(n: Column, bits: int) -> Column:
    """Levels above the lowest of a block in a tree of n nodes."""
    return sum((F.when(n > (1 << k), 1).otherwise(0) for k in range(bits)), F.lit(0))


def built(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Rounds of blocks over nodes(tree, n, pos, hash, ...), n the number of the tree's nodes: (tree, n, block, h, levels, top, rows). levels has the
    block's nodes level by level, rows what its lowest nodes have beside. A tree takes part until one node is left."""
    rounds, extra = [], [c for c in nodes.columns if c not in ("tree", "n", "pos", "hash")]
    while True:
        lists = nodes.groupBy("tree", "n", F.shiftright("pos", bits).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash", *extra))).alias("rows"))
        lists = lists.withColumn("h", depth(F.col("n"), bits)).withColumn("level0", F.transform("rows", lambda r: r["hash"]))
        for k in range(bits):
            lists = lists.withColumn(f"level{k + 1}", F.when(F.col("h") > k, next_level(F.col(f"level{k}"))).otherwise(F.col(f"level{k}")))
        blocks = stored(lists.select("tree", "n", "block", "h", F.array(*(f"level{k}" for k in range(bits + 1))).alias("levels"), F.col(f"level{bits}")[0].alias("top"), "rows"))
        rounds.append(blocks)
        more = blocks.filter(F.col("n") > (1 << bits))
        if more.isEmpty():
            return rounds
        nodes, extra = more.select("tree", F.ceil(F.col("n") / (1 << bits)).cast("long").alias("n"), F.col("block").alias("pos"), F.col("top").alias("hash")), []


def step(k: Column, at: Column) -> Column:
    """The sibling of the node number `at` in level k of a block, and whether it stands on the left; null if it has none."""
    sibling = F.get(F.get("levels", k), at.bitwiseXOR(F.lit(1)))
    return F.struct(F.unhex(sibling).alias("hash"), (at.bitwiseAND(F.lit(1)) == 1).alias("left"))


def shifted(i: Column, k: Column) -> Column:
    return F.call_function("shiftright", i, k)


def paths(rounds: list[DataFrame], ends: DataFrame) -> DataFrame:
    """(tree, pos, path): the steps from each block of the first round to the root. ends(tree, path) has them from each tree's top on."""
    none = F.array().cast(f"array<{_STEP}>")
    up: DataFrame | None = None
    for i in range(len(rounds) - 1, -1, -1):
        # where a tree ends in this round, its only block goes on as the tree's top does
        over = rounds[i].groupBy("tree").agg(F.max("block").alias("last")).filter("last = 0").select("tree")
        done = ends.join(over, "tree", "left_semi").select("tree", F.lit(0).cast("long").alias("pos"), "path")
        up = done if up is None else up.unionByName(done)
        if i:
            blocks = rounds[i].join(up.withColumnRenamed("pos", "block"), ["tree", "block"])
            inside = lambda r: F.transform(F.filter(F.sequence(F.lit(0), F.lit(BITS_MOST)), lambda k: k < F.col("h")), lambda k: step(k, shifted(r, k)))
            rows = F.transform("rows", lambda r, j: F.struct(r["pos"].alias("pos"), F.concat(inside(j), F.coalesce("path", none)).alias("path")))
            up = stored(blocks.select("tree", F.explode(rows).alias("x")).select("tree", "x.pos", "x.path"))
    return up


#: More levels than a block has.
BITS_MOST = 30


def node_rows(blocks: DataFrame, up: DataFrame, stride: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the first round's leaves and of the nodes above them: (tree, block, height, idx, up_height, up_idx, siblings), up_height and up_idx
    the ancestor's, null at the root; leaves have their own columns, too."""
    joined = blocks.join(up.withColumnRenamed("pos", "block"), ["tree", "block"]).withColumn("height_all", F.col("h") + F.size("path"))

    def row(height: Column, i: Column, *more: Column) -> Column:
        upto = F.filter(F.sequence(height, height + stride - 1), lambda k: k < F.col("height_all"))
        siblings = F.transform(upto, lambda k: F.when(k < F.col("h"), step(k, shifted(i, k - height))).otherwise(F.get("path", k - F.col("h"))))
        top = height + stride
        return F.struct(
            height.alias("height"), i.alias("idx"), F.when(top < F.col("height_all"), top).alias("up_height"),
            F.when(top < F.col("height_all"), F.when(top < F.col("h"), shifted(i, F.lit(stride))).otherwise(0)).alias("up_idx"), siblings.alias("siblings"), *more,
        )

    leaves = joined.select("tree", "block", F.explode(F.transform("rows", lambda r, i: row(F.lit(0), i, r.alias("leaf")))).alias("x")).select("tree", "block", "x.*")
    heights = F.filter(F.sequence(F.lit(stride), F.greatest(F.col("height_all"), F.lit(stride)), F.lit(stride)), lambda a: a < F.col("height_all"))
    wide = lambda a: F.when(a < F.col("h"), F.size(F.get("levels", a))).otherwise(1)
    inner = F.flatten(F.transform(heights, lambda a: F.transform(F.sequence(F.lit(0), wide(a) - 1), lambda i: row(a, i))))
    return leaves, joined.select("tree", "block", F.explode(inner).alias("x")).select("tree", "block", "x.*")


#: One step up: the hash folded with the siblings, and those appended. Hashes travel as 32 bytes.
_FOLD = "unhex(aggregate({n}.siblings, lower(hex({hash})), (x, s) -> sha2(CASE WHEN s.hash IS NULL THEN x WHEN s.left THEN concat(lower(hex(s.hash)), x) ELSE concat(x, lower(hex(s.hash))) END, 256)))"
_APPEND = "aggregate({n}.siblings, {proof}, (x, s) -> concat(x, coalesce(s.hash, X'')))"
CLIMB = f"""
WITH RECURSIVE climb(doc_id, leaf, tree, block, up_height, up_idx, folded, proof) AS (
  SELECT l.doc_id, l.leaf, l.tree, l.block, l.up_height, l.up_idx, {_FOLD.format(n='l', hash='l.start')}, {_APPEND.format(n='l', proof="X''")} FROM {{leaves}} l
  UNION ALL
  SELECT c.doc_id, c.leaf, c.tree, c.block, n.up_height, n.up_idx, {_FOLD.format(n='n', hash='c.folded')}, {_APPEND.format(n='n', proof='c.proof')}
  FROM climb c JOIN {{nodes}} n ON c.tree = n.tree AND c.block = n.block AND c.up_height = n.height AND c.up_idx = n.idx
)
SELECT doc_id, lower(hex(leaf)) AS leaf, tree, lower(hex(folded)) AS folded, sha2(lower(hex(proof)), 256) AS proof_sha256 FROM climb WHERE up_height IS NULL
"""


def manifest(leaves: DataFrame, bits: int = BITS, stride: int = STRIDE, parts: int | None = None) -> DataFrame:
    """leaves(doc_id, lang, leaf, tampered) with the hashes of the tree over them: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    Leaves of a lang ascend by doc_id, a null one first; rows that repeat a doc_id go on by their leaves, so equal rows are leaves of their own and
    any order of them gives one tree. A null lang is a lang of its own and the first one. folded_root is what the proof makes of tampered, or of leaf
    where that is null. A tree of one leaf has no siblings, and its proof is the hash of nothing. An empty table gives an empty result.
    """
    spark = leaves.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered(leaves.select("doc_id", "lang", "leaf", "tampered"), ["lang"], ["doc_id", "leaf"], parts)
    rows = stored(rows)
    if rows.isEmpty():
        return leaves.limit(0).select("doc_id", "leaf", *(F.lit("").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")), F.lit(True).alias("verified"))
    langs = stored(numbered(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), [], ["lang"], parts, "tree").withColumnRenamed("lang", "_lang"))
    few = small(langs, 100_000, 8_000_000)
    sized = rows.join(F.broadcast(langs) if few else langs, rows["lang"].eqNullSafe(langs["_lang"]))
    sized = sized.select("tree", "n", "pos", F.col("leaf").alias("hash"), "doc_id", F.coalesce("tampered", "leaf").alias("start"))
    rounds = built(sized, bits)
    tops = rounds[0].filter("n <= {}".format(1 << bits)).select("tree", "top")
    for r in rounds[1:]:
        tops = tops.unionByName(r.filter("n <= {}".format(1 << bits)).select("tree", "top"))
    tops = stored(tops)
    n_langs = langs.count()
    above = built(tops.select(F.lit(0).cast("long").alias("tree"), F.lit(n_langs).cast("long").alias("n"), F.col("tree").alias("pos"), F.col("top").alias("hash"), F.col("tree").alias("lang_tree")), bits)
    root = above[-1].select("top").first()["top"]
    # from each lang's top to the root
    none = F.array().cast(f"array<{_STEP}>")
    over = paths(above, spark.range(1).select(F.col("id").alias("tree"), none.alias("path")))
    inside = lambda j: F.transform(F.filter(F.sequence(F.lit(0), F.lit(BITS_MOST)), lambda k: k < F.col("h")), lambda k: step(k, shifted(j, k)))
    ends = above[0].join(over.withColumnRenamed("pos", "block"), ["tree", "block"])
    ends = ends.select(F.explode(F.transform("rows", lambda r, j: F.struct(r["lang_tree"].alias("tree"), F.concat(inside(j), F.coalesce("path", none)).alias("path")))).alias("x")).select("x.*")
    leaf_rows, inner = node_rows(rounds[0], paths(rounds, stored(ends)), stride)
    leaf_rows = stored(leaf_rows.select("tree", "block", "up_height", "up_idx", "siblings", F.unhex("leaf.hash").alias("leaf"), "leaf.doc_id", F.unhex("leaf.start").alias("start")))
    inner = stored(inner)
    limits = {k: spark.conf.get(k, None) for k in ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit")}
    try:
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # every leaf has a row for each step
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
        climbed = stored(spark.sql(CLIMB, leaves=leaf_rows, nodes=inner))
    finally:
        for k, v in limits.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    dropped(leaf_rows), dropped(rows)
    found = climbed.join(F.broadcast(tops) if few else tops, "tree")
    return found.select("doc_id", "leaf", F.col("top").alias("subroot"), F.lit(root).alias("root"), "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == F.lit(root)).alias("verified"))


def dataset_manifest(documents: DataFrame, tampered: Column | None = None, bits: int = BITS, stride: int = STRIDE) -> DataFrame:
    """manifest() of documents(doc_id, source, lang, n_chars, text). tampered says of which rows n_chars is one more when proofs are folded; a row without n_chars
    stays as it is, and so does one of which tampered is null.

    A null in any column is told from an empty text; a very long text is one leaf like any other, and only its hash travels. Further columns are ignored,
    whatever their names.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    other = [F.try_add("n_chars", F.lit(1)) if i == 3 else c for i, c in enumerate(columns)]
    changed = F.when((F.lit(False) if tampered is None else tampered) & F.col("n_chars").isNotNull(), leaf_of(*other))
    return manifest(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf_of(*columns).alias("leaf"), changed.alias("tampered")), bits, stride)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::varchar) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
#: CRC-32 of a text, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::ubigint)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::ubigint))), 4294967295::ubigint)"""
SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_LEAF.format(n='n_chars')} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF.format(n='(n_chars + 1)')} END AS tampered FROM documents
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), low AS (
  SELECT tree, 0 AS height, pos, n, leaf AS hash FROM placed
  UNION ALL
  SELECT tree, height + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, height, pos // 2, n
), tops AS (
  SELECT tree, height, hash FROM low WHERE n = 1
), high AS (
  SELECT 0 AS height, tree AS pos, (SELECT count(*) FROM tops) AS n, hash FROM tops
  UNION ALL
  SELECT height + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY height, pos // 2, n
), nodes AS (
  SELECT tree, height, pos, hash FROM low WHERE n > 1
  UNION ALL
  SELECT NULL, height, pos, hash FROM high WHERE n > 1
), climb AS (
  SELECT doc_id, leaf, tree, pos, 0 AS height, tree AS top, coalesce(tampered, leaf) AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT doc_id, leaf, CASE WHEN done THEN NULL ELSE c.tree END, CASE WHEN done THEN top ELSE c.pos // 2 END, CASE WHEN done THEN 0 ELSE c.height + 1 END, top,
    CASE WHEN done THEN folded WHEN s.hash IS NULL THEN sha256(folded) WHEN s.pos < c.pos THEN sha256(s.hash || folded) ELSE sha256(folded || s.hash) END, proof || coalesce(s.hash, '')
  FROM (SELECT c.*, c.tree IS NOT NULL AND c.height = t.height AS done FROM climb c JOIN tops t ON t.tree = c.top WHERE c.tree IS NOT NULL OR c.height < (SELECT max(height) FROM high)) c
  LEFT JOIN nodes s ON NOT done AND s.tree IS NOT DISTINCT FROM c.tree AND s.height = c.height AND s.pos = xor(c.pos, 1)
)
SELECT c.doc_id, c.leaf, t.hash AS subroot, r.hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.hash AS verified
FROM climb c JOIN tops t ON t.tree = c.top CROSS JOIN (SELECT hash FROM high WHERE n = 1) r WHERE c.tree IS NULL AND c.height = (SELECT max(height) FROM high)
"""
