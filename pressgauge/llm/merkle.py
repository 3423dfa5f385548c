"""Merkle manifest of a dataset, with a proof for every row that a recursive query climbs.

Every row is a leaf: the digest of its columns, each as ``-`` (null) or byte count, ``:`` and value. The leaves of a
source, by id, are hashed in runs of 16 until one node, the subroot, remains; the subroots, by source, likewise give the
root. Built levels are stored as parent-linked node rows: a row holds the digests of its children, its own place among
its parent's children and the number of that parent. A recursive common table expression starts with one row per leaf
and goes from parent to parent; each step appends a row with the siblings met there and folds the leaf's digest, possibly
tampered with, into that of the parent. Siblings go into one row a level instead of a growing string, so a leaf with d
levels moves d sets of siblings and not d²/2.

Nothing is keyed by a source alone: node rows are stored once for every block of 4096 leaves below them, and the climb
joins on (source, block, level, number), so that a source with a third of all rows, and the rows near the root, meet in
groups of at most 4096. This adds one path of nodes per block to the one node per 16 leaves.

Defined cases: a null column is ``-``; rows of a null source are a source of their own, the first; null ids come first
in their source and are never tampered with; rows that share id and source are ordered by their digest; repeated rows are
leaves each; the proof of a leaf without siblings is the digest of nothing; an empty table has no rows; other columns are
ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressgauge.llm.common import written

BITS = 4                       # 16 children a node
FAN = 1 << BITS
BLOCK_LEVELS = 3               # a block is the leaves below a node of this level
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CLIMB = """
WITH RECURSIVE climb(at, src, block, level, parent, slot, folded, siblings) AS (
  SELECT at, src, block, 0, parent, slot, folded, CAST('' AS BINARY) FROM {leaves}
  UNION ALL
  SELECT c.at, c.src, c.block, p.level, p.parent, p.slot,
         unhex(sha2(lower(hex(concat(substring(p.children, 1, 32 * c.slot), c.folded,
                                     substring(p.children, 32 * c.slot + 33, 512)))), 256)),
         concat(substring(p.children, 1, 32 * c.slot), substring(p.children, 32 * c.slot + 33, 512))
  FROM climb c JOIN {nodes} p ON p.src = c.src AND p.block = c.block AND p.level = c.level + 1 AND p.idx = c.parent
)
SELECT at, src, block, level, folded, siblings FROM climb
"""


def said(value: Column) -> Column:
    """A column in a leaf: ``-`` for null, else its UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(said(fields[f]) for f in FIELDS)), 256))


def shown(digest: Column) -> Column:
    """Digests are stored as 32 bytes and shown, and hashed again, as lowercase hex."""
    return F.lower(F.hex(digest))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, src_key, leaf, changed, tie`` of every row; ``changed`` is the tampered digest, null where untouched.

    ``src_key`` orders as the source does, null first, and is never null.
    """
    own = {f: F.col(f) for f in FIELDS}
    lowered = F.translate(F.col("text"), UPPER, LOWER)
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("src_key"),
        leaf_digest(own).alias("leaf"),
        F.when(hit, leaf_digest(own | {"text": lowered})).alias("changed"),
        F.monotonically_increasing_id().alias("tie"))


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` range-sorted by ``keys`` and written, with ``at``, which ascends with the order, and ``part``."""
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    return written(ordered.withColumn("part", F.shiftright("at", 33).cast("int")), "merkle-order")


def numbered_sources(parts: DataFrame) -> DataFrame:
    """``src_key, src``: the place of every source, from 0. Only one row a partition is summed in one task."""
    placed = in_order(parts.select("src_key").distinct(), "src_key")
    spans = placed.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("part", "first", before.alias("base"))
    return placed.join(spans, "part").select("src_key", (F.col("at") - F.col("first") + F.col("base")).alias("src"))


def numbered_leaves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves with ``src``, ``no`` (place in the source, from 0) and ``n`` (the source's leaves); and the spans, one
    row per partition and source, that tell them."""
    leaves = written(digests(docs), "merkle-leaves")
    placed = in_order(leaves, "src_key", "doc_id", "leaf", "tie")
    parts = written(placed.groupBy("part", "src_key").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here")), "merkle-parts")
    own = Window.partitionBy("src_key")
    before = F.sum("here").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = (parts.withColumns({"base": F.coalesce(before, F.lit(0)), "n": F.sum("here").over(own)})
             .join(numbered_sources(parts), "src_key").select("part", "src_key", "src", "first", "base", "n"))
    spans = written(spans, "merkle-spans")
    numbered = placed.join(spans, ["part", "src_key"]).select(
        "part", "src", "at", "n", (F.col("at") - F.col("first") + F.col("base")).alias("no"), "doc_id", "leaf",
        F.coalesce("changed", "leaf").alias("folded"))
    return written(numbered, "merkle-numbered"), spans


def levels(nodes: DataFrame) -> list[DataFrame]:
    """Levels 1, 2, … above ``nodes`` (``tree, idx, size, n, digest``), each written, with the ``children``.

    ``size`` is the number of nodes of the tree on the level; a tree ends where that is 1.
    """
    most = nodes.agg(F.max("size")).first()[0] or 0
    out = []
    while most > 1:
        run = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        grouped = (nodes.where("size > 1").groupBy("tree", F.shiftright("idx", BITS).alias("up"), "size", "n").agg(run.alias("run"))
                   .select("tree", F.col("up").alias("idx"), F.ceil(F.col("size") / FAN).cast("long").alias("size"), "n",
                           F.unhex(F.array_join(F.transform("run", lambda x: F.hex(x["digest"])), "")).alias("children")))
        level = grouped.select("tree", "idx", "size", "n", F.unhex(F.sha2(shown(F.col("children")), 256)).alias("digest"), "children",
                               F.lit(len(out) + 1).alias("level"))
        nodes = written(level, "merkle-level")
        out.append(nodes)
        most = -(-most // FAN)
    return out


def blocks_below(df: DataFrame, level: Column, idx: Column, last: Column) -> DataFrame:
    """One row for every block of leaves below a node."""
    wide = F.pow(F.lit(2), BITS * F.abs(level - BLOCK_LEVELS)).cast("long")
    first = F.when(level <= BLOCK_LEVELS, F.floor(idx / wide)).otherwise(idx * wide)
    end = F.when(level <= BLOCK_LEVELS, F.floor(idx / wide)).otherwise((idx + 1) * wide - 1)
    return df.withColumn("block", F.explode(F.sequence(first.cast("long"), F.least(end.cast("long"), last))))


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    The driver sees the number of sources, the largest source's size and the root.
    """
    spark = docs.sparkSession
    leaves, spans = numbered_leaves(docs)
    ground = leaves.select(F.col("src").alias("tree"), F.col("no").alias("idx"), F.col("n").alias("size"), "n", F.col("leaf").alias("digest"))
    built = levels(ground)
    if not leaves.take(1):
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                         "folded_root string, verified boolean")
    tops = [ground.where("size = 1").select("tree", "n", F.lit(0).alias("top"), "digest"),
            *(b.where("size = 1").select("tree", "n", F.col("level").alias("top"), "digest") for b in built)]
    subroots = written(reduce(DataFrame.union, tops), "merkle-subroots")
    sources = subroots.count()
    upper = levels(subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("idx"),
                                   F.lit(sources).cast("long").alias("size"), F.lit(sources).cast("long").alias("n"), "digest"))
    root = (upper[-1] if upper else subroots).first()["digest"]

    # Parent links: a node goes on at (level + 1, parent), as child number slot. A subroot goes on in the tree of subroots.
    goes_on = lambda end: (F.when(end, F.col("src")).otherwise(F.col("idx")))
    last = F.shiftright(F.col("n") - 1, BITS * BLOCK_LEVELS)
    rows = []
    if built:
        inner = reduce(DataFrame.union, built).withColumnRenamed("tree", "src").withColumn("next", goes_on(F.col("size") == 1))
        rows.append(blocks_below(inner, F.col("level"), F.col("idx"), last))
    if upper:
        heights = F.explode(F.sequence(F.lit(1), F.lit(len(upper)))).alias("level")
        above = (subroots.select(F.col("tree").alias("src"), "n", "top", heights)
                 .withColumn("idx", F.floor(F.col("src") / F.pow(F.lit(FAN), F.col("level"))).cast("long"))
                 .join(reduce(DataFrame.union, upper).select("level", "idx", "size", "digest", "children"), ["level", "idx"])
                 .withColumn("next", F.col("idx")).withColumn("level", F.col("level") + F.col("top")))
        rows.append(above.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last))))
    linked = [r.select("src", "block", F.col("level").cast("int").alias("level"), "idx", F.shiftright("next", BITS).alias("parent"),
                       F.col("next").bitwiseAND(FAN - 1).cast("int").alias("slot"), "children") for r in rows]
    start = leaves.withColumn("next", F.when(F.col("n") == 1, F.col("src")).otherwise(F.col("no")))
    start = start.select("at", "src", F.shiftright("no", BITS * BLOCK_LEVELS).alias("block"), F.shiftright("next", BITS).alias("parent"),
                         F.col("next").bitwiseAND(FAN - 1).cast("int").alias("slot"), "folded")
    met = climbed(start, written(reduce(DataFrame.union, linked), "merkle-nodes")) if linked else leaves.select(
        "at", "src", F.lit(0).cast("long").alias("block"), F.lit(0).alias("level"), "folded", F.lit(b"").alias("siblings"))

    # Dealt out by block: the leaves of a run stay neighbours, and their siblings compress to little.
    path = F.array_sort(F.collect_list(F.struct("level", "siblings")))
    proofs = met.repartition("src", "block").groupBy("src", "block", "at").agg(
        F.max_by("folded", "level").alias("folded_root"), path.alias("path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: shown(x["siblings"])), ""), 256)
    own = spans.join(subroots.select(F.col("tree").alias("src"), F.col("digest").alias("subroot")), "src").select("part", "src", "subroot")
    return (leaves.join(own, ["part", "src"]).join(proofs.select("at", "folded_root", proof.alias("proof_sha256")), "at")
            .select("doc_id", shown(F.col("leaf")).alias("leaf"), shown(F.col("subroot")).alias("subroot"),
                    F.lit(root.hex()).alias("root"), "proof_sha256", shown(F.col("folded_root")).alias("folded_root"),
                    (F.col("folded_root") == F.lit(bytes(root))).alias("verified")))


def climbed(start: DataFrame, nodes: DataFrame) -> DataFrame:
    """``at, level, folded, siblings``: a row for every leaf and level, by a recursive query, written.

    Recursion is bounded by the depth of the trees (16-fold a level), so the session's bound on its rows is lifted while
    the query runs.
    """
    spark, mark = start.sparkSession, uuid.uuid4().hex
    names = {"leaves": f"merkle_leaves_{mark}", "nodes": f"merkle_nodes_{mark}"}
    start.createOrReplaceTempView(names["leaves"])
    nodes.createOrReplaceTempView(names["nodes"])
    bound = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(bound)
    spark.conf.set(bound, "-1")
    try:
        return written(spark.sql(CLIMB.format(**names)), "merkle-climb")
    finally:
        spark.conf.set(bound, before)
        for name in names.values():
            spark.catalog.dropTempView(name)


# The same by SQL alone: crc32 is spelled out bit by bit, levels and climbs are recursive queries.
SQL = """
WITH RECURSIVE marked AS (
  SELECT doc_id, coalesce('s' || source, '') AS tree,
         concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head, text,
         list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' ||
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
  FROM marked),
ground AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS no, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
up(tree, level, idx, size, digest) AS (
  SELECT tree, 0, no, n, leaf FROM ground
  UNION ALL
  SELECT tree, level + 1, idx // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE size > 1
  GROUP BY tree, level, idx // 16, size),
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS no, count(*) OVER () AS n FROM up WHERE size = 1),
above(level, idx, size, digest) AS (
  SELECT 0, no, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM above WHERE size > 1
  GROUP BY level, idx // 16, size),
runs AS (SELECT tree, level, idx // 16 AS parent, list(digest ORDER BY idx) AS kids FROM up WHERE size > 1 GROUP BY ALL),
top_runs AS (SELECT level, idx // 16 AS parent, list(digest ORDER BY idx) AS kids FROM above WHERE size > 1 GROUP BY ALL),
climb(tree, no, level, idx, folded, proof) AS (
  SELECT tree, no, 0, no, coalesce(changed, leaf), '' FROM ground
  UNION ALL
  SELECT c.tree, c.no, c.level + 1, c.idx // 16,
         sha256(concat(array_to_string(kids[1:c.idx % 16], ''), folded, array_to_string(kids[c.idx % 16 + 2:], ''))),
         concat(proof, array_to_string(kids[1:c.idx % 16], ''), array_to_string(kids[c.idx % 16 + 2:], ''))
  FROM climb c JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.parent = c.idx // 16),
halfway AS (SELECT tree, no, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM climb GROUP BY tree, no),
rest(tree, no, level, idx, folded, proof) AS (
  SELECT h.tree, h.no, 0, s.no, h.folded, h.proof FROM halfway h JOIN subroots s ON s.tree = h.tree
  UNION ALL
  SELECT c.tree, c.no, c.level + 1, c.idx // 16,
         sha256(concat(array_to_string(kids[1:c.idx % 16], ''), folded, array_to_string(kids[c.idx % 16 + 2:], ''))),
         concat(proof, array_to_string(kids[1:c.idx % 16], ''), array_to_string(kids[c.idx % 16 + 2:], ''))
  FROM rest c JOIN top_runs r ON r.level = c.level AND r.parent = c.idx // 16),
done AS (SELECT tree, no, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM rest GROUP BY tree, no),
root AS (SELECT digest FROM above WHERE size = 1)
SELECT g.doc_id, g.leaf, s.digest AS subroot, root.digest AS root, sha256(d.proof) AS proof_sha256, d.folded AS folded_root,
       d.folded = root.digest AS verified
FROM ground g JOIN done d ON d.tree = g.tree AND d.no = g.no JOIN subroots s ON s.tree = g.tree CROSS JOIN root
"""
