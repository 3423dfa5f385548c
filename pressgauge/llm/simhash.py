"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits are cut into blocks such that two fingerprints within the distance agree on some blocks
entirely. Distinct fingerprints meet on each choice of agreeing blocks; inside such a bucket the Hamming distance is
verified. A bucket above ``bucket`` fingerprints is divided again by the bits that are left, by the same rule, so no
task ever holds more than what the last level allows: after three levels 50 bits are fixed and at most 2**14
fingerprints remain. A bucket yields a spanning forest of its links, not all its pairs.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; exact copies share a
fingerprint and are linked through it; a null id never becomes a component id unless the component has no other;
repeated rows are returned as often as they come; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressgauge.llm.common import arrow_stage, written
from pressgauge.llm.components import components

BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
BUCKET = 1024
PIECE = 1 << 16


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the shingles' XXH64 (seed 42)."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - words_per_shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    if n == 1:
        hashes = [np.array([xxh64_intdigest(joined, 42)], dtype="<u8")]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
        ends = ends[words_per_shingle - 1:].tolist()
        hashes = (np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[i:i + PIECE], ends[i:i + PIECE])],
                           dtype="<u8") for i in range(0, n, PIECE))
    for h in hashes:
        counts += _bit_counts(h)
    value = 0
    for k in np.flatnonzero(2 * counts > n).tolist():
        value |= 1 << k
    return value


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    if len(hashes) < 400:
        return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ BITS for k in range(8)])


def fingerprint_batches(batches: Iterator[pa.RecordBatch], words_per_shingle: int) -> Iterator[pa.RecordBatch]:
    """Task: the last column is the text; it is replaced by its fingerprint as a signed long."""
    for batch in batches:
        prints = np.array([fingerprint(t.as_py(), words_per_shingle) for t in batch.column(batch.num_columns - 1)],
                          dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)],
                                         names=[*batch.schema.names[:-1], "fp"])


def refined(fixed: int, distance: int) -> list[int]:
    """Masks that fix two more blocks of the bits outside ``fixed``; fingerprints within ``distance`` that agree on
    ``fixed`` agree on at least one mask."""
    free = [k for k in range(64) if not fixed >> k & 1]
    blocks = [sum(1 << k for k in part.tolist()) for part in np.array_split(np.array(free), distance + 2)]
    return [fixed | x | y for x, y in combinations(blocks, 2)]


def key_batches(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Task: (fp, mask so far) to (fp, finer mask, fp under it), a row for each finer mask."""
    memo: dict[int, np.ndarray] = {}
    for batch in batches:
        fp, fixed = (np.asarray(batch.column(k)).view(np.uint64) for k in (0, 1))
        for m in np.unique(fixed).tolist():
            if m not in memo:
                memo[m] = np.array(refined(m, distance), dtype=np.uint64)
            mine, masks = fp[fixed == m], memo[m]
            every = np.repeat(mine, len(masks))
            mask = np.tile(masks, len(mine))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (every, mask, every & mask)],
                                             names=["fp", "mask", "part"])


def forest(points: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: each point found is compared with the rest only."""
    rest, out = points, []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found, rest = rest[near], rest[~near]
                out.extend((x, y) for y in found)
                queue.extend(found)
    return out


def link_batches(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Task: rows sorted by (mask, part) to the links inside each bucket."""
    left, names = None, ["a", "b"]

    def links(fp: np.ndarray, mask: np.ndarray, part: np.ndarray) -> pa.RecordBatch | None:
        new = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
        starts = np.concatenate(([0], new))
        sizes = np.diff(np.append(starts, len(fp)))
        pairs = []
        two = starts[sizes == 2]
        x, y = fp[two], fp[two + 1]
        near = np.bitwise_count(x ^ y) <= distance
        pairs.append(np.stack([x[near], y[near]], 1))
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            found = forest(fp[s:s + n], distance)
            if found:
                pairs.append(np.array(found, dtype=np.uint64))
        all_pairs = np.concatenate(pairs)
        if len(all_pairs):
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(all_pairs[:, k]).view(np.int64)) for k in (0, 1)],
                                              names=names)
        return None

    for batch in batches:
        cols = [np.asarray(batch.column(k)).view(np.uint64) for k in range(3)]
        if left is not None:
            cols = [np.concatenate(x) for x in zip(left, cols)]
        fp, mask, part = cols
        cut = len(fp) - 1
        while cut > 0 and mask[cut - 1] == mask[-1] and part[cut - 1] == part[-1]:
            cut -= 1
        left = [x[cut:] for x in cols]
        if cut and (out := links(fp[:cut], mask[:cut], part[:cut])) is not None:
            yield out
    if left is not None and (out := links(*left)) is not None:
        yield out


def near_links(prints: DataFrame, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: links that connect what is connected among distinct fingerprints ``fp``.

    Per level: one count of the buckets with map-side combining, one join of the rows with the buckets of two or more
    (adaptive execution can split it), and one sort by bucket of those that are small enough. Larger ones go on to the
    next level. At the last level every bucket is small by the number of bits left.
    """
    rows, found = prints.select("fp", F.lit(0).cast("long").alias("mask")), None
    for level in range(3):
        keys = written(arrow_stage(rows, key_batches, "fp long, mask long, part long", distance), "keys")
        counts = keys.groupBy("mask", "part").count().where("count > 1")
        full = keys.join(counts, ["mask", "part"])
        if level < 2:
            full = written(full, "buckets")
            now, rows = full.where(F.col("count") <= bucket), full.where(F.col("count") > bucket)
        else:
            now, rows = full, None
        now = now.select("fp", "mask", "part").repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
        got = written(arrow_stage(now, link_batches, "a long, b long", distance), "near")
        found = got if found is None else found.unionByName(got)
        if rows is None or rows.isEmpty():
            break
        rows = rows.select("fp", "mask")
    return found


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, *, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "fp long"])
    return arrow_stage(docs.select(*keep, F.col(text_col).cast("string")), fingerprint_batches, schema, words_per_shingle)


def classes(prints: DataFrame, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``fp, component`` for every distinct fingerprint."""
    distinct = prints.select("fp").distinct()
    of_links = components(near_links(distinct, distance, bucket))
    return distinct.join(of_links.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, distance: int = 3, words_per_shingle: int = 3, bucket: int = BUCKET, *,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: the component id is the smallest id reachable by links."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = written(fingerprints(narrow, words_per_shingle, keep=("doc_id",)), "fingerprints")
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    of = written(classes(prints, distance, bucket), "classes")
    ids = of.join(smallest, "fp")
    least = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = written(ids.select("fp", "component").join(least, "component").select("fp", "component_id"), "class-ids")
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 3, words_per_shingle: int = 3, *, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component: the one of the smallest id, of these the first written."""
    own = [f"_c{i}" for i in range(len(docs.columns))]
    marked = docs.toDF(*own)
    id_own, text_own = own[docs.columns.index(id_col)], own[docs.columns.index(text_col)]
    marked = written(marked.withColumn("_row", F.monotonically_increasing_id()), "rows")
    prints = written(fingerprints(marked.select("_row", F.col(id_own).alias("_id"), F.col(text_own).alias("text")),
                                  words_per_shingle, keep=("_row", "_id")), "fingerprints")
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"),
                                                    F.col("_row").alias("r"))).alias("first"))
    of = written(classes(prints, distance), "classes")
    kept = of.join(first, "fp").groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.r").alias("_row"))
    return marked.join(kept, "_row", "left_semi").drop("_row").toDF(*docs.columns)
