"""Phrase collocation mining over count streams in prefix and suffix order.

Counting goes by length. A pass over the texts adds up, for 40-bit hashes of the phrases of n words whose two shorter
parts may be frequent, how often they occur: in a task over its chunks, then in Spark. The hashes that reach the least
count are kept as a bitmap of fixed size (``FILTER_BITS``), and the next pass counts, beside the hashes of n + 1 words, the
phrases themselves that the bitmap may know. A hash that two phrases share, or a hit in a bitmap that is none, only costs
a counted row, never a result, since the last counts are exact and rare phrases are left out by their count.

The counted phrases, parts of every candidate included, are then kept as a stream sorted by (lang, first word, …, last
word). There a phrase follows its first parts, and what extends it to the right follows the phrase: one walk in lockstep
with the last phrase of every length yields all left counts and the largest extension. The second stream is sorted by
(lang, last word, …, first word) and yields the right counts and the extension to the left in the same way. Each
partition of a stream is walked alone; what reaches over its ends are nine numbers per partition, which the driver
settles (at most ``PARTS`` partitions). Nothing is looked up by hash.

Defined cases: a null text is empty, a null language ``und``; the ids play no part, so repeated rows count as often as
they come; ties in score and count go by phrase; an empty table gives no row; other columns are ignored; texts of any
length are taken whole.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from pressgauge.llm.common import arrow_stage, written
from pressgauge.session import checkpointed

LONGEST = 5
FILTER_BITS = 1 << 27         # 16 MB on the driver and in a task
BITMAP = 1 << 15              # bits in one of the bitmaps that Spark builds
KEY_BITS = 40                 # of a phrase's hash
CHUNK = 4_000_000             # words that a task counts at once
ROWS_A_PART = 1_000_000       # of a stream
PARTS = 4_096
MIX = np.uint64(0x9E3779B97F4A7C15)

# Piece ends; the byte 0xFF, which no UTF-8 text has, stands for one.
ENDS = b".,;:!?\n\x0b\x0c\r"
BREAK = b"\xff"
TABLE = bytes.maketrans(ENDS + b"\t" + bytes(range(65, 91)), BREAK * len(ENDS) + b" " + bytes(range(97, 123)))


def split(text: str | None) -> list[bytes]:
    """Lower-cased words, with ``BREAK`` between pieces."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(TABLE)
    return raw.replace(BREAK, b" \xff ").split()


class Chunk:
    """Texts of one language, counted together. Word 0 is the end of a piece."""

    def __init__(self, lang: str) -> None:
        self.lang, self.codes, self.size = lang, [], 0
        self.words: dict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.words[BREAK]

    def add(self, text: str | None) -> None:
        found = split(text)
        found.append(BREAK)
        self.codes.append(np.fromiter(map(self.words.__getitem__, found), np.int32, len(found)))
        self.size += len(found)

    def closed(self) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The words' codes in a row, the hash of every word of the chunk, and the words."""
        words = list(self.words)
        seed = zlib.crc32(self.lang.encode())
        codes = np.concatenate([*self.codes, np.zeros(1, np.int32)])
        return codes, np.array([xxhash.xxh64_intdigest(w, seed) for w in words], dtype=np.uint64), words


def whole(codes: np.ndarray, n: int) -> np.ndarray:
    """Where ``n`` words of one piece start."""
    last = max(0, len(codes) - n + 1)
    ok = codes[:last] > 0
    for j in range(1, n):
        ok &= codes[j:last + j] > 0
    return np.flatnonzero(ok)


def hashed(own: np.ndarray, codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the phrases of ``n`` words that start at ``at``."""
    return mixed([own[codes[at + j]] for j in range(n)])


def known_in(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    place = key >> np.uint64(KEY_BITS - FILTER_BITS.bit_length() + 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def mixed(words: list[np.ndarray]) -> np.ndarray:
    """A hash of ``KEY_BITS`` for phrases given as the hashes of their words, first to last."""
    out = np.zeros(len(words[0]), np.uint64)
    for w in words:
        out = (out ^ w) * MIX
        out ^= out >> np.uint64(29)
    return (out * MIX) >> np.uint64(64 - KEY_BITS)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """(lang, text) rows as chunks of about ``CHUNK`` words, by language."""
    held: dict[str, Chunk] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            chunk = held.get(lang)
            if chunk is None:
                chunk = held[lang] = Chunk(lang)
            size -= chunk.size
            chunk.add(text.as_py())
            size += chunk.size
            if size >= CHUNK:
                yield from held.values()
                held, size = {}, 0
    yield from held.values()


def hash_counts(own: np.ndarray, codes: np.ndarray, n: int, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the phrases of ``n`` words, both of whose shorter parts ``bits`` may know, and their counts."""
    at = whole(codes, n)
    if bits is not None:
        at = at[known_in(bits, hashed(own, codes, at, n - 1))]
        at = at[known_in(bits, hashed(own, codes, at + 1, n - 1))]
    return np.unique(hashed(own, codes, at, n), return_counts=True)


def phrase_counts(own: np.ndarray, codes: np.ndarray, words: list[bytes], n: int, bits: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The phrases of ``n`` words that ``bits`` may know, and their counts."""
    at = whole(codes, n)
    at = at[known_in(bits, hashed(own, codes, at, n))]
    key = codes[at].astype(np.int64)
    for j in range(1, n):                      # the parts seen so far are renumbered, so keys stay small and exact
        if j > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(words) + codes[at + j]
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    rows = codes[at[first][:, None] + np.arange(n)] if len(first) else np.zeros((0, n), np.int32)
    return [b" ".join([words[c] for c in r]) for r in rows.tolist()], count


def count_batches(batches: Iterator[pa.RecordBatch], n: int, longest: int, filters) -> Iterator[pa.RecordBatch]:
    """Task: (lang, text) to (key, phrase, f): hashes of ``n`` words, without a phrase, and counted phrases of ``n - 1``
    words, as phrase, tab and language under the key ``n - 1``; the language's words count as the phrase ``''``."""
    bits = filters.value[-1] if filters.value else None
    for chunk in chunks(batches):
        codes, own, words = chunk.closed()
        if n <= longest:
            key, count = hash_counts(own, codes, n, bits)
            for lo in range(0, len(key), 100_000):
                part = key[lo:lo + 100_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(part), pa.string()), pa.array(count[lo:lo + 100_000])],
                                                 names=["key", "phrase", "f"])
        phrases, count = ([b""], np.array([(codes > 0).sum()])) if n == 1 else phrase_counts(own, codes, words, n - 1, bits)
        end = b"\t" + chunk.lang.encode()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(phrases), n - 1)), pa.array([p + end for p in phrases], pa.binary()).cast(pa.string()),
             pa.array(count.astype(np.int64))], names=["key", "phrase", "f"])


def filter_of(keys: DataFrame) -> np.ndarray:
    """Bitmap of ``key``s: at most ``FILTER_BITS`` / 8 bytes reach the driver."""
    place = F.shiftright("key", KEY_BITS - FILTER_BITS.bit_length() + 1)
    maps = keys.groupBy(F.shiftright(place, BITMAP.bit_length() - 1).alias("b")).agg(
        F.bitmap_construct_agg(place.bitwiseAND(F.lit(BITMAP - 1))).alias("m"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in maps.collect():
        out[r.b * BITMAP // 8:(r.b + 1) * BITMAP // 8] = np.frombuffer(r.m, np.uint8)
    return out


def frequent(docs: DataFrame, least: int, longest: int = LONGEST, *, lang_col: str = "lang",
             text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of all phrases of up to ``longest`` words that occur ``least`` times, and ``lang, n``."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    known, out = None, None
    for n in range(1, longest + 2):
        shared = context.broadcast([] if known is None else [known])
        counted = arrow_stage(texts, count_batches, "key long, phrase string, f long", n, longest, shared)
        summed = written(counted.groupBy("key", "phrase").agg(F.sum("f").alias("f"))
                         .where((F.col("f") >= least) | (F.col("key") == 0) & F.col("phrase").isNotNull()), f"phrases-{n}")
        shared.destroy()
        exact = summed.where("phrase is not null").select(
            F.substring_index("phrase", "\t", 1).alias("phrase"), F.expr("substring(phrase, instr(phrase, '\t') + 1)").alias("lang"),
            F.lit(n - 1).alias("size"), "f")
        out = exact if out is None else out.unionByName(exact)
        if n <= longest:
            known = filter_of(summed.where("phrase is null").select("key"))
            if not known.any():
                break
    return out.where("size > 0").select("lang", "phrase", "size", "f"), out.where("size = 0").select("lang", F.col("f").alias("n"))


def partition_tables(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def parents(size: np.ndarray, longest: int) -> np.ndarray:
    """For every row and k from 1: the last row before it with k words, -1 for none in this partition."""
    at = np.arange(len(size))
    out = np.full((longest + 1, len(size)), -1)
    for k in range(1, longest):
        seen = np.maximum.accumulate(np.where(size == k, at, -1))
        out[k] = np.where(size > k, seen, -1)
    return out


def edge_batches(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """Task: a sorted partition (size, f) to what reaches over its ends: for every k the count of its last phrase of k
    words (-1: none), and the largest extension here of the last phrase of k words before it."""
    table = partition_tables(batches)
    if table is None:
        return
    size, f = (np.asarray(table[c]) for c in ("size", "f"))
    up, rows = parents(size, longest), []
    for k in range(1, longest):
        mine = np.flatnonzero(size == k)
        over = (size == k + 1) & (up[k] < 0)
        rows.append((TaskContext.get().partitionId(), k, int(f[mine[-1]]) if len(mine) else -1, int(f[over].max()) if over.any() else 0))
    part, k, last, head = zip(*rows)
    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(k, pa.int32()), pa.array(last, pa.int64()),
                                      pa.array(head, pa.int64())], names=["part", "k", "last", "head"])


def settle(edges: list, longest: int) -> tuple[dict, dict]:
    """From the partitions' edges: the count of the last phrase of k words before a partition, and the largest extension
    in later partitions of its own last one. Keys are (partition, k)."""
    before, after = {}, {}
    for k in range(1, longest):
        seen, owner = 0, None
        for e in sorted((e for e in edges if e["k"] == k), key=lambda e: e["part"]):
            before[e["part"], k] = seen
            if owner is not None:
                after[owner, k] = max(after.get((owner, k), 0), e["head"])
            if e["last"] >= 0:
                seen, owner = e["last"], e["part"]
    return before, after


def walk_batches(batches: Iterator[pa.RecordBatch], longest: int, before: dict, after: dict) -> Iterator[pa.RecordBatch]:
    """Task: a sorted partition to the same rows with ``parts``, the counts of the first k words for k from 1, and
    ``ext``, the largest count of a phrase that has one word more at the end."""
    table = partition_tables(batches)
    if table is None:
        return
    me = TaskContext.get().partitionId()
    size, f = (np.asarray(table[c]) for c in ("size", "f"))
    up, ext = parents(size, longest), np.zeros(len(size), np.int64)
    held = np.zeros((len(size), longest - 1), np.int64)
    for k in range(1, longest):
        held[:, k - 1] = np.where(up[k] >= 0, f[up[k]], before.get((me, k), 0))
        child = np.flatnonzero((size == k + 1) & (up[k] >= 0))
        np.maximum.at(ext, up[k][child], f[child])
        mine = np.flatnonzero(size == k)
        if len(mine):
            ext[mine[-1]] = max(ext[mine[-1]], after.get((me, k), 0))
    flat = pa.array(held[np.arange(longest - 1)[None, :] < (size - 1)[:, None]])
    parts = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size - 1))), pa.int32()), flat)
    table = table.append_column("parts", parts).append_column("ext", pa.array(ext))
    yield from table.to_batches(max_chunksize=20_000)


def walked(stream: DataFrame, order: list[Column], rows: int, longest: int) -> DataFrame:
    """``stream`` sorted by ``order`` over partitions, then walked: ``parts`` and ``ext`` are appended.

    The sorted partitions are checkpointed, because both walks must meet the same ones in the order of the sort: files of
    a written table would be read by size, several in one partition.
    """
    count = min(PARTS, max(1, -(-rows // ROWS_A_PART)))
    held = checkpointed(stream.repartitionByRange(count, *order).sortWithinPartitions(*order))
    edges = arrow_stage(held.select("size", "f"), edge_batches, "part int, k int, last long, head long", longest).collect()
    schema = ", ".join(f"{n} {t}" for n, t in held.dtypes) + ", parts array<long>, ext long"
    return arrow_stage(held, walk_batches, schema, longest, *settle(edges, longest))


def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: (lang, phrase, size, f, lefts, rights, n) to candidates with their lowest-scoring cut, in whole numbers.

    ``rights`` holds the counts of the last 1, 2, … words, so cut k of a phrase of m words takes its entry m - k.
    """
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()),
                        ("n", pa.int64()), ("score", pa.int64())])
    for batch in batches:
        out = []
        for lang, phrase, a, lefts, rights, n in zip(*(batch.column(i).to_pylist() for i in range(6))):
            s, _, l, r = min((1000 * a * n // (l * r), k, l, r) for k, (l, r) in enumerate(zip(lefts, reversed(rights)), 1))
            out.append((lang, phrase, a, l, r, n, s))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema) if out else \
            pa.RecordBatch.from_pylist([], schema=schema)


def collocations(docs: DataFrame, least: int = 100, top: int | None = 2000, share: int = 100, longest: int = LONGEST, *,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of every language (all: None).

    A phrase goes if one that contains it has at least ``share`` percent of its count; as counts only fall with the
    length, it is enough to look at the phrases that have one word more.
    """
    counted, words = frequent(docs, least, longest, lang_col=lang_col, text_col=text_col)
    stream = counted.withColumn("w", F.split("phrase", " ", -1))
    rows = counted.count()
    word = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(""))
    forward = walked(stream, [F.col("lang"), *(word(i) for i in range(longest))], rows, longest)
    forward = forward.withColumnsRenamed({"parts": "lefts", "ext": "ext_right"}).withColumn("w", F.reverse("w"))
    backward = walked(forward, [F.col("lang"), *(word(i) for i in range(longest))], rows, longest)
    kept = backward.where("size > 1").where(F.greatest("ext", "ext_right") * 100 < F.col("f") * share)
    # One row a language; the sum of a text's words over a whole language is no larger than the table of languages.
    full = kept.join(words, "lang").select("lang", "phrase", F.col("f").alias("a"), "lefts", F.col("parts").alias("rights"), "n")
    scored = arrow_stage(full, score_batches, "lang string, phrase string, a long, l long, r long, n long, score long")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\f\r]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, size, w[i:i + size - 1] AS p, count(*) AS f
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS size) s WHERE len(w) >= size)
  GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, k, l.f AS l, r.f AS r, n, CAST(1000 * CAST(c.f AS HUGEINT) * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM grams WHERE size > 1) c JOIN totals USING (lang)
  JOIN grams l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN grams r ON r.lang = c.lang AND r.p = c.p[k + 1:]),
inside AS (
  SELECT DISTINCT s.lang, s.p FROM (SELECT lang, size, p, f, unnest(range(1, size)) AS m FROM grams) b
  JOIN grams s ON s.lang = b.lang AND s.size = b.m AND (s.p = b.p[1:m] OR s.p = b.p[2:m + 1] OR s.p = b.p[3:m + 2] OR s.p = b.p[4:m + 3])
  WHERE 100 * b.f >= 100 * s.f),
best AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score
  FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS place FROM cuts)
  WHERE place = 1 AND (lang, p) NOT IN (SELECT (lang, p) FROM inside))
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000
"""
