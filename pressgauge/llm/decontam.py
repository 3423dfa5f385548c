"""Benchmark decontamination: CGK embedding, repeated bit-sampling, exact edit verification.

The CGK embedding walks over a window of words with a random bit per (step, word): each step writes the current word and
moves on if the bit is set. Two windows that differ by few edits write the same words at most steps, so their edit
distance becomes a Hamming distance, and a few sampled steps agree with a probability that falls with it.

Every repetition has walks and sampled steps of its own. For each item it starts at one place of the item, its anchor;
the anchors of an item's repetitions are spread over all its places, so one edited word spoils few of them. The key is
made of the words at the sampled steps, until ``DISTINCT`` different places are among them or the item-sized window
ends. A document's words are tried as the start of such a walk wherever they are an anchor of some item; keys are
compared step by step, so walks that differ from all items are dropped early. The number of repetitions is taken, for
each item length, from simulated edits: twice as many as find ``recall`` of the passages with the most edits allowed.

What shares a whole key is verified: the item's exact word edit distance to the best part of the window and its
surroundings, in words, at most ``(1 - similarity)`` of the item's words. Candidates come in slices of bounded size,
whatever the number of items with the same key, and a text's candidates of one item are verified together.

Words are lower-cased runs of letters and digits, compared as 64-bit hashes. Defined cases: null and empty texts hold no
word and never match; items of fewer than ``least_words`` words (at least 1; items under five words allow no edit)
match nothing; equal items of different ids are reported each; repeated documents are judged each on their own; an empty
benchmark or an empty table gives no match; other columns are carried along.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pressgauge.llm.common import arrow_stage

WORD = re.compile(r"[^\W_]+").findall
STEPS = 14                # of a walk, at most
DISTINCT = 3              # different places of a whole key
SAMPLED = 0.7             # share of the steps that are sampled
RECALL = 1.0              # of simulated passages with the most edits allowed
TRIALS = 1_000            # simulated passages for each item length
MARGIN = 2                # times the repetitions that found them are made
LEAST_WORDS = 5
TABLE = 1 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)
BLOCK_WORDS = 2_000_000   # words of the items that one pass over the documents holds
CHUNK_WORDS = 300_000
SLICE = 1_000_000         # candidates held at once
CACHE_WORDS = 600_000
_WORDS: dict[str, int] = {}


def most_edits(words: int, similarity: float) -> int:
    """Edits that an item of so many words may have."""
    return int((1 - similarity) * words + 1e-9)


def word_codes(text: str | None) -> np.ndarray:
    """Nonzero 64-bit codes of the words."""
    words = WORD((text or "").lower())
    known = _WORDS
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) or 1
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


@cache
def walk(repetition: int) -> tuple[tuple[int, ...], tuple[bool, ...]]:
    """A repetition's odd multiplier for every step, whose top bit with a word moves the walk on, and its sampled steps.

    The first step, the anchor itself, is always sampled.
    """
    rng = np.random.default_rng([11, repetition])
    odd = tuple(int(v) * 2 + 1 for v in rng.integers(0, 1 << 62, STEPS))
    return odd, tuple([True, *(rng.random(STEPS - 1) < SAMPLED).tolist()])


def anchor(repetition: int, words: int) -> int:
    """The place of an item at which a repetition starts: evenly spread, and never the last where there are more."""
    return int(repetition * 0.6180339887498949 % 1 * max(1, words - 1))


def key_path(words: list[int], start: int, end: int, repetition: int) -> list[int]:
    """The keys after each step of a walk over ``words[start:end]``; the last one is the whole key."""
    odd, sampled = walk(repetition)
    keys, key, at, seen = [], 0, start, set()
    for j in range(STEPS):
        if at >= end:
            break
        if sampled[j]:
            seen.add(at)
            key = (key * int(PRIME) + words[at]) % (1 << 64)
        keys.append(key)
        if len(seen) == DISTINCT:
            break
        at += odd[j] * words[at] >> 63 & 1
    return keys


@cache
def repetitions(words: int, similarity: float, recall: float) -> int:
    """``MARGIN`` times the repetitions after which ``recall`` of simulated passages with the most edits share a whole key
    with their item."""
    most = most_edits(words, similarity)
    if not most:
        return 1
    rng = np.random.default_rng([5, words])
    left = []
    for _ in range(TRIALS):
        item = rng.integers(1, 1 << 62, words).tolist()
        passage = list(item)
        for at in sorted(rng.choice(words, most, replace=False).tolist(), reverse=True):
            kind = rng.integers(0, 3)            # a word is replaced, left out, or another put before it
            passage[at:at + (kind < 2)] = [] if kind == 1 else [int(rng.integers(1, 1 << 62))]
        left.append((item, [*passage, *rng.integers(1, 1 << 62, STEPS).tolist()]))
    done = 0
    while len(left) > (1 - recall) * TRIALS:
        rest = []
        for item, passage in left:
            start = anchor(done, words)
            whole = key_path(item, start, words, done)
            place = passage.index(item[start]) if item[start] in passage else -1
            if place < 0 or len(whole) > len(path := key_path(passage, place, len(passage), done)) or path[len(whole) - 1] != whole[-1]:
                rest.append((item, passage))
        left, done = rest, done + 1
    return MARGIN * done


class Index:
    """Items and, for each repetition, the keys of their walks, step by step."""

    def __init__(self, items: list[tuple[int, np.ndarray]], similarity: float = 0.8, least_words: int = LEAST_WORDS,
                 planned: dict[int, int] | None = None) -> None:
        """``planned``: repetitions by item length; simulated here where not given."""
        self.similarity = similarity
        self.items = [(i, w) for i, w in items if len(w) >= max(1, least_words)]
        times = [planned[len(w)] if planned else repetitions(len(w), similarity, RECALL) for _, w in self.items]
        self.count = max(times, default=0)
        #: Bit r of a word's entry: it is an anchor in repetition r, 64 repetitions a table.
        self.anchors = [np.zeros(TABLE, dtype=np.uint64) for _ in range(0, self.count, 64)]
        onward: list[list[set[int]]] = [[set() for _ in range(STEPS)] for _ in range(self.count)]
        final: list[list[list[tuple[int, int, int]]]] = [[[] for _ in range(STEPS)] for _ in range(self.count)]
        for row, (_, item) in enumerate(self.items):
            words = item.tolist()
            for r in range(times[row]):
                start = anchor(r, len(words))
                keys = key_path(words, start, len(words), r)
                self.anchors[r // 64][words[start] % TABLE] |= np.uint64(1 << r % 64)
                for j, k in enumerate(keys[:-1]):
                    onward[r][j].add(k)
                final[r][len(keys) - 1].append((keys[-1], row, start))
        self.onward = [[np.array(sorted(x), dtype=np.uint64) for x in each] for each in onward]
        self.final = [[_columns(sorted(x)) for x in each] for each in final]

    def candidates(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Slices of rows (item row, window start, place of the anchor); ``x`` ends with at least STEPS zeros."""
        for table in range(len(self.anchors)):
            flags = self.anchors[table][x & np.uint64(TABLE - 1)]
            some = np.flatnonzero((flags != 0) & (x != 0))
            flags = flags[some]
            for r in range(64 * table, min(self.count, 64 * table + 64)):
                yield from self._walks(x, some[(flags >> np.uint64(r % 64) & np.uint64(1)).astype(bool)], r)

    def _walks(self, x: np.ndarray, place: np.ndarray, r: int) -> Iterator[np.ndarray]:
        odd, sampled = walk(r)
        at, key = place, np.zeros(len(place), dtype=np.uint64)
        for j in range(STEPS):
            if not len(place):
                return
            w = x[at]
            if sampled[j]:
                key = key * PRIME + w
            keys, rows, starts = self.final[r][j]
            if len(keys):
                lo = np.searchsorted(keys, key, "left")
                hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == key)
                lo, times = lo[hit], np.searchsorted(keys, key[hit], "right") - lo[hit]
                ends = np.cumsum(times)
                for a in range(0, int(ends[-1]) if len(hit) else 0, SLICE):
                    nth = np.arange(a, min(a + SLICE, int(ends[-1])))
                    of = np.searchsorted(ends, nth, side="right")
                    entry = lo[of] + nth - (ends[of] - times[of])
                    where = place[hit[of]]
                    yield np.stack([rows[entry], where - starts[entry], where], 1)
            more = self.onward[r][j]
            if not len(more):
                return
            if j and sampled[j]:               # before that, a key is the anchor word, which the table has told
                go = more[np.minimum(np.searchsorted(more, key), len(more) - 1)] == key
                place, at, key, w = place[go], at[go], key[go], w[go]
            at = at + (np.uint64(odd[j]) * w >> np.uint64(63)).astype(np.int64)


def _columns(rows: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows], dtype=np.int64),
            np.array([r[2] for r in rows], dtype=np.int64))


def edit_distance_in(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``item`` to any part of ``region``, and where that part ends."""
    m = len(region)
    ramp = np.arange(m + 1)
    row = np.zeros(m + 1, dtype=np.int64)
    for k, w in enumerate(item.tolist(), 1):
        step = np.empty(m + 1, dtype=np.int64)
        step[0] = k
        np.minimum(row[1:] + 1, row[:-1] + (region != w), out=step[1:])
        row = np.minimum.accumulate(step - ramp) + ramp
    end = int(row.argmin())
    return int(row[end]), end


def best_part(item: np.ndarray, words: np.ndarray, at: np.ndarray, most: int) -> tuple[int, int] | None:
    """Least distance up to ``most`` and the first end of such a part, near the window starts ``at`` (ascending)."""
    lo, hi = np.maximum(at - most, 0), np.minimum(at + len(item) + most, len(words))
    base = int(lo[0])
    inside = np.concatenate([[0], np.cumsum(np.isin(words[base:int(hi[-1])], item))])
    # A part that is near enough shares so many words with the item at least.
    good = inside[hi - base] - inside[lo - base] >= len(item) - most
    lo, hi = lo[good], hi[good]
    best = None
    # Windows that overlap are one region.
    cuts = np.flatnonzero(lo[1:] > hi[:-1]) + 1
    for a, b in zip(lo[[0, *cuts]] if len(lo) else [], hi[[*(cuts - 1), -1]] if len(hi) else []):
        distance, end = edit_distance_in(item, words[a:b])
        if distance <= most and (best is None or distance < best[0]):
            best = (distance, int(a) + end)
    return best


def matches(index: Index, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    """Per text: (item id, item words, least distance, word at which the match ends), one for each item that it holds."""
    best: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
    held: list[tuple[int, np.ndarray]] = []
    size, gap = 0, np.zeros(STEPS + 1, dtype=np.uint64)

    def verify(some: np.ndarray, starts: np.ndarray) -> None:
        row, start, place = some.T
        doc = np.searchsorted(starts, place, side="right") - 1
        order = np.lexsort((start, row, doc))
        row, start, doc = row[order], start[order], doc[order]
        edges = np.flatnonzero(np.diff(doc) | np.diff(row)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(row)]):
            d, k = int(doc[lo]), int(row[lo])
            item, seen = index.items[k][1], best[held[d][0]]
            got = best_part(item, held[d][1], np.unique(start[lo:hi]) - starts[d], most_edits(len(item), index.similarity))
            if got and (k not in seen or got < seen[k]):
                seen[k] = got

    def flush() -> None:
        starts = np.cumsum([0] + [len(w) + len(gap) for _, w in held])
        waiting, rows = [], 0
        for some in index.candidates(np.concatenate([y for _, w in held for y in (w, gap)])):
            waiting.append(some)
            rows += len(some)
            if rows >= SLICE:
                verify(np.concatenate(waiting), starts)
                waiting, rows = [], 0
        if rows:
            verify(np.concatenate(waiting), starts)

    for i, text in enumerate(texts):
        words = word_codes(text)
        if len(words):
            held.append((i, words))
            size += len(words) + len(gap)
        if size >= CHUNK_WORDS:
            flush()
            held, size = [], 0
    if held:
        flush()
    return [[(index.items[k][0], len(index.items[k][1]), *b) for k, b in sorted(each.items())] for each in best]


_READY: dict[tuple, Index] = {}


def _index(items: list[tuple[int, bytes]], similarity: float, least_words: int, planned: dict[int, int]) -> Index:
    name = (zlib.crc32(b"".join(w for _, w in items)), tuple(i for i, _ in items[:16]), len(items), similarity, least_words)
    if name not in _READY:
        _READY.clear()
        _READY[name] = Index([(i, np.frombuffer(w, np.uint64)) for i, w in items], similarity, least_words, planned)
    return _READY[name]


def match_batches(batches: Iterator[pa.RecordBatch], items: list, *settings) -> Iterator[pa.RecordBatch]:
    """Task: (doc_id, text) to one row for each document and item that it holds."""
    index = _index(items, *settings)
    kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int32()),
                       ("distance", pa.int32()), ("end_word", pa.int64())])
    for batch in batches:
        found = matches(index, batch.column(1).to_pylist())
        rows = [(d, *m) for d, each in zip(batch.column(0).to_pylist(), found) for m in each]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)


def clean_batches(batches: Iterator[pa.RecordBatch], at: int, items: list, *settings) -> Iterator[pa.RecordBatch]:
    """Task: the rows whose text, column ``at``, holds no item."""
    index = _index(items, *settings)
    for batch in batches:
        found = matches(index, batch.column(at).to_pylist())
        out = batch.filter(pa.array([not f for f in found]))
        if out.num_rows:
            yield out


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int, least_words: int) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's items as word codes, in blocks of bounded size."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator()
    for item_id, text in rows:
        words = word_codes(text)
        if len(words) >= max(1, least_words):
            block.append((item_id, words.tobytes()))
            size += len(words)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def planned(block: list[tuple[int, bytes]], similarity: float, recall: float) -> dict[int, int]:
    """Repetitions for each length of the items, in words of 8 bytes."""
    return {n: repetitions(n, similarity, recall) for n in sorted({len(w) // 8 for _, w in block})}


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block_words: int = BLOCK_WORDS, *,
                 recall: float = RECALL, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``doc_id, item_id, item_words, distance, end_word``: a row for each document and item that it holds.

    The benchmark is the stated query set; a pass over the documents takes one block of its words. No row is shuffled.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, item_words int, distance int, end_word long"
    out = None
    for block in item_blocks(benchmark, item_col, "text", block_words, least_words):
        part = arrow_stage(narrow, match_batches, schema, block, similarity, least_words, planned(block, similarity, recall))
        out = part if out is None else out.unionByName(part)
    return narrow.sparkSession.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block_words: int = BLOCK_WORDS, *,
               recall: float = RECALL, least_words: int = LEAST_WORDS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    out, names = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))]), docs.columns
    for block in item_blocks(benchmark, "item_id", "text", block_words, least_words):
        out = arrow_stage(out, clean_batches, out.schema, names.index(text_col), block, similarity, least_words,
                          planned(block, similarity, recall))
    return out.toDF(*names)
