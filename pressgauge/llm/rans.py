"""Token-ID output: a static range asymmetric numeral system over interleaved blocks.

Documents are range-partitioned and sorted by id as text; each task turns its documents into token ids and closes a
shard whenever enough ids are gathered. A shard is one self-contained binary value: one frequency table that all its
blocks share, independent blocks of many interleaved lanes, checkpoints (lane states and word position) inside each
block, and checksums of every block and of all ids. Any checkpoint can start a decoder, so a shard is decoded with all
its chunks side by side.

Defined cases: a null text counts as empty; an empty text is the end id alone; repeated rows are documents of their
own; null ids sort first; rows of one id are ordered by a hash of the text, then by their place in the input; an empty
table gives no shard and no row; other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pressgauge.llm.common import arrow_stage, written
from pressgauge.llm.tokens import encoder

MAGIC = b"PGR1"
SCALE = 18               # slots of the frequency table, as a power of two: more than there are 16-bit symbols
LANES = 256              # interleaved coders of a block
CHUNK_STEPS = 256        # steps between checkpoints
BLOCK_CHUNKS = 4         # chunks of a block
SHARD_IDS = 4 << 20      # ids after which a shard is closed
HEAD = struct.Struct("<4sQQIIIIIIII")
LOW = np.uint64(1 << 31)
SHARDS = "part int, shard int, first_id long, n_docs long, n_ids long, blob binary"


class Damaged(ValueError):
    """A checksum does not fit."""


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur, ascending, and their shares of ``2**SCALE``; every share is at least one."""
    counts = np.bincount(ids, minlength=1)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols].astype(np.int64)
    room = (1 << SCALE) - len(symbols)
    freq = 1 + counts * room // int(counts.sum())
    freq[counts.argmax()] += (1 << SCALE) - int(freq.sum())
    return symbols.astype("<u2"), freq.astype("<u4")


def encode_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The binary form of a shard: ``ids`` of all its documents on end, and each document's id and length."""
    n = len(ids)
    symbols, freq = frequency_table(ids)
    slot = np.zeros(int(symbols[-1]) + 1, dtype=np.int64)
    slot[symbols] = np.arange(len(symbols))
    cum = np.concatenate(([0], np.cumsum(freq[:-1], dtype=np.uint64))).astype(np.uint64)
    blocks = -(-n // (LANES * CHUNK_STEPS * BLOCK_CHUNKS))
    steps = -(-n // (blocks * LANES))
    chunks = -(-steps // CHUNK_STEPS)
    per_chunk = -(-steps // chunks)
    steps = chunks * per_chunk
    padded = np.full(blocks * steps * LANES, slot[symbols[freq.argmax()]], dtype=np.int64)
    padded[:n] = slot[ids]
    lanes = padded.reshape(blocks, steps, LANES)
    wide = freq.astype(np.uint64)
    state = np.full((blocks, LANES), LOW, dtype=np.uint64)
    marks = np.empty((blocks, chunks, LANES), dtype="<u8")
    emitted = np.empty((blocks, steps, LANES), dtype=bool)
    words = np.empty((blocks, steps, LANES), dtype="<u4")
    shift, half = np.uint64(63 - SCALE), np.uint64(32)
    for s in range(steps - 1, -1, -1):
        at = lanes[:, s]
        f = wide[at]
        full = state >= (f << shift)
        emitted[:, s], words[:, s] = full, state.astype(np.uint32)
        state = np.where(full, state >> half, state)
        whole = state // f
        state = (whole << np.uint64(SCALE)) + (state - whole * f) + cum[at]
        if s % per_chunk == 0:
            marks[:, s // per_chunk] = state
    position = np.zeros((blocks, chunks + 1), dtype="<u4")
    position[:, 1:] = np.cumsum(emitted.reshape(blocks, chunks, -1).sum(2), 1)
    streams = [words[b][emitted[b]].tobytes() for b in range(blocks)]
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    docs = zlib.compress(known.tobytes() + np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()
                         + lengths.astype("<i8").tobytes(), 1)
    table = zlib.compress(symbols.tobytes() + freq.tobytes(), 6)
    sums = [zlib.crc32(x, zlib.crc32(marks[b].tobytes())) for b, x in enumerate(streams)]
    body = [docs, table, position.tobytes(), np.array([[len(x) for x in streams], sums], dtype="<u4").tobytes(),
            marks.tobytes(), *streams]
    head = HEAD.pack(MAGIC, n, len(doc_ids), blocks, chunks, per_chunk, LANES, len(docs), len(table), len(symbols),
                     zlib.crc32(ids.astype("<u4").tobytes()))
    return head + b"".join(body)


def decode_shard(blob: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """Ids, document ids and lengths of a shard; raises ``Damaged`` where a checksum does not fit."""
    view = memoryview(blob)
    magic, n, n_docs, blocks, chunks, per_chunk, n_lanes, len_docs, len_table, n_symbols, total = HEAD.unpack_from(view)
    if magic != MAGIC:
        raise Damaged("not a shard")
    at = HEAD.size

    def take(size: int) -> memoryview:
        nonlocal at
        at += size
        return view[at - size:at]

    raw = zlib.decompress(take(len_docs))
    known = np.frombuffer(raw, np.uint8, n_docs)
    doc_ids = np.frombuffer(raw, "<i8", n_docs, n_docs)
    lengths = np.frombuffer(raw, "<i8", n_docs, 9 * n_docs)
    table = zlib.decompress(take(len_table))
    symbols = np.frombuffer(table, "<u2", n_symbols)
    freq = np.frombuffer(table, "<u4", n_symbols, 2 * n_symbols).astype(np.uint64)
    position = np.frombuffer(take(4 * blocks * (chunks + 1)), "<u4").reshape(blocks, chunks + 1).astype(np.int64)
    sizes, sums = np.frombuffer(take(8 * blocks), "<u4").reshape(2, blocks)
    marks = np.frombuffer(take(8 * blocks * chunks * n_lanes), "<u8").reshape(blocks, chunks, n_lanes)
    streams = [take(int(x)) for x in sizes]
    for b in range(blocks):
        if zlib.crc32(streams[b], zlib.crc32(marks[b].tobytes())) != sums[b]:
            raise Damaged(f"block {b}")
    start = np.concatenate(([0], np.cumsum(sizes[:-1].astype(np.int64) // 4)))
    stream = np.concatenate([np.frombuffer(x, "<u4") for x in streams]).astype(np.uint64)
    stream = np.append(stream, np.zeros(1, np.uint64))
    of_slot = np.repeat(np.arange(n_symbols, dtype=np.uint16), freq.astype(np.int64))
    cum = np.concatenate(([0], np.cumsum(freq[:-1]))).astype(np.uint64)
    state = marks.reshape(blocks * chunks, n_lanes).astype(np.uint64)
    at_word = (start[:, None] + position[:, :-1]).reshape(-1)
    out = np.empty((blocks * chunks, per_chunk, n_lanes), dtype=np.uint16)
    mask, half = np.uint64((1 << SCALE) - 1), np.uint64(32)
    for s in range(per_chunk):
        low = state & mask
        k = of_slot[low.astype(np.int64)]
        out[:, s] = k
        state = freq[k] * (state >> np.uint64(SCALE)) + low - cum[k]
        short = state < LOW
        taken = np.cumsum(short, axis=1)
        where = at_word[:, None] + taken - 1
        state = np.where(short, (state << half) | stream[np.where(short, where, -1)], state)
        at_word = at_word + taken[:, -1]
    ids = symbols[out.reshape(-1)[:n]]
    if zlib.crc32(ids.astype("<u4").tobytes()) != total:
        raise Damaged("ids")
    return ids, [int(d) if k else None for d, k in zip(doc_ids, known)], lengths


def pack_shards(batches: Iterator[pa.RecordBatch], path: str, end_id: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    """Task: sorted (id, text) batches to shards."""
    kinds = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int64()),
                       ("n_ids", pa.int64()), ("blob", pa.binary())])
    end, code, part = np.array([end_id], dtype="<u2").tobytes(), encoder(path), TaskContext.get().partitionId()
    held, doc_ids, lengths, size, shard = [], [], [], 0, 0

    def close() -> pa.RecordBatch:
        blob = encode_shard(np.frombuffer(b"".join(held), "<u2"), doc_ids, np.array(lengths))
        return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "first_id": doc_ids[0], "blob": blob,
                                            "n_docs": len(doc_ids), "n_ids": size}], schema=kinds)

    for batch in batches:
        for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = code.ids(text.as_py()) + end
            held.append(ids)
            doc_ids.append(d)
            lengths.append(len(ids) // 2)
            size += len(ids) // 2
            if size >= shard_ids:
                yield close()
                held, doc_ids, lengths, size, shard = [], [], [], 0, shard + 1
    if doc_ids:
        yield close()


def encode_documents(docs: DataFrame, path: str, end_id: int = 0, shard_ids: int = SHARD_IDS, *,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``SHARDS``, in ascending document order by (part, shard), not yet written.

    The one shuffle carries (id, text); hash and input place are tie-breakers that also let the range partitioner split
    an id that very many rows share. A task holds the ids of one shard; a document longer than a shard fills one alone.
    """
    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
               .withColumns({"_tie": F.xxhash64("text"), "_at": F.monotonically_increasing_id()})
               .repartitionByRange("doc_id", "_tie", "_at").sortWithinPartitions("doc_id", "_tie", "_at")
               .select("doc_id", "text"))
    return arrow_stage(ordered, pack_shards, SHARDS, path, end_id, shard_ids)


def unpack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: shards to one narrow row per document."""
    kinds = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("inner", pa.int64()),
                       ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for part, shard, blob in zip(*(batch.column(i) for i in range(3))):
            ids, doc_ids, lengths = decode_shard(blob.as_py())
            wide, ends = memoryview(ids.astype("<u4")).cast("B"), np.cumsum(lengths)
            starts = ends - lengths
            sums = [zlib.crc32(wide[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            rows = len(doc_ids)
            yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * rows, pa.int32()),
                                              pa.array([shard.as_py()] * rows, pa.int32()),
                                              pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()),
                                              pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], schema=kinds)


def decode_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from stored shards.

    Shards are decoded where they lie. The ids before each shard come from the shards' own totals, summed by part and
    then within the part, and meet the narrow decoded rows in a join on the shard.
    """
    decoded = arrow_stage(shards.select("part", "shard", "blob"), unpack_shards,
                          "part int, shard int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    earlier = F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = (shards.select("part", "shard", "n_ids").join(parts.select("part", earlier.alias("base")), "part")
              .select("part", "shard", (F.col("base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("base")))
    return decoded.join(before, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"),
                                                          "n_tokens", "ids_crc32")


def write_token_ids(docs: DataFrame, path: str, end_id: int = 0, **columns: str) -> DataFrame:
    """Encode ``docs`` into the shared folder and return the shards as read back from there."""
    return written(encode_documents(docs, path, end_id, **columns), "token-ids", "none")
