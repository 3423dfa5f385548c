"""Packing along a space-filling curve.

Every document becomes a hashed count vector of its token ids, projected to a few dimensions. The dimensions are
standardised with means and deviations over all documents, and each document gets the Hilbert index of its cell.
Documents are range-sorted by that index and laid end to end; sequences are cut every ``length`` ids, across documents
where it falls so. What is left at the very end is cut into sequences whose lengths are powers of two, which need no
padding.

Defined cases: a null text counts as empty; an empty text is the end id alone; repeated rows are packed as often as
they come; null ids are carried along; ties on the curve are ordered by a hash drawn once when the ids are written; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from pressgauge.llm.common import arrow_stage, written
from pressgauge.llm.tokens import encoder

DIMS = 4
BITS = 8                   # of each dimension on the curve
HASHED = 1 << 11           # cells of the hashed count vector
TIE_BITS = 62 - DIMS * BITS
RUN_IDS = 2 << 20          # ids of a sorted run, on average
_PROJECTION: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def projection(dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """The cell of every 16-bit token id, and a fixed random projection of the cells."""
    if dims not in _PROJECTION:
        rng = np.random.default_rng(20240731)
        _PROJECTION[dims] = rng.integers(0, HASHED, 1 << 16), rng.standard_normal((HASHED, dims)).astype(np.float32)
    return _PROJECTION[dims]


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of the rows of ``cells``, whose values have ``bits`` bits each."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:                       # undo the rotations, from the largest cube to the smallest
        low = bit - 1
        for d in range(dims):
            inside = (x[d] & bit) != 0
            swap = np.where(inside, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[d] ^= swap
        bit >>= 1
    for d in range(1, dims):             # Gray code
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where(x[dims - 1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):    # interleave
        for d in range(dims):
            out = (out << 1) | ((x[d] >> b) & 1)
    return out


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Task: (doc_id, text) to ids, their number and the projected vector."""
    code, end = encoder(path), np.array([end_id], dtype="<u2").tobytes()
    cell, matrix = projection()
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        ids = [code.ids(t.as_py() or "") + end for t in batch.column(1)]
        points = np.empty((len(ids), DIMS), dtype=np.float64)
        for i, x in enumerate(ids):
            counts = np.bincount(cell[np.frombuffer(x, "<u2")], minlength=HASHED)
            used = np.flatnonzero(counts)
            weight = np.log1p(counts[used]).astype(np.float32)
            points[i] = (weight @ matrix[used]) / np.sqrt(weight @ weight)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(list(points), pa.list_(pa.float64())),
             pa.array([squeeze(x) for x in ids], pa.binary())], names=["doc_id", "n", "point", "ids"])


def key_batches(batches: Iterator[pa.RecordBatch], mean: list[float], spread: list[float],
                edges: list[int] | None) -> Iterator[pa.RecordBatch]:
    """Task: (…, point, tie) to (…, run, key): the place on the curve, and the run between two edges that holds it."""
    centre, scale = np.array(mean), np.array(spread)
    bounds = None if edges is None else np.array(edges, dtype=np.int64)
    for batch in batches:
        k = batch.num_columns
        points = np.array(batch.column(k - 2).to_pylist(), dtype=np.float64).reshape(-1, DIMS)
        z = (points - centre) / scale
        share = 0.5 * (1 + np.tanh(0.7978845608 * (z + 0.044715 * z ** 3)))   # close to the normal distribution function
        cells = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
        key = (hilbert_index(cells, BITS) << TIE_BITS) | np.asarray(batch.column(k - 1))
        columns, names = [*batch.columns[:-2]], [*batch.schema.names[:-2]]
        if bounds is not None:
            columns.append(pa.array(np.searchsorted(bounds, key, side="right"), pa.int32()))
            names.append("run")
        yield pa.RecordBatch.from_arrays([*columns, pa.array(key, pa.int64())], names=[*names, "key"])


def tail_starts(rest: int) -> list[int]:
    """Where the power-of-two sequences of a rest of ``rest`` ids start, and ``rest`` itself."""
    starts, at = [], 0
    while at < rest:
        starts.append(at)
        at += 1 << ((rest - at).bit_length() - 1)
    return [*starts, rest]


def piece_batches(batches: Iterator[pa.RecordBatch], base: dict[int, int], total: int, length: int) -> Iterator[pa.RecordBatch]:
    """Task: rows sorted by (run, key) to pieces, from the position at which each run starts."""
    full = total // length
    tail = tail_starts(total - full * length)
    run, at = None, 0
    unpack = zstandard.ZstdDecompressor().decompress
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    for batch in batches:
        rows: list[tuple] = []
        for r, d, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if r != run:
                run, at = r, base[r]
            ids = np.frombuffer(unpack(blob.as_py()), "<u2").astype("<u4")
            raw, n, done = memoryview(ids).cast("B"), len(ids), 0
            while done < n:
                sequence, offset = divmod(at, length)
                room = length - offset
                if sequence == full:
                    k = int(np.searchsorted(tail, offset, side="right")) - 1
                    sequence, room, offset = full + k, tail[k + 1] - offset, offset - tail[k]
                size = min(room, n - done)
                rows.append((d, done, size, zlib.crc32(raw[4 * done:4 * (done + size)]), n, sequence, offset))
                done, at = done + size, at + size
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pack(docs: DataFrame, path: str, end_id: int = 2, length: int = 4096, run_ids: int = RUN_IDS, *,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Ids are made once and written. Means, deviations, run edges and run totals are aggregates over the narrow columns
    of all documents; only the runs' edges and starts (one number per ``run_ids`` ids) reach the driver. The one wide
    shuffle moves compressed ids to their run, where they are sorted and cut while streaming.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    coded = arrow_stage(narrow, encode_batches, "doc_id long, n long, point array<double>, ids binary", path, end_id)
    tie = F.xxhash64("doc_id", F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    coded = written(coded.withColumn("tie", tie), "packed-ids", "none")
    stats = coded.agg(F.sum("n"), *(f(F.col("point")[d]) for d in range(DIMS) for f in (F.mean, F.stddev_pop))).first()
    total = int(stats[0] or 0)
    mean, spread = [stats[1 + 2 * d] or 0.0 for d in range(DIMS)], [max(stats[2 + 2 * d] or 0.0, 1e-9) for d in range(DIMS)]
    runs = max(1, -(-total // run_ids))
    edges: list[int] = []
    if runs > 1:
        keys = arrow_stage(coded.select("point", "tie"), key_batches, "key long", mean, spread, None)
        shares = [k / runs for k in range(1, runs)]
        edges = sorted(set(keys.agg(F.percentile_approx("key", shares, 20 * runs)).first()[0]))
    totals = arrow_stage(coded.select("n", "point", "tie"), key_batches, "n long, run int, key long", mean, spread, edges)
    base, at = {}, 0
    for row in totals.groupBy("run").agg(F.sum("n").alias("n")).orderBy("run").collect():
        base[row.run], at = at, at + row.n
    placed = arrow_stage(coded.select("doc_id", "ids", "point", "tie"), key_batches,
                         "doc_id long, ids binary, run int, key long", mean, spread, edges)
    ordered = placed.repartition("run").sortWithinPartitions("run", "key").select("run", "doc_id", "ids")
    return arrow_stage(ordered, piece_batches, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                       "sequence_id long, offset long", base, total, length)
