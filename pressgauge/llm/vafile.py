"""Exact top-k by inner product with a vector-approximation file.

Vectors become integers, floor(scale * x). The approximation file keeps each component as one of ``2**bits`` equal cells
between the least and the largest value of its dimension; rows lie in chunks of bounded size, each with its cells and,
apart, its exact vectors. A query's inner product with anything in a cell box has an upper and a lower bound from one
matrix product over the cells.

First pass: tasks give, per query, the k largest lower bounds of their chunks; their global kth is a score that the kth result cannot
fall below. Second pass: a chunk's rows whose upper bound reaches it are read exactly, in descending order of the bound,
until the next bound lies under the kth exact score found. The best k per chunk and query meet in a rank.

Queries and chunks meet as packed blocks on a grid, never as rows: each chunk row is copied once for each query block
(about ``query_rows`` queries, dealt by hash), each query block once for each of ``lanes`` groups of chunks. No side goes
through the driver.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part; missing trailing components
count as zero; repeated rows and rows of null id are candidates of their own (null ids sort last among ties and are no
queries); components of any size up to 2**62 after scaling are scored exactly, in Python's integers where 64 bits might
not hold a sum, and a score that itself needs more than 64 bits ends the job; an empty table gives no row; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pressgauge.llm.common import arrow_stage, written

SCALE = 1024
BITS = 6
CHUNK_ROWS = 4096
QUERY_ROWS = 4096
LANES = 64
SLAB = 512                # rows of a chunk whose bounds are held at once
HELD_BLOCKS = 64          # query blocks whose best bounds a task keeps
LARGEST = 1 << 62


def whole_vectors(rows: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Integer matrix of a list column, zero-padded to ``dims``."""
    sizes = np.asarray(rows.value_lengths())
    flat = np.floor(np.asarray(rows.flatten(), dtype=np.float64) * scale)
    if len(flat) and np.abs(flat).max() >= LARGEST:
        raise ValueError("a component is too large for exact scores")
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    out[np.arange(dims)[None] < sizes[:, None]] = flat.astype(np.int64)
    return out


def stored(low: list[int], width: list[int], bits: int) -> str:
    """The type in which exact components are kept: 32 bits where all of them fit."""
    ends = [abs(v) for a, w in zip(low, width) for v in (a, a + (w << bits))]
    return "<i4" if max(ends, default=0) < 1 << 31 else "<i8"


def products(exact: np.ndarray, q: np.ndarray) -> list[int]:
    """Inner products of rows with a vector, exact at any size."""
    if not len(exact):
        return []
    largest = int(max(abs(int(exact.max())), abs(int(exact.min())))) * sum(abs(v) for v in q.tolist())
    if largest < 1 << 62:
        return (exact.astype(np.int64) @ q).tolist()
    out = [sum(a * b for a, b in zip(row, q.tolist())) for row in exact.tolist()]
    if any(abs(v) >= 1 << 63 for v in out):
        raise OverflowError("a score needs more than 64 bits")
    return out


def chunk_batches(batches: Iterator[pa.RecordBatch], dims: int, scale: int, low: list[int], width: list[int],
                  rows: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Task: (id, vector) to packed chunks of at most ``rows`` vectors."""
    lo, wide, part, number = np.array(low), np.array(width), TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            x = whole_vectors(piece.column(1), dims, scale)
            known = np.asarray(piece.column(0).is_valid())
            ids = np.asarray(piece.column(0).fill_null(0)).astype("<i8")
            cells = ((x - lo) // wide).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number], pa.int64()), pa.array([len(x)], pa.int32()),
                 pa.array([ids.tobytes()], pa.binary()), pa.array([known.astype(np.uint8).tobytes()], pa.binary()),
                 pa.array([cells.tobytes()], pa.binary()), pa.array([x.astype(kind).tobytes()], pa.binary())],
                names=["chunk", "size", "ids", "known", "cells", "exact"])
            number += 1


def query_batches(batches: Iterator[pa.RecordBatch], dims: int, divisor: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Task: chunks to the queries among their vectors, a narrow row each."""
    for batch in batches:
        for chunk, ids, known, exact in zip(*(batch.column(k).to_pylist() for k in ("chunk", "ids", "known", "exact"))):
            ids, known = np.frombuffer(ids, "<i8"), np.frombuffer(known, np.uint8)
            asked = np.flatnonzero((known == 1) & (ids % divisor == 0))
            x = np.frombuffer(exact, kind).reshape(-1, dims)[asked]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[asked]), pa.array(np.full(len(asked), chunk)), pa.array(asked.astype(np.int64)),
                 pa.array([r.tobytes() for r in x], pa.binary())], names=["q_id", "own_chunk", "own_row", "q"])


def block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: queries sorted by block to one packed row for each block."""
    block, held = None, []

    def close() -> pa.RecordBatch:
        own = np.array([h[1:3] for h in held], dtype="<i8")
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([np.array([h[0] for h in held], dtype="<i8").tobytes()], pa.binary()),
             pa.array([own.tobytes()], pa.binary()), pa.array([b"".join(h[3] for h in held)], pa.binary())],
            names=["block", "q_ids", "q_own", "q_exact"])

    for batch in batches:
        for b, *query in zip(*(batch.column(k).to_pylist() for k in ("block", "q_id", "own_chunk", "own_row", "q"))):
            if b != block and held:
                yield close()
                held = []
            block = b
            held.append(query)
    if held:
        yield close()


def bounds(cells: np.ndarray, q: np.ndarray, lo: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds of the inner products, cells by queries, widened by what rounding may have taken."""
    base = cells.astype(np.float64) * width @ q.T + q @ lo
    rest = width - 1
    slack = 8 * (q.shape[1] + 4) * 2.0 ** -53 * (np.abs(q) @ (np.abs(lo) + width * 256)) + 2.0 ** -20
    return base + np.maximum(q, 0) @ rest + slack, base + np.minimum(q, 0) @ rest - slack


def _unpacked(batch: pa.RecordBatch, i: int, dims: int, kind: str) -> tuple[np.ndarray, ...]:
    """Query ids, their own places, exact vectors as integers and as floating point, and the chunk's cells."""
    q_ids = np.frombuffer(batch.column("q_ids")[i].as_py(), "<i8")
    q_own = np.frombuffer(batch.column("q_own")[i].as_py(), "<i8").reshape(-1, 2)
    whole = np.frombuffer(batch.column("q_exact")[i].as_py(), kind).reshape(-1, dims).astype(np.int64)
    cells = np.frombuffer(batch.column("cells")[i].as_py(), np.uint8).reshape(-1, dims)
    return q_ids, q_own, whole, whole.astype(np.float64), cells


def _not_own(value: np.ndarray, own: np.ndarray, chunk: int, start: int) -> None:
    """Take each query's own row out of a slab's bounds."""
    mine = np.flatnonzero((own[:, 0] == chunk) & (own[:, 1] >= start) & (own[:, 1] < start + len(value)))
    value[own[mine, 1] - start, mine] = -np.inf


def lower_batches(batches: Iterator[pa.RecordBatch], dims: int, k: int, low: list[int], width: list[int], kind: str) -> Iterator[pa.RecordBatch]:
    """Task: chunks with query blocks to the k largest lower bounds of each query in all chunks of the task."""
    lo, wide = np.array(low, np.float64), np.array(width, np.float64)
    best: dict[int, np.ndarray] = {}

    def emptied() -> Iterator[pa.RecordBatch]:
        for block, b in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(b.shape[1], block)), pa.array(np.arange(b.shape[1])),
                 pa.array([x[x > -np.inf].tolist() for x in b.T], pa.list_(pa.float64()))], names=["block", "nth", "lowers"])
        best.clear()

    for batch in batches:
        for i in range(batch.num_rows):
            q_ids, own, _, q, cells = _unpacked(batch, i, dims, kind)
            chunk, block = batch.column("chunk")[i].as_py(), batch.column("block")[i].as_py()
            if len(best) >= HELD_BLOCKS and block not in best:
                yield from emptied()
            top = best.get(block, np.full((0, len(q_ids)), -np.inf))
            for s in range(0, len(cells), SLAB):
                lower = bounds(cells[s:s + SLAB], q, lo, wide)[1]
                _not_own(lower, own, chunk, s)
                both = np.concatenate([top, lower])
                top = np.partition(both, len(both) - k, axis=0)[-k:] if len(both) > k else both
            best[block] = top
    yield from emptied()


def exact_batches(batches: Iterator[pa.RecordBatch], dims: int, k: int, low: list[int], width: list[int], kind: str) -> Iterator[pa.RecordBatch]:
    """Task: chunk with query block and floors to the chunk's best k of each query, in exact scores."""
    lo, wide = np.array(low, np.float64), np.array(width, np.float64)
    for batch in batches:
        for i in range(batch.num_rows):
            q_ids, own, whole, q, cells = _unpacked(batch, i, dims, kind)
            floors = np.array(batch.column("floors")[i].as_py(), np.float64)
            chunk = batch.column("chunk")[i].as_py()
            ids = np.frombuffer(batch.column("ids")[i].as_py(), "<i8")
            known = np.frombuffer(batch.column("known")[i].as_py(), np.uint8)
            exact = np.frombuffer(batch.column("exact")[i].as_py(), kind).reshape(-1, dims)
            near: list[list] = [[] for _ in q_ids]
            for s in range(0, len(cells), SLAB):
                upper = bounds(cells[s:s + SLAB], q, lo, wide)[0]
                _not_own(upper, own, chunk, s)
                row, nth = np.nonzero((upper >= floors) & (upper > -np.inf))
                for r, n in zip(row.tolist(), nth.tolist()):
                    near[n].append((upper[r, n], s + r))
            rows = []
            for n, some in enumerate(near):
                rows += [(int(q_ids[n]), chunk, int(own[n, 0]), int(own[n, 1]), int(ids[r]) if known[r] else None, r, x)
                         for x, _, _, r in nearest(whole[n], some, exact, ids, known, k)]
            if rows:
                kinds = (pa.int64(),) * 5 + (pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                 names=["query_id", "chunk", "own_chunk", "own_row", "vec_id", "row", "score"])


def nearest(q: np.ndarray, some: list[tuple[float, int]], exact: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> list[tuple]:
    """Best k of the candidates (upper bound, row): exact vectors are read in descending order of the bound, in steps,
    until the next bound lies under the kth exact score."""
    some.sort(key=lambda b: (-b[0], b[1]))
    best: list[tuple] = []
    for at in range(0, len(some), 2 * k):
        if len(best) == k and some[at][0] < best[-1][0]:
            break
        rows = np.array([r for _, r in some[at:at + 2 * k]])
        scores = products(exact[rows], q)
        best += [(int(x), 1 - int(known[r]), int(ids[r]), int(r)) for x, r in zip(scores, rows)]
        best.sort(key=lambda b: (-b[0], b[1], b[2], b[3]))
        del best[k:]
    return best


def top_k(vectors: DataFrame, k: int = 10, divisor: int = 100, scale: int = SCALE, bits: int = BITS, *,
          id_col: str = "vec_id", vector_col: str = "embedding", chunk_rows: int = CHUNK_ROWS,
          query_rows: int = QUERY_ROWS, lanes: int = LANES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row whose id is divisible by ``divisor``."""
    result = "query_id long, chunk long, own_chunk long, own_row long, vec_id long, row int, score long"
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    narrow = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
              .where("v is not null").where(sound))
    dims = narrow.agg(F.max(F.size("v"))).first()[0] or 0
    if not dims:
        dims = 1
    ends = narrow.select(*(F.floor(F.coalesce(F.try_element_at("v", F.lit(d + 1)), F.lit(0.0)) * scale).alias(f"d{d}") for d in range(dims)))
    row = ends.agg(*(f(f"d{d}") for d in range(dims) for f in (F.min, F.max))).first()
    low = [int(row[2 * d] or 0) for d in range(dims)]
    width = [(int(row[2 * d + 1] or 0) - low[d]) // (1 << bits) + 1 for d in range(dims)]
    kind = stored(low, width, bits)
    chunks = written(arrow_stage(narrow, chunk_batches, "chunk long, size int, ids binary, known binary, cells binary, "
                                 "exact binary", dims, scale, low, width, chunk_rows, kind), "va-file", "none")
    asked = written(arrow_stage(chunks.select("chunk", "ids", "known", "exact"), query_batches,
                                "q_id long, own_chunk long, own_row long, q binary", dims, divisor, kind), "queries", "none")
    count = -(-asked.count() // query_rows) or 1
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("own_chunk", "own_row"), F.lit(count)))
    blocks = written(arrow_stage(numbered.repartition("block").sortWithinPartitions("block"), block_batches,
                                 "block long, q_ids binary, q_own binary, q_exact binary"), "query-blocks", "none")
    # One number per query block: the grid's columns.
    names = blocks.select("block").orderBy("block")
    lane = F.pmod(F.xxhash64("chunk"), F.lit(lanes)).cast("int")

    def grid(of_chunks: DataFrame, of_blocks: DataFrame) -> DataFrame:
        """Every chunk with every query block, on (block, lane)."""
        spread = of_chunks.withColumn("lane", lane)
        every = names.agg(F.collect_list("block").alias("all")).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        left = spread.join(every, "lane").select(*of_chunks.columns, "lane", F.explode("all").alias("block"))
        right = of_blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        return left.join(right, ["block", "lane"])

    first = arrow_stage(grid(chunks.select("chunk", "cells"), blocks), lower_batches, "block long, nth long, lowers array<double>",
                        dims, k, low, width, kind)
    ranked = first.select("block", "nth", F.explode("lowers").alias("lower")).withColumn(
        "r", F.row_number().over(Window.partitionBy("block", "nth").orderBy(F.desc("lower")))).where(F.col("r") <= k)
    floors = (ranked.groupBy("block", "nth").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(float("-inf")).alias("floor"))
              .groupBy("block").agg(F.array_sort(F.collect_list(F.struct("nth", "floor"))).alias("f"))
              .select("block", F.col("f.floor").alias("floors"), F.col("f.nth").alias("nths")))
    with_floors = written(blocks.join(floors.select("block", "floors"), "block"), "floors", "none")
    second = arrow_stage(grid(chunks.select("chunk", "ids", "known", "cells", "exact"), with_floors), exact_batches, result,
                         dims, k, low, width, kind)
    order = Window.partitionBy("query_id", "own_chunk", "own_row").orderBy(
        F.desc("score"), F.asc_nulls_last("vec_id"), "chunk", "row")
    return (second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
