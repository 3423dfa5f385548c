"""Exact best matches between a request set and a corpus.

A best-match search compares every request with every stored article, but it
must not materialise the pairs. One side, the held side, is brought to the
tasks as a small matrix in blocks of checked size; the other side streams
through in Arrow batches. A task multiplies batch by block and keeps only its
k best candidates per request, so it emits at most ``k × requests`` rows. A
held side larger than one block is processed in several passes; no pair is
skipped and nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pressgauge.operators.ranking import top_k
from pressgauge.session import cut_lineage, small_side

# Numbers (8 bytes each) in one held block: 64 MB per task.
BLOCK_NUMBERS = 8_000_000
# Hash buckets in which a vocabulary is numbered.
NUMBER_BUCKETS = 4_096
# Rows of a held block.
BLOCK_ROWS = 50_000
# Scores held at once: 32 MB.
SLICE_NUMBERS = 4_000_000


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 1e-8 on each norm keeps zero vectors defined."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda s, x: s + x)
    return dot / ((norm(a) + 1e-8) * (norm(b) + 1e-8))


def _dense(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)


class Postings:
    """Held sparse rows turned round: for each term the rows that have it, with their values."""

    def __init__(self, idx: pd.Series, val: pd.Series) -> None:
        sizes = np.array([len(i) for i in idx], dtype=np.int64)
        terms = np.concatenate([np.asarray(i, dtype=np.int64) for i in idx]) if len(idx) else np.zeros(0, np.int64)
        order = np.argsort(terms, kind="stable")
        self.count = len(idx)
        self.rows = np.repeat(np.arange(len(idx)), sizes)[order]
        self.values = (np.concatenate([np.asarray(v, dtype=np.float64) for v in val]) if len(val) else np.zeros(0))[order]
        self.terms, self.starts, self.sizes = np.unique(terms[order], return_index=True, return_counts=True)

    def dot(self, idx: pd.Series, val: pd.Series) -> np.ndarray:
        """Held rows × batch rows; the work is one product for each term that two rows share."""
        out = np.zeros((len(idx), self.count))
        for row, (i, v) in enumerate(zip(idx, val)):
            if not len(i) or not len(self.terms):
                continue
            i, v = np.asarray(i, dtype=np.int64), np.asarray(v, dtype=np.float64)
            at = np.minimum(np.searchsorted(self.terms, i), len(self.terms) - 1)
            hit = self.terms[at] == i
            at, v = at[hit], v[hit]
            sizes = self.sizes[at]
            where = np.repeat(self.starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            out[row] = np.bincount(self.rows[where], weights=self.values[where] * np.repeat(v, sizes), minlength=self.count)
        return out.T


Scorer = Callable[[pd.DataFrame], Callable[[pd.DataFrame], np.ndarray]]


def dense_cosine(held: pd.DataFrame) -> Callable[[pd.DataFrame], np.ndarray]:
    """Scores of dense ``vec`` columns: held rows × batch rows. The held side is normalised once."""
    units = _unit(_dense(held["vec"]))
    return lambda batch: units @ _unit(_dense(batch["vec"])).T


def sparse_jaccard(held: pd.DataFrame) -> Callable[[pd.DataFrame], np.ndarray]:
    """Shared over all distinct words; ``size`` is a row's number of distinct words."""
    postings, sizes = Postings(held["idx"], held["val"]), held["size"].to_numpy()[:, None]

    def score(batch: pd.DataFrame) -> np.ndarray:
        shared = postings.dot(batch["idx"], batch["val"])
        union = sizes + batch["size"].to_numpy()[None, :] - shared
        return np.where(union > 0, shared / np.maximum(union, 1), 0.0)
    return score


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best finite scores, ties by id; the k-th value's ties are all considered."""
    usable = np.flatnonzero(np.isfinite(scores))
    if len(usable) > k:
        cut = np.partition(scores[usable], len(usable) - k)[len(usable) - k]
        usable = usable[scores[usable] >= cut]
    return usable[np.lexsort((ids[usable], -scores[usable]))][:k]


class Leaders:
    """The k best finite scores of every held request so far, ties by id.

    A score enters only from its request's k-th best on, so of a later batch few scores are looked at singly.
    """

    def __init__(self, requests: int, k: int, digits: int) -> None:
        self.k, self.digits = k, digits
        self.scores, self.ids = np.full((requests, k), -np.inf), np.zeros((requests, k), dtype=np.int64)

    def add(self, table: np.ndarray, ids: np.ndarray) -> None:
        """``table``: requests × the batch's rows, not rounded; it may be written to."""
        if not np.isfinite(table.sum()):
            table[~np.isfinite(table)] = -np.inf
        floor = self.scores[:, -1]
        if len(ids) > self.k:
            some = np.flatnonzero(np.count_nonzero(table >= floor[:, None], axis=1) > self.k)
            if len(some):
                floor = floor.copy()
                floor[some] = np.maximum(floor[some], np.partition(table[some], len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        # What rounding lifts to the floor counts; it is ranked by its rounded score.
        q, at = np.nonzero((table >= (floor - 10.0 ** -self.digits)[:, None]) & (table > -np.inf))
        if not len(q):
            return
        touched = np.unique(q)
        rows = np.concatenate([np.repeat(touched, self.k), q])
        scores = np.concatenate([self.scores[touched].ravel(), np.round(table[q, at], self.digits)])
        names = np.concatenate([self.ids[touched].ravel(), ids[at]])
        order = np.lexsort((names, -scores, rows))
        begins = np.searchsorted(rows[order], touched)
        first = order[begins[:, None] + np.arange(self.k)]
        self.scores[touched], self.ids[touched] = scores[first], names[first]

    def rows(self, request_ids: np.ndarray) -> pd.DataFrame:
        q, at = np.nonzero(np.isfinite(self.scores))
        return pd.DataFrame({"query_id": request_ids[q], "cand_id": self.ids[q, at], "similarity": self.scores[q, at]})


def top_matches(requests: DataFrame, corpus: DataFrame, k: int, scorer, hold: str = "requests",
                digits: int = 9) -> DataFrame:
    """``query_id, cand_id, similarity, rank`` of the k best candidates per request.

    ``requests`` and ``corpus`` have ``id`` (long) and the scorer's columns.
    ``hold`` names the side that is brought to the tasks. Scores are rounded to ``digits``
    before ranking, so summation order cannot change a rank. The streamed side
    is written once, so a further block reads rows, not their making.
    """
    if hold not in ("requests", "corpus"):
        raise ValueError("hold must be 'requests' or 'corpus'")
    held_df, stream = (requests, corpus) if hold == "requests" else (corpus, requests)
    stream, parts = cut_lineage(stream), []
    for block in held_blocks(held_df):
        parts.append(_one_pass(stream, block, k, scorer, hold, digits))
    if not parts:
        return requests.sparkSession.createDataFrame([], "query_id long, cand_id long, similarity double, rank int")
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    # Each task already kept its k best; this keeps the best of those.
    return top_k(merged, "query_id", [F.desc("similarity"), F.asc("cand_id")], k)


def held_blocks(df: DataFrame) -> Iterator[pd.DataFrame]:
    """The held side in blocks of at most ``BLOCK_NUMBERS`` stored numbers and ``BLOCK_ROWS`` rows.

    Rows come over one partition at a time, and only one block is kept here.
    """
    rows: list = []
    numbers, of = 0, "vec" if "vec" in df.columns else "idx"
    for row in df.toLocalIterator():
        if rows and (numbers + len(row[of]) > BLOCK_NUMBERS or len(rows) >= BLOCK_ROWS):
            yield pd.DataFrame(rows)
            rows, numbers = [], 0
        rows.append(row.asDict())
        numbers += len(row[of])
    if rows:
        yield pd.DataFrame(rows)


_PASS_SCHEMA = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("cand_id", T.LongType()),
                             T.StructField("similarity", T.DoubleType())])


def _one_pass(stream: DataFrame, block: pd.DataFrame, k: int, scorer: Scorer, hold: str, digits: int) -> DataFrame:
    shared = stream.sparkSession.sparkContext.broadcast(block)
    # A batch is scored in slices, so that the table of scores stays small.
    step = max(1, SLICE_NUMBERS // len(block))

    def slices(batches):
        for batch in batches:
            for start in range(0, len(batch), step):
                yield batch.iloc[start:start + step]

    def by_request(batches):
        # Held side = requests: running k best per request over the partition.
        held = shared.value
        score, best = scorer(held), Leaders(len(held), k, digits)
        for batch in slices(batches):
            best.add(score(batch), batch["id"].to_numpy())
        yield best.rows(held["id"].to_numpy())

    def by_corpus(batches):
        # Held side = corpus: the batch rows are requests and are finished here.
        held = shared.value
        score = scorer(held)
        ids = held["id"].to_numpy()
        for batch in slices(batches):
            table = np.round(score(batch), digits).T
            out = [(qid, _best(table[r], ids, k), r) for r, qid in enumerate(batch["id"])]
            yield pd.DataFrame({
                "query_id": np.concatenate([np.full(len(p), q, dtype=np.int64) for q, p, _ in out]),
                "cand_id": np.concatenate([ids[p] for _, p, _ in out]),
                "similarity": np.concatenate([table[r][p] for _, p, r in out])})

    return stream.mapInPandas(by_request if hold == "requests" else by_corpus, _PASS_SCHEMA)


def top_similar(queries: DataFrame, corpus: DataFrame, k: int = 10, hold: str = "requests") -> DataFrame:
    """k nearest stored embeddings per query; null and empty vectors are skipped."""
    usable = lambda df: df.filter(F.col("vec").isNotNull() & (F.size("vec") > 0)).select(
        F.col("id").cast("long"), F.col("vec").cast("array<double>").alias("vec"))
    return top_matches(usable(queries), usable(corpus), k, dense_cosine, hold=hold)


def similarity_aggregate(pairs: DataFrame, group: str = "query_id") -> DataFrame:
    """Max, mean, reliability-weighted mean (1.5 : 1) and mean of the best five per query.

    ``pairs`` has ``similarity`` and ``is_reliable``. The best five come from
    ``max`` over a rank-limited window, so no group is collected whole.
    """
    weight = F.when(F.col("is_reliable"), 1.5).otherwise(1.0)
    base = pairs.groupBy(group).agg(
        F.max("similarity").alias("max_similarity"), F.avg("similarity").alias("mean_similarity"),
        (F.sum(F.col("similarity") * weight) / F.sum(weight)).alias("weighted_mean"))
    best = top_k(pairs.select(group, "similarity"), group, [F.desc("similarity")], 5)
    return base.join(best.groupBy(group).agg(F.avg("similarity").alias("top5_mean")), group)


def word_sets(df: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """``id, idx, val, size``: the vocabulary words a text contains, and its distinct word count.

    ``vocabulary`` is ``(term, idx)``. Words of one text stay in one partition,
    so the aggregate's map side has already collected them.
    """
    from pressgauge.functions import text as X

    tokens = df.select(F.col(key).cast("long").alias("id"), F.array_distinct(X.word_tokens(F.col(text))).alias("_w"))
    sized = tokens.select("id", F.size("_w").alias("size"), "_w")
    flat = sized.select("id", "size", F.posexplode_outer("_w").alias("_at", "term"))
    # Only words of the vocabulary are grouped, and each text's first, which carries the size.
    hit = flat.join(vocabulary, "term", "left").where(F.col("idx").isNotNull() | (F.coalesce("_at", F.lit(0)) == 0))
    return hit.groupBy("id").agg(
        F.sort_array(F.collect_list("idx")).alias("idx"), F.max("size").alias("size")).withColumn(
        "val", F.transform("idx", lambda i: F.lit(1.0)))


def jaccard_map(queries: DataFrame, corpus: DataFrame, key: str, text: str, shown: int = 30,
                title: int | None = 50) -> DataFrame:
    """Points of the similarity map: word Jaccard of each query with its closest articles.

    Both sides have ``key, text, title, source, credibility_score,
    overall_score``. The query itself is the first point at x = 1. All
    articles are compared; ``shown`` points are displayed, the query included, with
    ``title`` characters of each title (all: None).
    Missing scores count as 0.5.
    """
    from pressgauge.functions import text as X

    words = queries.select(F.explode_outer(F.array_distinct(X.word_tokens(F.col(text)))).alias("term")).filter(
        F.col("term").isNotNull()).distinct()
    # Numbered once: both sides and the vector width refer to it.
    vocabulary = cut_lineage(indexed(words, "term"))
    q = word_sets(queries, key, text, vocabulary)
    c = word_sets(corpus.filter(F.length(text) > 0), key, text, vocabulary)
    pairs = settled(top_matches(q, c, shown - 1, sparse_jaccard))
    score = lambda c: F.coalesce(c.cast("double"), F.lit(0.5))
    head = F.substring("title", 1, title) if title else F.col("title")
    others = pairs.join(corpus, pairs.cand_id == corpus[key]).select(
        "query_id", (F.col("rank") + 1).alias("point"), F.col("similarity").alias("x"),
        score(F.col("credibility_score")).alias("y"), head.alias("title"),
        "source", score(F.col("overall_score")).alias("overall_score"), F.lit(False).alias("is_current"))
    own = queries.select(
        F.col(key).cast("long").alias("query_id"), F.lit(1).alias("point"), F.lit(1.0).alias("x"),
        score(F.col("credibility_score")).alias("y"), head.alias("title"),
        "source", score(F.col("overall_score")).alias("overall_score"), F.lit(True).alias("is_current"))
    return own.unionByName(others)


def settled(pairs: DataFrame) -> DataFrame:
    """Computed match rows (k per request), ready to be joined to a large corpus from the small side."""
    return small_side(pairs)


def indexed(df: DataFrame, column: str) -> DataFrame:
    """A number for every distinct value: 0-based within its hash bucket, times the buckets, plus the bucket.

    No task sees more than its buckets, so the vocabulary may be of any size; numbers are distinct, not dense.
    """
    from pyspark.sql import Window

    bucket = F.pmod(F.xxhash64(column), F.lit(NUMBER_BUCKETS))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(column)) - 1
    return df.withColumn("_b", bucket).select(*df.columns, (within * NUMBER_BUCKETS + F.col("_b")).cast("long").alias("idx"))
