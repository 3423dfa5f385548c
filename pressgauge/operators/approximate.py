"""Approximate best matches of dense vectors by random-projection hashing.

A table hashes a vector to the signs of ``bits`` random projections; two vectors at angle t agree in one table with
probability (1 - t/pi)^bits, and in one of ``tables`` tables with 1 - (1 - (1 - t/pi)^bits)^tables. The bits are the most
for which this probability, averaged over the true best matches of a bounded sample of requests, reaches the recall asked
for: few bits where neighbours are far apart, many where they are close. Candidates are joined on (table, key) and scored
exactly. Equal vectors fall together first, so a vector that a third of the rows share is one entry, which stands for its k
smallest ids.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pressgauge.operators.similarity import Scorer, _dense, _unit, top_matches, top_similar
from pressgauge.session import cut_lineage

TABLES = 24
MOST_BITS = 24
SAMPLE = 200       # requests whose true matches decide the number of bits


def planes(dims: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """``dims`` × ``tables * bits`` normal deviates, the same for the same seed."""
    return np.random.default_rng(seed).standard_normal((dims, tables * bits))


def hit_rate(cosines: np.ndarray, tables: int, bits: int) -> float:
    """Mean probability that a pair of each given cosine meets in a table."""
    agree = 1.0 - np.arccos(np.clip(cosines, -1.0, 1.0)) / math.pi
    return float(np.mean(1.0 - (1.0 - agree ** bits) ** tables))


def most_bits(cosines: np.ndarray, recall: float, tables: int = TABLES) -> int:
    """The most bits that reach the recall; 0 where not even one does."""
    return max((b for b in range(1, MOST_BITS + 1) if hit_rate(cosines, tables, b) >= recall), default=0)


def keys(units: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """Rows × tables: the signs of a table's projections as one number."""
    signs = (units @ planes(units.shape[1], tables, bits, seed) > 0).reshape(len(units), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def groups(column: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every distinct key with the places that have it."""
    order = np.argsort(column, kind="stable")
    found, starts = np.unique(column[order], return_index=True)
    return zip(found.tolist(), np.split(order, starts[1:]))


def hashed_cosine(tables: int, bits: int, seed: int) -> Scorer:
    """Scores of dense ``vec`` columns: held rows × batch rows, minus infinity for those that meet in no table."""
    def scorer(held: pd.DataFrame) -> Callable[[pd.DataFrame], np.ndarray]:
        units = _unit(_dense(held["vec"]))
        places = [dict(groups(column)) for column in keys(units, tables, bits, seed).T]

        def score(batch: pd.DataFrame) -> np.ndarray:
            others = _unit(_dense(batch["vec"]))
            out = np.full((len(units), len(others)), -np.inf)
            for asked, column in zip(places, keys(others, tables, bits, seed).T):
                for key, at in groups(column):
                    if key in asked:
                        out[np.ix_(asked[key], at)] = units[asked[key]] @ others[at].T
            return out
        return score
    return scorer


def top_similar_approximate(queries: DataFrame, corpus: DataFrame, k: int = 10, recall: float = 0.9, tables: int = TABLES,
                            seed: int = 42, digits: int = 9) -> DataFrame:
    """``query_id, cand_id, similarity, rank`` as ``top_similar`` gives them, but for matches that no table brings together.

    Both sides have ``id, vec``; null and empty vectors are skipped, as are corpus vectors of another length than the
    requests'. ``recall`` is the expected share of the exact matches that are found. A request keeps fewer than k matches
    where its tables hold fewer candidates. Without a number of bits that reaches the recall the search is exact.
    """
    usable = lambda df: df.filter(F.col("vec").isNotNull() & (F.size("vec") > 0)).select(
        F.col("id").cast("long"), F.col("vec").cast("array<double>").alias("vec"))
    asked, stored = cut_lineage(usable(queries)), usable(corpus)
    # A bounded sample by hash decides the bits, from the angles of its exact matches with all of the corpus.
    some = cut_lineage(asked.orderBy(F.xxhash64("id"), "id").limit(SAMPLE))
    first = some.first()
    if first is None:
        return top_similar(queries, corpus, k)
    dims = len(first.vec)
    asked, stored = asked.where(F.size("vec") == dims), cut_lineage(stored.where(F.size("vec") == dims))
    found = top_similar(some.where(F.size("vec") == dims), stored, k).select("similarity")
    cosines = np.array([r.similarity for r in found.collect()])      # at most k for each request of the sample
    bits = most_bits(cosines, recall, tables) if len(cosines) else 0
    if not bits:
        return top_similar(queries, corpus, k)
    return top_matches(asked, stored, k, hashed_cosine(tables, bits, seed), digits=digits)
