"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (one to three characters, words padded by a blank), in
order of frequency. A document is compared to each language by the out-of-place distance: for each n-gram of the
document's profile the difference of the two ranks, or the profile's length where the language lacks it. The nearest
language wins; the score is one minus the distance as a share of the greatest possible.

Profiles are learned from a bounded sample, ``per_language`` documents of each language at most (about), drawn by a hash
of the id. Every document is scored over its whole text.

Letters are Unicode letters, lower-cased. An n-gram is coded by eight bits for each character: letters below U+0250 and
other letters share 255 classes by a fixed hash, so that any script has n-grams.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties in frequency are ordered by code,
ties in distance by language name; null languages and null ids are never learned from; ``held_out`` is false for a null
id; without anything to learn from all are ``und``; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressgauge.llm.common import arrow_stage, bounded_sample, fold

PROFILE = 400
PER_LANGUAGE = 800
PIECE = 1 << 20           # characters of a text that are coded at once
SMALL = 1 << 16
_TABLE: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """Class of each code point: 0 for what is no letter, else 1 to 255."""
    if not _TABLE:
        points = np.arange(0x110000, dtype=np.int64)
        letters = np.frombuffer(bytes(chr(p).isalpha() for p in range(0x110000)), np.uint8).astype(bool)
        classes = np.where(points < 128, points, 128 + (points * 2654435761 >> 7) % 127)
        _TABLE.append(np.where(letters, classes, 0).astype(np.uint8))
    return _TABLE[0]


def gram_codes(text: str) -> np.ndarray:
    """Codes of all n-grams of the text, with repetition; empty if it has no letter.

    Long texts are coded in pieces; each starts with the last two classes of the one before, so no n-gram is cut.
    """
    table, out, tail = class_table(), [], np.zeros(1, np.uint32)
    for at in range(0, len(text), PIECE):
        raw = np.frombuffer(text[at:at + PIECE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        new, k = table[raw].astype(np.uint32), len(tail)
        if at + PIECE >= len(text):
            new = np.append(new, np.uint32(0))
        c = np.concatenate((tail, new))
        c = c[np.concatenate((np.ones(k, bool), (c[k:] | c[k - 1:-1]) > 0))]  # blanks next to blanks fall together
        two = (c[:-1] << np.uint32(8)) | c[1:]
        three = (two[:-1] << np.uint32(8)) | c[2:]
        whole = (c[:-2] | c[2:]) > 0
        one, two, first = c[k:], two[k - 1:], max(0, k - 2)
        out += [one[one > 0], two[two > 255] + np.uint32(1 << 24), three[first:][whole[first:]] + np.uint32(1 << 25)]
        tail = c[-2:]
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def profile_of(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties by code; ``codes`` ascend."""
    if len(codes) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")[:size]]


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and how often each occurs."""
    codes = np.sort(codes)
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[starts], np.diff(np.append(starts, len(codes)))


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: (lang, text) to (lang, code, n), summed within the task."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        texts: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            texts.setdefault(lang, []).append(gram_codes(text.as_py() or ""))
        for lang, codes in texts.items():
            codes, n = counted(np.concatenate(codes)) if sum(map(len, codes)) else (np.zeros(0, np.uint32), np.zeros(0, int))
            if lang in sums:
                every = np.concatenate([sums[lang][0], codes])
                uniq, where = np.unique(every, return_inverse=True)
                n = np.bincount(where, weights=np.concatenate([sums[lang][1], n]), minlength=len(uniq)).astype(np.int64)
                codes = uniq
            sums[lang] = codes, n
    for lang, (codes, n) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)),
                                          pa.array(n.astype(np.int64))], names=["lang", "code", "n"])


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, size: int = PROFILE, *, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_fold: int = 1) -> list[tuple[str, list[int]]]:
    """(language, profile) of every language that the sample has n-grams of, by name."""
    rows = (docs.select(F.col(id_col).alias("k"), F.col(lang_col).cast("string").alias("lang"),
                        F.col(text_col).cast("string").alias("text"))
            .where("lang is not null and k is not null").where(fold(F.col("k"), folds) != held_fold))
    sample = bounded_sample(rows, "lang", F.col("k"), per_language).select("lang", "text")
    grams = arrow_stage(sample, count_batches, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # Per language, the first ``size`` by count, then code: sorted lists of bounded length, merged pairwise by Spark.
    best = grams.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "code"))), 1, size).alias("p"))
    return sorted((r.lang, [int(x.code) for x in r.p]) for r in best.collect())


class Ranker:
    """Ranks of all profiles in one lookup table by code."""

    def __init__(self, profiles: list[tuple[str, list[int]]], size: int) -> None:
        self.names, self.size = [n for n, _ in profiles], size
        self.codes = np.unique(np.array([c for _, p in profiles for c in p], dtype=np.uint32))
        self.ranks = np.full((len(self.codes) + 1, len(profiles)), -1, dtype=np.int32)
        for k, (_, p) in enumerate(profiles):
            self.ranks[np.searchsorted(self.codes, np.array(p, np.uint32)), k] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = gram_codes(text or "")
        if not len(codes) or not self.names:
            return "und", 0.0
        mine = profile_of(*counted(codes), self.size)
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        ranks = self.ranks[np.where(self.codes[at] == mine, at, len(self.codes))]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(mine))[:, None])).sum(0)
        k = int(apart.argmin())
        return self.names[k], 1 - float(apart[k]) / (self.size * len(mine))


def predict_batches(batches: Iterator[pa.RecordBatch], profiles: list, size: int) -> Iterator[pa.RecordBatch]:
    """Task: (doc_id, text) to (doc_id, lang_pred, score)."""
    ranker = Ranker(profiles, size)
    for batch in batches:
        got = [ranker.predict(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()),
                                          pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, size: int = PROFILE, *, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document; one pass over the texts, no shuffle."""
    profiles = learn(docs, per_language, size, id_col=id_col, text_col=text_col, lang_col=lang_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = arrow_stage(narrow, predict_batches, "doc_id long, lang_pred string, score double", profiles, size)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
