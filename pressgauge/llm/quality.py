"""Quality classifier: naive Bayes support vectors.

A text's n-grams, as indicators, are of four kinds, all hashed: words and pairs of neighbouring words; the beginning and
the end of a word; and one, two and three neighbouring word shapes, where a run of capitals, of other letters, of digits
or of one sign is one letter of the shape and a word that repeats the one before has a shape of its own.

Every indicator is scaled by the log of the ratio of its shares in the two classes, and the scaled vector is brought to
length 1, so long texts weigh no more than short ones; a linear hinge-loss model is fitted to it by dual coordinate
descent. Both learn from a bounded sample, about ``per_class`` labelled documents of either class, drawn by a hash of the
id, so no text is shuffled. Margins become probabilities by a logistic curve fitted to margins that each part of the
sample gets from ratios and model of the other parts, weighted back to the classes' shares among all labelled rows.

Defined cases: a null text counts as empty and gets the score of no indicator; labels repeated for an id count once, 1
before 0, null labels not at all; rows of a null id are scored but never learned from; without labels of both classes
every score is the share of class 1 (0 without labels); ``held_out`` is false for a null id; repeated rows are each
scored alike; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressgauge.llm.common import arrow_stage, bounded_sample, fold
from pressgauge.llm.toxicity import calibration

SPACE_BITS = 19
SPACE = 1 << SPACE_BITS       # hashed indicators
PER_CLASS = 4_000             # labelled documents of either class that a fit reads
MIN_DOCS = 3                  # of the sample that hold an indicator
SMOOTH = 1.0
COST = 4.0
FOLDS = 4
CACHE_WORDS = 400_000
# The runs of a shape and the letters that stand for them.
CAPITALS = "A-ZÀ-ÖØ-Þ"
RUNS = re.compile(rf"([{CAPITALS}]+)|((?:(?![{CAPITALS}])[^\W\d_])+)|(\d+)|((.)\5*)", re.S)
CAPITAL = re.compile(f"[{CAPITALS}]").match
SEEDS = tuple(np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1) for i in range(8))


def shape(word: str) -> str:
    """``Ab12,,`` as ``Xx9,``."""
    if word.isalpha():
        if word.islower():
            return "x"
        if CAPITAL(word) and word[1:].islower():
            return "Xx"
    return "".join("X" if a else "x" if b else "9" if c else e for a, b, c, _, e in RUNS.findall(word))


class Grams(dict):
    """Numbers of words, and in ``table`` their hashes: itself, its shape, its first and its last three characters.

    Emptied between texts when it holds more than ``CACHE_WORDS``.
    """

    def __init__(self) -> None:
        super().__init__()
        self.table = np.zeros((4, 1 << 12), dtype=np.uint64)

    def __missing__(self, word: str) -> int:
        h = lambda t: zlib.crc32(t.encode("utf-8", "surrogatepass"))
        code = len(self)
        if code == self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        self.table[:, code] = h(word.lower()), h(shape(word)), h(word[:3]), h(word[-3:])
        self[word] = code
        return code

    def of(self, found: list[str]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        codes = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        return self.table[:, codes]


def spread(values: np.ndarray, kind: int) -> np.ndarray:
    """Hashed indicators of one kind."""
    mixed = (values ^ SEEDS[kind]) * SEEDS[0]
    mixed ^= mixed >> np.uint64(31)
    return (mixed * SEEDS[1]) >> np.uint64(64 - SPACE_BITS)


def indicators(text: str | None, words: Grams) -> np.ndarray:
    """Distinct hashed indicators, ascending."""
    found = (text or "").split()
    if not found:
        return np.zeros(0, np.int32)
    word, form, head, tail = words.of(found)
    form[1:][word[1:] == word[:-1]] = np.uint64(1)
    pair = lambda a, b: a * SEEDS[2] + b
    out = [spread(word, 2), spread(head, 3), spread(tail, 4), spread(form, 5)]
    if len(found) > 1:
        two = pair(form[:-1], form[1:])
        out += [spread(pair(word[:-1], word[1:]), 2), spread(two, 6)]
        if len(found) > 2:
            out.append(spread(pair(two[:-1], form[2:]), 7))
    return np.unique(np.concatenate(out)).astype(np.int32)


def sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: (label, key, text) to the same with the indicators for the text."""
    words = Grams()
    for batch in batches:
        terms = [indicators(t.as_py(), words).astype("<i4").tobytes() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(terms, pa.binary())], names=["label", "k", "terms"])


@dataclass
class Model:
    """``scale`` is the log-count ratio of every indicator, ``weights`` the linear model's weight times it."""

    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, terms: np.ndarray) -> float:
        r = self.scale[terms]
        return float(self.weights[terms].sum() / max(1e-9, np.sqrt(r @ r)) + self.bias)

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def constant(share: float) -> Model:
    """A model without indicators, of the given score."""
    share = min(max(share, 1e-9), 1 - 1e-9)
    return Model(np.zeros(SPACE, np.float32), np.zeros(SPACE, np.float32), float(np.log(share / (1 - share))))


def log_ratios(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Log of the ratio of an indicator's smoothed shares in the two classes; 0 for indicators that too few rows hold."""
    p, q = ones + SMOOTH, zeros + SMOOTH
    return np.where(ones + zeros >= MIN_DOCS, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, width: int,
                 epochs: int = 40, tolerance: float = 0.05) -> np.ndarray:
    """Weights (the last one a bias) of the L2-regularised hinge loss, one dual variable at a time.

    ``rows`` are (places, values) of unit length; a row's dual variable stays between 0 and its ``cost``. Rounds end when
    the largest projected gradient falls below ``tolerance``.
    """
    w, alpha = np.zeros(width + 1), np.zeros(len(rows))
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            g = y[i] * (w[at] @ x + w[width]) - 1.0
            if alpha[i] <= 0:
                g = min(g, 0.0)
            elif alpha[i] >= cost[i]:
                g = max(g, 0.0)
            if g:
                worst = max(worst, abs(g))
                old = alpha[i]
                alpha[i] = min(max(old - g / (x @ x + 1.0), 0.0), cost[i])
                step = (alpha[i] - old) * y[i]
                w[at] += step * x
                w[width] += step
        if worst < tolerance:
            break
    return w


def class_counts(labels: np.ndarray, terms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of class 1, and of class 0, that hold each indicator."""
    count = lambda y: np.bincount(np.concatenate([np.zeros(0, np.int64), *(t for t, v in zip(terms, labels) if v == y)]), minlength=SPACE)
    return count(1).astype(float), count(0).astype(float)


def descended(labels: np.ndarray, terms: list[np.ndarray]) -> Model:
    """Ratios and hinge-loss model of some rows, not calibrated. Classes weigh the same altogether."""
    scale = log_ratios(*class_counts(labels, terms))
    place = np.full(SPACE, -1, np.int64)
    kept = np.flatnonzero(scale)
    place[kept] = np.arange(len(kept))
    rows = []
    for t in terms:
        t = t[scale[t] != 0]
        r = scale[t]
        rows.append((place[t], r / max(1e-9, np.sqrt(r @ r))))
    y = np.where(labels == 1, 1.0, -1.0)
    cost = COST * np.where(labels == 1, len(y) / max(1, (labels == 1).sum()), len(y) / max(1, (labels == 0).sum())) / 2
    w = dual_descent(rows, y, cost, len(kept))
    weights = np.zeros(SPACE)
    weights[kept] = w[:-1] * scale[kept]
    return Model(scale.astype(np.float32), weights.astype(np.float32), float(w[-1]))


def fit_model(labels: np.ndarray, terms: list[np.ndarray], importance: np.ndarray) -> Model:
    """The model of all rows, calibrated on margins from models that have not seen the row."""
    margins, group = np.zeros(len(labels)), np.arange(len(labels)) % FOLDS
    for g in range(FOLDS):
        mine, others = np.flatnonzero(group == g), np.flatnonzero(group != g)
        if len(mine) and len(others) and len(np.unique(labels[others])) == 2:
            model = descended(labels[others], [terms[i] for i in others])
            margins[mine] = [model.margin(terms[i]) for i in mine]
    model = descended(labels, terms)
    model.slope, model.shift = calibration(margins, labels.astype(float), importance)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, *, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", folds: int = 4, held_fold: int = 2) -> Model:
    """Fit on a sample of about ``per_class`` labelled documents of either class outside the held-out fold."""
    marked = (labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("label"))
              .where("label is not null and k is not null").where(fold(F.col("k"), folds) != held_fold)
              .groupBy("k").agg(F.max("label").alias("label")).where("label in (0, 1)"))
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if len(counts) < 2:
        return constant(counts.get(1, 0) / max(1, sum(counts.values())))
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    chosen = bounded_sample(marked, "label", F.col("k"), per_class)
    # At most four times per_class rows of 12 bytes: a proven bound.
    drawn = texts.join(F.broadcast(chosen), "k").select("label", F.xxhash64("k").alias("k"), "text")
    got = arrow_stage(drawn, sample_batches, "label int, k long, terms binary").limit(4 * per_class).collect()
    got.sort(key=lambda r: (r.k, r.terms))
    y = np.array([r.label for r in got], dtype=int)
    if not len(y) or y.min() == y.max():
        return constant(counts[1] / sum(counts.values()))
    share = np.array([counts[0] / max(1, (y == 0).sum()), counts[1] / max(1, (y == 1).sum())])
    return fit_model(y, [np.frombuffer(r.terms, "<i4") for r in got], (share / share.min())[y])


def score_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Task: (doc_id, text) to (doc_id, score)."""
    model, words = shared.value, Grams()
    for batch in batches:
        margins = np.array([model.margin(indicators(t.as_py(), words)) for t in batch.column(1)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(margins), pa.float64())], names=["doc_id", "score"])


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = PER_CLASS, *,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = fit(docs, labels, per_class, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_stage(narrow, score_batches, "doc_id long, score double", shared).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
