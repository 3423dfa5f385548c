"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct lower-cased words and their leading four and five letters, hashed. The score is the
logistic of a bias, a weight per term and the inner products of the term factors of all pairs, so that two terms can say
together what neither says alone. It is fitted on a bounded sample of labelled documents (``per_class`` of either
label, drawn by a hash of the id). The calibration is a logistic curve over the scores that each third of that sample gets
from a machine fitted to the others, weighted back to the classes' shares among all labelled rows.

Defined cases: a null text counts as empty and gets the score of no term; labels repeated for an id count once, 1 before
0, null labels not at all; rows of a null id are scored but never learned from; without labels of both classes every
score is the share of class 1 (0 without labels); ``held_out`` is false for a null id; other columns are carried along.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pressgauge.llm.common import arrow_stage, bounded_sample, fold

WORD = re.compile(r"[^\W\d_]+").findall
SPACE = 1 << 22           # hashed terms
PREFIXES = (4, 5)
PER_CLASS = 5_000         # labelled documents of either class that a fit reads
FACTORS = 4
MIN_DOCS = 5              # of the sample that hold a term
FREQUENT = 2_048          # most frequent terms, kept whatever they say alone
EVIDENCE = 8.0            # likelihood-ratio statistic from which another term is kept
CROSS = 3                 # parts of the sample that are scored by machines of the others, for the calibration
STEPS = 200               # of a fit on a small sample
CACHE_WORDS = 400_000


def term_hashes(word: str) -> list[int]:
    """Hashed terms of a word: itself and its leading letters."""
    terms = [word, *(f"^{word[:n]}" for n in PREFIXES if len(word) > n)]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % SPACE for t in terms]


def sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: (label, weight, key, text) to the same with distinct hashed terms for the text."""
    for batch in batches:
        terms = []
        for t in batch.column(3):
            found = {h for w in set(WORD((t.as_py() or "").lower())) for h in term_hashes(w)}
            terms.append(np.array(sorted(found), dtype="<i4").tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(terms, pa.binary())], names=["label", "w", "k", "terms"])


@dataclass
class Machine:
    """A fitted machine; ``terms`` are the hashed terms it knows, ascending."""

    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    lookup: dict[str, bytes] = field(default_factory=dict)

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """Score before calibration of documents given as positions in ``terms``."""
        sizes = np.array([len(r) for r in rows])
        out = np.full(len(rows), self.bias)
        full = np.flatnonzero(sizes)
        if len(full):
            at, starts = np.concatenate([rows[i] for i in full]), np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
            v = self.factors[at]
            total = np.add.reduceat(v, starts)
            out[full] += (np.add.reduceat(self.weights[at], starts)
                          + 0.5 * (total ** 2 - np.add.reduceat(v ** 2, starts)).sum(1))
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(rows) + self.shift, -30, 30)))

    def rows(self, texts: list[str | None]) -> list[np.ndarray]:
        """Positions in ``terms`` of the distinct known terms of each text."""
        known, out = self.lookup, []
        for text in texts:
            words = set(WORD((text or "").lower()))
            try:
                found = b"".join(map(known.__getitem__, words))
            except KeyError:
                if len(known) > CACHE_WORDS:
                    known.clear()
                for w in words:
                    if w not in known:
                        hashes = np.array(term_hashes(w))
                        at = np.minimum(np.searchsorted(self.terms, hashes), max(0, len(self.terms) - 1))
                        hit = self.terms[at] == hashes if len(self.terms) else np.zeros(len(at), bool)
                        known[w] = at[hit].astype("<i4").tobytes()
                found = b"".join(map(known.__getitem__, words))
            out.append(np.unique(np.frombuffer(found, "<i4")))
        return out


def constant(share: float) -> Machine:
    """A machine without terms, of the given score."""
    share = min(max(share, 1e-9), 1 - 1e-9)
    return Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)), float(np.log(share / (1 - share))))


def fit_machine(labels: np.ndarray, terms: list[np.ndarray], importance: np.ndarray, epochs: int = 12,
                parts: int = CROSS) -> Machine:
    """The machine of all rows, calibrated on scores that each part of them gets from a machine of the other parts."""
    y = labels.astype(float)
    raw, group = np.zeros(len(y)), np.arange(len(y)) % parts
    for g in range(parts):
        mine, others = np.flatnonzero(group == g), np.flatnonzero(group != g)
        if len(mine) and len(others) and y[others].min() < y[others].max():
            machine, place = descend(y[others], [terms[i] for i in others], epochs)
            raw[mine] = machine.raw([_placed(place, terms[i]) for i in mine])
    machine, _ = descend(y, terms, epochs)
    machine.slope, machine.shift = calibration(raw, y, importance)
    return machine


def _placed(place: np.ndarray, terms: np.ndarray) -> np.ndarray:
    at = place[terms]
    return at[at >= 0]


def informative(y: np.ndarray, terms: list[np.ndarray]) -> np.ndarray:
    """Terms, ascending, that are frequent or tell the classes apart by their likelihood-ratio statistic."""
    n = len(y)
    flat = np.concatenate(terms) if n else np.zeros(0, np.int32)
    all_docs = np.bincount(flat, minlength=SPACE)
    in_one = np.bincount(flat, weights=np.repeat(y, [len(t) for t in terms]), minlength=SPACE)
    seen = np.flatnonzero(all_docs >= MIN_DOCS)
    a, b = in_one[seen], (all_docs - in_one)[seen]
    ones, zeros = y.sum(), n - y.sum()
    expected = [(a + b) * ones / n, (a + b) * zeros / n]
    stat = 2 * (a * np.log(np.maximum(a, 1e-9) / expected[0]) + b * np.log(np.maximum(b, 1e-9) / expected[1]))
    often = np.zeros(len(seen), bool)
    often[np.argsort(-all_docs[seen], kind="stable")[:FREQUENT]] = True
    return seen[(stat >= EVIDENCE) | often]


def descend(y: np.ndarray, terms: list[np.ndarray], epochs: int, rate: float = 0.1, l1: float = 2e-4, l2: float = 1e-3,
            batch: int = 256) -> tuple[Machine, np.ndarray]:
    """Adaptive gradient descent with soft-thresholded weights; the machine, not calibrated, and every term's place in it.

    Small samples take more rounds, so that each fit makes about as many steps.
    """
    n = len(y)
    kept = informative(y, terms)
    place = np.full(SPACE, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    rows = [_placed(place, t) for t in terms]
    rng = np.random.default_rng(7)
    machine = Machine(kept, np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), FACTORS)), 0.0)
    grown_w, grown_v, grown_b = np.full(len(kept), 1e-6), np.full((len(kept), FACTORS), 1e-6), 1e-6
    for _ in range(max(epochs, min(3 * epochs, -(-STEPS * batch // n)))):
        order = rng.permutation(n)
        for lo in range(0, len(order), batch):
            part = order[lo:lo + batch]
            mine = [rows[i] for i in part]
            error = 1 / (1 + np.exp(-np.clip(machine.raw(mine), -30, 30))) - y[part]
            sizes = np.array([len(r) for r in mine])
            at, doc = np.concatenate(mine), np.repeat(np.arange(len(part)), sizes)
            used, inverse = np.unique(at, return_inverse=True)
            e = error[doc]
            sums = np.zeros((len(part), FACTORS))
            np.add.at(sums, doc, machine.factors[at])
            g = np.bincount(inverse, weights=e) / len(part)
            grown_w[used] += g ** 2
            step = rate / np.sqrt(grown_w[used])
            w = machine.weights[used] - step * g
            machine.weights[used] = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            for f in range(FACTORS):
                gv = np.bincount(inverse, weights=e * sums[doc, f]) / len(part) - machine.factors[used, f] * g
                gv += l2 * machine.factors[used, f]
                grown_v[used, f] += gv ** 2
                machine.factors[used, f] -= 0.3 * rate * gv / np.sqrt(grown_v[used, f])
            grown_b += float(error.mean()) ** 2
            machine.bias -= rate * float(error.mean()) / grown_b ** 0.5
    return machine, place


def calibration(raw: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve from raw scores to probabilities, by damped Newton steps."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    ones, zeros = weight[y == 1].sum(), weight[y == 0].sum()
    aim = np.where(y == 1, 1 - 1 / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        e, h = weight * (p - aim), weight * p * (1 - p)
        g = np.array([(e * raw).sum(), e.sum()])
        m = np.array([[(h * raw * raw).sum(), (h * raw).sum()], [(h * raw).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(m, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, *, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", folds: int = 4, held_fold: int = 2) -> Machine:
    """Fit on a sample of at most about ``per_class`` labelled documents of either class outside the held-out fold."""
    marked = (labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("label"))
              .where("label is not null and k is not null").where(fold(F.col("k"), folds) != held_fold)
              .groupBy("k").agg(F.max("label").alias("label")).where("label in (0, 1)"))
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if len(counts) < 2:
        return constant(counts.get(1, 0) / max(1, sum(counts.values())))
    chosen = bounded_sample(marked, "label", F.col("k"), per_class).withColumn("w", F.lit(1.0))
    # At most four times per_class rows of 12 bytes: a proven bound.
    texts = (docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("text"))
             .join(F.broadcast(chosen), "k").select("label", "w", F.xxhash64("k").alias("k"), "text"))
    got = arrow_stage(texts, sample_batches, "label int, w double, k long, terms binary").limit(4 * per_class).collect()
    got.sort(key=lambda r: (r.k, r.terms))
    y = np.array([r.label for r in got], dtype=int)
    if not len(y) or y.min() == y.max():
        return constant(counts[1] / sum(counts.values()))
    share = np.array([counts[0] / max(1, (y == 0).sum()), counts[1] / max(1, (y == 1).sum())])
    share = share / share.min()
    return fit_machine(y, [np.frombuffer(r.terms, "<i4") for r in got], share[y])


_READY: dict[str, Machine] = {}


def score_batches(batches: Iterator[pa.RecordBatch], parts: tuple) -> Iterator[pa.RecordBatch]:
    """Task: the last column is the text; a score follows it."""
    name = f"{zlib.crc32(parts[1].tobytes())}-{parts[3:]}"
    if name not in _READY:
        _READY.clear()
        _READY[name] = Machine(*parts)
    machine = _READY[name]
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        out = [machine.score(machine.rows(texts.slice(i, 256).to_pylist())) for i in range(0, len(texts), 256)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else [], pa.float64())],
                                         names=[*batch.schema.names, "_score"])


def _marked(docs: DataFrame, machine: Machine, text_col: str) -> DataFrame:
    """``docs`` under neutral column names, and ``_score``."""
    own = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    marked = own.withColumn("_text", own[docs.columns.index(text_col)].cast("string"))
    schema = StructType([*marked.schema.fields, StructField("_score", DoubleType())])
    parts = (machine.terms, machine.weights, machine.factors, machine.bias, machine.slope, machine.shift)
    return arrow_stage(marked, score_batches, schema, parts).drop("_text")


def scored(docs: DataFrame, machine: Machine, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``, a probability; all other columns stay as they are."""
    return _marked(docs, machine, text_col).toDF(*docs.columns, name)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS, *,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    machine = fit(docs, labels, per_class, id_col=id_col, text_col=text_col)
    return scored(narrow, machine).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` below the threshold."""
    marked = _marked(docs, fit(docs, labels, per_class), "text")
    return marked.where(F.col("_score") < threshold).drop("_score").toDF(*docs.columns)
