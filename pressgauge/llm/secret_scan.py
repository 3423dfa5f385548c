"""Secret scans: fixed patterns, and a character convolutional network over every other candidate and its surroundings.

Base findings are the leftmost non-overlapping matches of three patterns. Every other run that could be a secret (long
and with a digit, or the value of an assignment) is a candidate. The network reads the candidate and the characters
around it; a candidate of more than ``INSIDE`` characters is read in windows that overlap, every ``STRIDE`` characters
and at its end, and what the windows that reach the threshold cover is found. Character classes and a flag for the
candidate are embedded, convolved, max-pooled and weighed. It is trained on labelled findings from a bounded sample:
base matches against runs that are harmless by rule (``harmless``: numbers, words, identifiers and paths of words),
ordinary words of the texts, and generated values of such kinds, each kind at most a quarter. Random values of the usual
alphabets, put in the places of base matches, are labelled as secrets too, half as many as there may be base matches at
most: base matches alone are of one case. A candidate that no rule knows has no label, however often its shape occurs:
the network judges it. Key words are hidden half the time, so that it must also know a secret by its own look. Scores
are calibrated on a part of the sample that training has not seen, with surroundings and without, and the threshold is
the largest that keeps the wanted recall, however low, over all base matches that training has not seen, a quarter by
hash, and not over the sampled ones alone. Spans of the network are added to the base ones.

Defined cases: a null text counts as empty and has no finding; spans are in code points, end exclusive; equal rows give
equal findings; with fewer than 20 base findings the network adds nothing; numbers and runs of plain words are no
secrets without a key word; an empty table gives no row; other columns are carried along by ``masked`` and ignored by
``findings``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressgauge.llm.common import arrow_stage, written
from pressgauge.llm.toxicity import calibration

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
HINTS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "model")
LEAST_VALUE, LEAST_ACCESS = 8, 16
# A run of 16 or more characters with a digit, or a value of 8 or more after ":" or "=".
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}|(?<=[:=])\x20?[\"']?[A-Za-z0-9+/_=-]{8,}")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
ORDINARY = re.compile(r"(?<![\w+/=-])[^\W\d_]{4,14}(?![\w+/=-])")
HARSH = re.compile(r"[^aeiouy]{4}|^[^aeiouy]+$")
PLAIN_KINDS = 3           # ordinary words, numbers, runs of words
BEFORE, INSIDE, AFTER = 24, 48, 8
WIDTH = BEFORE + INSIDE + AFTER
CLASSES, EMBED, FILTERS, REACH = 44, 8, 24, 5
PER_LABEL = 3_000
LEAST_FINDINGS = 20
STRIDE = 12
RECALL = 0.98
STEPS, MOST_RAW = 1024, 64     # histogram of raw scores


def base_findings(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value), by start, then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of every run that could be a secret and touches no base finding."""
    taken = [(s, e) for s, _, e, _ in base]
    out = []
    for m in RUN.finditer(text):
        s, e = m.span()
        while text[s] in " \"'":
            s += 1
        if not any(s < b and a < e for a, b in taken):
            out.append((s, e))
    return out


def spoken(word: str) -> bool:
    """A word by its look: of one case but for the first letter, with vowels between its consonants."""
    return 2 <= len(word) <= 14 and word[1:] in (word[1:].lower(), word.upper()[1:]) and not (
        word.isascii() and HARSH.search(word.lower()))


def harmless(run: str) -> int | None:
    """1 for a number with its marks, 2 for words with a short number behind each; None for what could be anything."""
    parts = PARTS.findall(run)
    if not any(p.isalpha() for p in parts):
        return 1
    for segment in re.split(r"[+/_=\x20\"'-]+", run):
        *words, last = PARTS.findall(segment) or [""]
        if last.isalpha():
            words.append(last)
        elif len(last) > 4:
            return None
        if not all(w.isalpha() and spoken(w) for w in words):
            return None
    return 2


def ordinary_word(text: str, taken: list[tuple[int, int]]) -> tuple[int, int] | None:
    """A word of the text that touches no span of ``taken``, looked for from a place dealt by the text's hash."""
    at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % (len(text) + 1)
    for m in islice(ORDINARY.finditer(text, at), 50):
        if spoken(m.group()) and not any(m.start() < e and s < m.end() for s, e in taken):
            return m.span()
    return None


def _word(rng: np.random.Generator) -> str:
    return "".join(rng.choice(list("bcdfghklmnprstvw")) + rng.choice(list("aeiou")) + rng.choice(["", "", "n", "r", "s", "t"])
                   for _ in range(rng.integers(2, 5)))


def _chain(rng: np.random.Generator, length: int) -> str:
    """A cut of so many characters from a chain of words."""
    mark, text = rng.choice(list("/_-=")), ""
    while len(text) < length + 12:
        text += _word(rng) + mark
    at = int(rng.integers(0, 12))
    return text[at:at + length]


def generated(count: int, contexts: list[str], seed: int = 9) -> list[str]:
    """Windows of made harmless values, in the surroundings of ``contexts``."""
    rng = np.random.default_rng(seed)
    def number(most: int) -> str:
        return "".join(map(str, rng.integers(0, 10, rng.integers(1, most + 1))))
    def word() -> str:
        return _word(rng)
    def words() -> list[str]:
        return [word() for _ in range(rng.integers(2, 6))]
    makers = [
        lambda: "_".join(words()) + number(4), lambda: "".join(w.title() for w in words()) + number(3), lambda: "-".join([*words(), number(4)]),
        lambda: "/" + "/".join([*words(), number(2)]), lambda: "_".join(words()).upper(), lambda: "=".join([word(), *words()[:1], number(6)]),
        lambda: number(20).rjust(8, "1"), lambda: f"20{rng.integers(10, 40)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}-{number(6)}",
        lambda: "-".join([number(3), number(4), number(4), number(4)]), word,
        lambda: _chain(rng, INSIDE), lambda: _chain(rng, int(rng.integers(24, INSIDE)))]
    out = []
    for k in range(count):
        value, around = makers[k % len(makers)](), contexts[k % len(contexts)] if contexts else "\0" * WIDTH
        before = _chain(rng, BEFORE) if k % len(makers) >= len(makers) - 2 and rng.integers(2) else around[:BEFORE]
        out.append(before + value[:INSIDE].ljust(INSIDE, "\0") + around[BEFORE + INSIDE:])
    return out


def generated_secrets(count: int, contexts: list[str], seed: int = 10) -> list[str]:
    """Windows of random values of the usual alphabets, some behind a prefix, some within a chain of words."""
    rng = np.random.default_rng(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    signs = [lower + lower.upper() + digits, lower + lower.upper() + digits + "+/_-", lower + digits, lower.upper() + digits, digits + "abcdef"]
    out = []
    for k in range(count if contexts else 0):
        head = "".join(rng.choice(list(lower), rng.integers(2, 5))) + "_-"[k % 2] if k % 3 == 0 else ""
        value = head + "".join(rng.choice(list(signs[k % len(signs)]), rng.integers(16, INSIDE + 1)))
        around = contexts[k % len(contexts)]
        before = around[:BEFORE]
        if k % 4 == 1:
            value = "".join(rng.choice(list(signs[k // 4 % len(signs)]), rng.integers(16, 33)))
            value = (_chain(rng, int(rng.integers(0, INSIDE - len(value) + 1))) + value + _chain(rng, INSIDE))[:INSIDE]
            before = _chain(rng, BEFORE)
        out.append(before + value[:INSIDE].ljust(INSIDE, "\0") + around[BEFORE + INSIDE:])
    return out


def places(start: int, end: int) -> list[int]:
    """Where the windows over a run start: at its start, and so that every character is read where it is longer."""
    return [start] if end - start <= INSIDE else [*range(start, end - INSIDE, STRIDE), end - INSIDE]


def windows_over(text: str, start: int, end: int) -> list[str]:
    return [window(text, at, min(end, at + INSIDE)) for at in places(start, end)]


def window(text: str, start: int, end: int) -> str:
    """What the network reads at a place: fixed width, the start always at the same place."""
    inside = text[start:min(end, start + INSIDE)]
    return (text[max(0, start - BEFORE):start].rjust(BEFORE, "\0") + inside.ljust(INSIDE, "\0")
            + text[end:end + AFTER].ljust(AFTER, "\0"))


def _class_table() -> np.ndarray:
    """Character classes: 26 letters with case folded in pairs of two, digits, marks, space, other letters, padding."""
    table = np.full(256, 40, dtype=np.int64)
    table[0] = 0
    for i in range(26):
        table[97 + i], table[65 + i] = 1 + i // 2, 14 + i // 2
    table[48:58] = np.arange(27, 37) - (np.arange(10) % 2)
    for k, c in enumerate(" \"':=+/_-."):
        table[ord(c)] = (37, 38, 38, 39, 39, 41, 41, 42, 42, 43)[k]
    return table


CLASS = _class_table()


def encoded(windows: list[str]) -> np.ndarray:
    """Classes of the windows' characters, a row each; characters beyond Latin-1 are of class 40."""
    raw = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, WIDTH)
    return CLASS[np.minimum(raw, 255)]


def hidden(x: np.ndarray) -> np.ndarray:
    """Encoded windows without their surroundings."""
    out = x.copy()
    out[:, :BEFORE] = 0
    out[:, BEFORE + INSIDE:] = 0
    return out


class Network:
    """Embedding, one convolution with rectified max pooling over inside and outside, a logistic output."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.3, (CLASSES, EMBED))
        self.kernel = rng.normal(0, 0.2, (REACH * EMBED, FILTERS))
        self.offset = np.zeros(FILTERS)
        self.out = rng.normal(0, 0.2, 3 * FILTERS)
        self.bias = np.zeros(1)
        self.slope, self.shift, self.threshold = 1.0, 0.0, 2.0

    def forward(self, x: np.ndarray) -> tuple:
        e = self.embed[x]
        e[x == 0] = 0
        n, steps = len(x), WIDTH - REACH + 1
        patches = np.lib.stride_tricks.sliding_window_view(e, REACH, axis=1).transpose(0, 1, 3, 2).reshape(n, steps, -1)
        act = np.maximum(patches @ self.kernel + self.offset, 0)
        outer, inner = act[:, :BEFORE - REACH + 1], act[:, BEFORE:BEFORE + INSIDE - REACH + 1]
        filled = np.maximum((x[:, BEFORE:BEFORE + INSIDE - REACH + 1] > 0).sum(1, keepdims=True), 1)
        at_out, at_in = outer.argmax(1), inner.argmax(1) + BEFORE
        live = (x[:, BEFORE:BEFORE + INSIDE - REACH + 1] > 0)[:, :, None]
        pooled = np.concatenate([np.take_along_axis(act, at_out[:, None], 1)[:, 0],
                                 np.take_along_axis(act, at_in[:, None], 1)[:, 0], (inner * live).sum(1) / filled], 1)
        return pooled @ self.out + self.bias[0], pooled, act, patches, at_out, at_in, live, filled

    def probability(self, windows: list[str]) -> np.ndarray:
        raw = [self.forward(encoded(windows[i:i + 256]))[0] for i in range(0, len(windows), 256)]
        return 1 / (1 + np.exp(-np.clip(self.slope * np.concatenate(raw) + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01) -> None:
        """Adam on the logistic loss; in every other batch the surroundings are hidden."""
        names = ("embed", "kernel", "offset", "out", "bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        rng, t = np.random.default_rng(6), 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(order), batch):
                part = order[lo:lo + batch]
                t += 1
                mine = hidden(x[part]) if t % 2 else x[part]
                raw, pooled, act, patches, at_out, at_in, live, filled = self.forward(mine)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)
                back = error[:, None] * self.out
                d = np.zeros_like(act)
                rows, cols = np.arange(len(part))[:, None], np.arange(FILTERS)[None]
                d[:, BEFORE:BEFORE + INSIDE - REACH + 1] += (back[:, 2 * FILTERS:] / filled)[:, None] * live
                np.add.at(d, (rows, at_out, cols), back[:, :FILTERS])
                np.add.at(d, (rows, at_in, cols), back[:, FILTERS:2 * FILTERS])
                d *= act > 0
                to_patch = (d @ self.kernel.T).reshape(len(part), -1, REACH, EMBED)
                grad_embed = np.zeros_like(self.embed)
                steps = to_patch.shape[1]
                for r in range(REACH):
                    np.add.at(grad_embed, mine[:, r:r + steps], to_patch[:, :, r])
                grads = {"embed": grad_embed, "kernel": np.tensordot(patches, d, ((0, 1), (0, 1))),
                         "offset": d.sum((0, 1)), "out": pooled.T @ error + 1e-4 * self.out, "bias": np.array([error.sum()])}
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * grads[k]
                    second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                    value = getattr(self, k)
                    value -= rate * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)


def train(positive: list[str], negative: list[str], recall: float = RECALL) -> Network:
    """A fitted and calibrated network; its threshold stays above 1 if there is too little to learn from."""
    net = Network()
    if min(len(positive), len(negative)) < LEAST_FINDINGS:
        return net
    windows = [*positive, *negative]
    y = np.array([1.0] * len(positive) + [0.0] * len(negative))
    x = encoded(windows)
    held = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % 4 == 0 for w in windows])
    if not 0 < y[held].sum() < held.sum() or not 0 < y[~held].sum() < (~held).sum():
        return net
    net.fit(x[~held], y[~held])
    # Candidates have no key word: the held part counts as it stands and with its surroundings hidden.
    shown, told = np.concatenate([x[held], hidden(x[held])]), np.tile(y[held], 2)
    raw = np.concatenate([net.forward(shown[i:i + 256])[0] for i in range(0, len(shown), 256)])
    net.slope, net.shift = calibration(raw, told, np.ones(len(told)))
    p = 1 / (1 + np.exp(-np.clip(net.slope * raw + net.shift, -30, 30)))
    ones = np.sort(p[told == 1])
    net.threshold = float(ones[int((1 - recall) * len(ones))])
    return net


FOUND = ("starts array<int>, kinds array<int>, ends array<int>, values array<int>, cand_starts array<int>, "
         "cand_ends array<int>, base_windows array<string>, cand_texts array<string>, plain_kinds array<int>, "
         "plain_windows array<string>")


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: (doc_id, text) to the document's base findings and candidates with their windows, one row each."""
    for batch in batches:
        rows = []
        for t in batch.column(1):
            text = t.as_py() or ""
            base = base_findings(text)
            cand = candidates(text, base)
            plain = [(k, w) for c in cand if (k := harmless(text[slice(*c)])) for w in windows_over(text, *c)]
            if (word := ordinary_word(text, [*((b[0], b[2]) for b in base), *cand])):
                plain.append((0, window(text, *word)))
            rows.append(([b[0] for b in base], [b[1] for b in base], [b[2] for b in base], [b[3] for b in base],
                         [c[0] for c in cand], [c[1] for c in cand], [window(text, b[3], b[2]) for b in base],
                         [text[max(0, s - BEFORE):e + AFTER] for s, e in cand], [k for k, _ in plain], [w for _, w in plain]))
        columns = list(zip(*rows))
        ints, texts = pa.list_(pa.int32()), pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, ints) for c in columns[:6]), *(pa.array(c, texts) for c in columns[6:8]),
             pa.array(columns[8], ints), pa.array(columns[9], texts)],
            names=["doc_id", "starts", "kinds", "ends", "values", "cand_starts", "cand_ends", "base_windows", "cand_texts",
                   "plain_kinds", "plain_windows"])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_stage(narrow, scan_batches, f"doc_id long, {FOUND}")


def learn(found: DataFrame, per_label: int = PER_LABEL, recall: float = RECALL) -> Network:
    """Train on at most ``per_label`` distinct windows of either label, those of the smallest hashes of each kind."""
    def sample(windows: DataFrame, most: int) -> list[str]:
        key = F.xxhash64("w", F.lit("secrets"))
        # The smallest hashes: each task passes on no more than it needs; equal windows fall together.
        return [r.w for r in windows.select("w", key.alias("k")).distinct().orderBy("k").limit(most).collect()]
    quarter = per_label // (PLAIN_KINDS + 1)
    plain = found.select(F.explode(F.arrays_zip("plain_kinds", "plain_windows")).alias("p"))
    picked = [w for kind in range(PLAIN_KINDS)
              for w in sample(plain.where(F.col("p.plain_kinds") == kind).select(F.col("p.plain_windows").alias("w")), quarter)]
    positive = sample(found.select(F.explode("base_windows").alias("w")), per_label)
    made = generated_secrets(min(len(positive), per_label // 2) if len(positive) >= LEAST_FINDINGS else 0, positive)
    net = train([*positive, *made], [*picked, *generated(quarter, picked)], recall)
    # Where the sample was not all, the threshold is set by all.
    return net if len(positive) < per_label else settle_threshold(net, found, made, recall)


def held_scores(net: Network, windows: list[str]) -> np.ndarray:
    """Steps of 1/``STEPS`` that the raw scores of windows reach, as they stand and with their surroundings hidden."""
    if not windows:
        return np.zeros(0, np.int64)
    x = encoded(windows)
    raw = [net.forward(v[i:i + 256])[0] for v in (x, hidden(x)) for i in range(0, len(x), 256)]
    return np.floor(np.clip(np.concatenate(raw), -MOST_RAW, MOST_RAW) * STEPS).astype(np.int64)


def held_score_batches(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    """Task: windows to the steps of their scores."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(held_scores(net, batch.column(0).to_pylist()), pa.int64())], names=["step"])


def settle_threshold(net: Network, found: DataFrame, made: list[str], recall: float) -> Network:
    """The threshold that keeps the wanted recall over every distinct base window that the training has left out, and over
    the made ones left out. Tasks score them; the driver gets a histogram, whose size does not depend on the windows."""
    if net.threshold > 1 or net.slope <= 0:
        return net
    windows = found.select(F.explode("base_windows").alias("w")).where(F.crc32("w") % 4 == 0).distinct()
    counts = {r.step: r["count"] for r in arrow_stage(windows, held_score_batches, "step long", net).groupBy("step").count().collect()}
    for step in held_scores(net, [w for w in made if zlib.crc32(w.encode("utf-8", "surrogatepass")) % 4 == 0]).tolist():
        counts[step] = counts.get(step, 0) + 1
    left = int((1 - recall) * sum(counts.values()))
    for step in sorted(counts):
        left -= counts[step]
        if left < 0:
            net.threshold = float(1 / (1 + np.exp(-np.clip(net.slope * step / STEPS + net.shift, -30, 30))))
            break
    return net


def added(net: Network, starts: list[int], ends: list[int], texts: list[str]) -> list[tuple[int, int]]:
    """What the network takes for secrets in candidates, given with the characters around them."""
    if not texts or net.threshold > 1:
        return []
    parts, windows = [], []
    for s, e, t in zip(starts, ends, texts):
        shift = s - min(s, BEFORE)
        parts += [(at, min(e, at + INSIDE)) for at in places(s, e)]
        windows += windows_over(t, s - shift, e - shift)
    out: list[tuple[int, int]] = []
    for (s, e), x in zip(parts, net.probability(windows)):
        if x >= net.threshold:
            # Windows of one candidate overlap; candidates never do.
            out[-1:] = [(out[-1][0], e)] if out and s < out[-1][1] else [*out[-1:], (s, e)]
    return out


def report_batches(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    """Task: scanned rows to counts and spans."""
    for batch in batches:
        got = {n: batch.column(n).to_pylist() for n in batch.schema.names if n != "base_windows"}
        counts, sums, spans = [[], [], []], [], []
        for i, starts in enumerate(got["starts"]):
            base = list(zip(starts, got["kinds"][i], got["ends"][i]))
            more = added(net, got["cand_starts"][i], got["cand_ends"][i], got["cand_texts"][i])
            for k in range(3):
                counts[k].append(got["kinds"][i].count(k))
            text = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
            sums.append(hashlib.sha256(text.encode()).hexdigest())
            spans.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted([*base, *((s, 3, e) for s, e in more)])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def findings(docs: DataFrame, per_label: int = PER_LABEL, recall: float = RECALL, *, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Counts, digest and spans per document. The texts are scanned once; the scan is written and learned from."""
    found = written(scan(docs, id_col=id_col, text_col=text_col), "secret-scan")
    net = learn(found, per_label, recall)
    return arrow_stage(found.drop("values", "plain_kinds", "plain_windows"), report_batches,
                       "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", net)


def mask(text: str, net: Network, label: str) -> str:
    """``text`` with the values of all findings replaced by ``label``."""
    base = base_findings(text)
    cand = candidates(text, base)
    more = added(net, [c[0] for c in cand], [c[1] for c in cand], [text[max(0, s - BEFORE):e + AFTER] for s, e in cand]) if cand else []
    spans = sorted([*((v, e) for _, _, e, v in base), *more])
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], label]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def mask_batches(batches: Iterator[pa.RecordBatch], at: int, net: Network, label: str) -> Iterator[pa.RecordBatch]:
    """Task: the same rows with secrets masked in column ``at``."""
    for batch in batches:
        texts = [None if t is None else mask(t, net, label) for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, batch.schema.names[at], pa.array(texts, pa.string()))


def masked(docs: DataFrame, per_label: int = PER_LABEL, recall: float = RECALL, label: str = "[secret]", *,
           text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with secrets replaced in the text; ``n_chars``, where it is a column, follows the text."""
    found = written(arrow_stage(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                                scan_batches, f"doc_id long, {FOUND}").select("base_windows", "plain_kinds", "plain_windows"), "secret-scan")
    net = learn(found, per_label, recall)
    names = docs.columns
    own = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    out = arrow_stage(own, mask_batches, own.schema, names.index(text_col), net, label).toDF(*names)
    if "n_chars" in names:
        changed = ~F.col("n_chars").eqNullSafe(F.length(text_col)) & F.col(text_col).isNotNull()
        out = out.withColumn("n_chars", F.when(changed & F.col("n_chars").isNotNull(), F.length(text_col).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out
