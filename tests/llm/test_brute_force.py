"""The registered queries against plain Python over the smallest tables, SQL twins, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

import __spark_entry__ as entry
import corpus_pipeline
from pressgauge.llm import collocations, components, decontam, langid, merkle, packing, quality, rans, secret_scan, simhash, tokens, toxicity, vafile
from pressgauge.llm.queries import SQL, tokenizer_file

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def run(spark, name):
    return entry.queries()[name](spark, SMALL).collect()


def whole(file, text, end):
    tok = Tokenizer.from_file(tokenizer_file(file))
    return [*tok.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    rows = con.execute(SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(rows.fetchall(), key=repr)


def test_all_are_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_op1(spark, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in run(spark, "op1_secrets"):
        t = texts[r.doc_id] or ""
        base = sorted([(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m.group(2)) >= 8]
                      + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
                      + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32])
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if not x.startswith("model")] == told.split(",")


def test_secret_network_learns_and_generalises():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 9)))
    def make(value, key=""):
        text = " ".join(word() for _ in range(6)) + " " + key
        return secret_scan.window(text + value + " " + word(), len(text), len(text) + len(value))
    hexed = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(18, 40)))
    digits = lambda: "".join(rng.choice("0123456789") for _ in range(16))
    net = secret_scan.train([make(hexed(), rng.choice(["token = ", "password="])) for _ in range(300)], [make(digits()) for _ in range(300)])
    assert net.threshold <= 1
    new = net.probability([make(hexed(), "my_pwd: ") for _ in range(100)])
    plain = net.probability([make(digits()) for _ in range(100)])
    assert (new >= net.threshold).mean() > 0.9 and (plain >= net.threshold).mean() < 0.05


def _secret_rows(rng, token):
    """Texts with base findings, harmless runs and, in a third of the rows, ``token()``; and where the tokens stand."""
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    rows, planted = [], {}
    for i in range(1800):
        words = [word() for _ in range(10)]
        if i % 3 == 0:
            words.insert(5, rng.choice([f"password={hexed(16)}", f"token = {hexed(24)}", hexed(40), "AKIA" + hexed(16).upper()]))
        elif i % 3 == 1:
            words.insert(5, rng.choice([str(rng.randrange(10 ** 15, 10 ** 16)), f"/{word()}/{word()}/{word()}/{word()}7", f"{word()}_{word()}_{word()}_{word()}_12"]))
        else:
            words.insert(5, token())
            at = len(" ".join(words[:5])) + 1
            planted[i] = (at, at + len(words[5]))
        rows.append((i, " ".join(words)))
    return rows, planted


def _covered(row, span):
    got = [tuple(map(int, x.split(":")[1:])) for x in row.spans.split(",") if x.startswith("model:")]
    return any(s <= span[0] and span[1] <= e for s, e in got)


@pytest.mark.parametrize("prefix,n", [("ghp_", 36), ("", 24)])
def test_op1_finds_a_frequent_shape_that_no_base_pattern_knows(spark, prefix, n):
    rng = random.Random(n)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows, planted = _secret_rows(rng, lambda: prefix + "".join(rng.choice(signs) for _ in range(n - 2)) + "x7")
    got = {r.doc_id: r for r in secret_scan.findings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(_covered(got[i], span) for i, span in planted.items()) / len(planted) > 0.8
    assert sum("model" in got[i].spans for i, _ in rows if i % 3 == 1) < 30


def test_op1_reads_long_runs_whole(spark):
    rng = random.Random(8)
    value = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24)) + "x7"
    chain = lambda n: "".join("/" + rng.choice(["usr", "local", "share", "data", "lib", "report", "home"]) for _ in range(n))
    rows, planted = _secret_rows(rng, lambda: chain(16) + "1/" + value() + chain(rng.randint(0, 9)))
    plain = {i: f"see {chain(16)}1{chain(8)} there" for i in range(5000, 5100)}
    got = {r.doc_id: r for r in secret_scan.findings(spark.createDataFrame(rows + list(plain.items()), "doc_id long, text string")).collect()}
    texts = dict(rows)
    spans = {i: re.search(r"1/(\w{24}x7)", texts[i]).span(1) for i in planted}
    assert min(s - planted[i][0] for i, (s, _) in spans.items()) > secret_scan.INSIDE
    assert sum(_covered(got[i], span) for i, span in spans.items()) / len(spans) > 0.8
    assert sum("model" in got[i].spans for i in plain) < 5
    assert all(x.split(":")[1] != str(planted[i][0]) for i in list(planted)[:50] for x in got[i].spans.split(",") if x)


def test_threshold_keeps_the_recall_where_secrets_look_like_others():
    rng = random.Random(12)
    make = lambda: secret_scan.window("".join(rng.choice("0123456789") for _ in range(16)), 0, 16)
    positive = [make() for _ in range(300)]
    net = secret_scan.train(positive, [make() for _ in range(900)])
    held = [w for w in positive if zlib.crc32(w.encode()) % 4 == 0]
    assert (net.probability(held) >= net.threshold - 1e-9).mean() >= 0.98 - 1 / len(held)


def test_windows_cover_a_run():
    for n in (8, 48, 49, 60, 61, 500):
        at = secret_scan.places(10, 10 + n)
        assert {k for a in at for k in range(a, min(10 + n, a + secret_scan.INSIDE))} == set(range(10, 10 + n))


def test_harmless_runs_are_words_and_numbers_only():
    for run in ("4041894974608795", "2024-05-12-17", "/usr/local/share/data7", "my_long_variable_name_12", "SomeClassName2"):
        assert secret_scan.harmless(run), run
    for run in ("ghp_16C7e42F292c6912E7710c838347Ae178B4a", "sk-proj1a2b3c4d5e6f7g8h", "eyJhbGciOiJIUzI1NiJ9", "dGhpcyBpcyBub3Q0",
                "deadbeef01234567aa", "qzxvkwpjh-2024-data"):
        assert secret_scan.harmless(run) is None, run


def test_op2_held_out(spark):
    rows = toxicity.judge(spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    right = sum(y and p for y, p in held)
    assert right / sum(y for y, _ in held) > 0.8 and right / sum(p for _, p in held) > 0.9


def test_machine_finds_a_pair_that_no_weight_tells():
    rng = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.unique(np.concatenate([rng.choice(np.arange(50, 90), 5), [1 + a, 3 + b]])).astype(np.int32))
        y.append(int(a == b))
    machine = toxicity.fit_machine(np.array(y), rows, np.ones(3000), epochs=30)
    place = {t: i for i, t in enumerate(machine.terms.tolist())}
    p = machine.score([np.array([place[t] for t in r.tolist()]) for r in rows])
    assert ((p > 0.5) == np.array(y)).mean() > 0.9


def test_op4(spark, texts):
    rows = run(spark, "op4_packing")
    ids = {d: whole("word_bpe_49k.json", t, 2) for d, t in texts.items()}
    at, filled = dict.fromkeys(ids, 0), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start:r.start + r.length])
        at[r.doc_id] += r.length
    assert all(at[d] == len(x) for d, x in ids.items())
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert all(n == 4096 or n < 4096 and n & (n - 1) == 0 for n in filled.values())


def test_hilbert_curve_is_one_walk():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    index = packing.hilbert_index(cells, 3)
    assert sorted(index) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1) == 1).all()


def test_op6_held_out(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [(lang[r.doc_id], r.lang_pred) for r in langid.identify(docs).collect() if r.held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in langid.identify(docs.limit(200)).where("held_out").collect())


def test_op7_finds_edited_passages_and_no_others(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    plain = lambda t: " ".join(decontam.WORD((t or "").lower()))
    exact = {(d, i) for d, t in texts.items() for i, x in items if f" {plain(x)} " in f" {plain(t)} "}
    got = {(r.doc_id, r.item_id): r for r in run(spark, "op7_decontamination")}
    assert exact <= set(got)
    for (d, i), r in got.items():
        item, doc = (decontam.word_codes(t) for t in (dict(items)[i], texts[d]))
        assert decontam.edit_distance_in(item, doc)[0] <= r.distance <= 0.2 * len(item)
    rng, index = random.Random(3), decontam.Index([(i, decontam.word_codes(t)) for i, t in items])
    clean = [t for d, t in texts.items() if t and d not in {x for x, _ in got}]
    tests = []
    for k in range(200):
        words = items[k % len(items)][1].split()
        for _ in range(int(0.19 * len(decontam.WORD(items[k % len(items)][1].lower())))):
            at = rng.randrange(len(words))
            words[at:at + rng.randrange(2)] = [rng.choice(clean).split()[0]] * rng.randrange(2)
        host = clean[k % len(clean)].split()
        tests.append(" ".join([*host[:5], *words, *host[5:]]))
    found = decontam.matches(index, tests)
    assert sum(any(m[0] == items[k % len(items)][0] for m in f) for k, f in enumerate(found)) >= 195


@pytest.mark.parametrize("n", [5, 6, 7, 8, 9, 10, 12, 14, 15, 19, 20, 30, 59])
def test_op7_recall_by_length(n):
    rng = random.Random(n)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(i, rng.choices(vocabulary, k=n)) for i in range(40)]
    index = decontam.Index([(i, decontam.word_codes(" ".join(w))) for i, w in items])
    planted, tests = [], []
    for k in range(400):
        i, words = items[k % 40]
        words, kind = list(words), k // 40 % 3
        for at in sorted(rng.sample(range(n), n // 5), reverse=True):
            words[at:at + (kind < 2)] = [] if kind == 1 else ["zz"]  # substituted, left out or put in between
        planted.append(i)
        tests.append(" ".join([*rng.choices(vocabulary, k=7), *words, *rng.choices(vocabulary, k=7)]))
    found = decontam.matches(index, tests)
    assert all(i in {m[0] for m in f} for i, f in zip(planted, found))
    for text, f in zip(tests, found):
        codes = decontam.word_codes(text)
        assert {(m[0], m[2]) for m in f} == {(i, d) for i, w in items if (d := decontam.edit_distance_in(
            decontam.word_codes(" ".join(w)), codes)[0]) <= n // 5}


def test_edit_distance():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(1, 8)), rng.integers(0, 4, rng.integers(1, 12))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        assert decontam.edit_distance_in(a.astype(np.uint32), b.astype(np.uint32))[0] == min(row)


def _next(row, x, b):
    out = [row[0] + 1]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def _classes(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1:] ^ prints[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_op9(spark, texts):
    ids = sorted(texts)
    prints = np.array([_fingerprint(texts[d]) for d in ids], dtype=np.uint64)
    want = {d: (f"{int(f):016x}", ids[c]) for d, f, c in zip(ids, prints, _classes(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op9_simhash")} == want


def test_large_buckets_are_divided_without_losing_a_link(spark):
    rng = np.random.default_rng(1)
    flips = [sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(600)]
    points = np.unique(np.array([b ^ f for b in (0, 0x5A5A << 20) for f in flips], dtype=np.uint64))
    signed = points.view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    groups = {}
    for x, c in zip(signed.tolist(), _classes(points)):
        groups.setdefault(c, []).append(x)
    want = {x: min(g) for g in groups.values() for x in g}
    assert {r.fp: r.component for r in simhash.classes(df, 3, 20).collect()} == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (1000, 1000)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 1000: 1000, 1001: 1000}


def test_op10(spark, texts):
    at = 0
    rows = {r.doc_id: r for r in run(spark, "op10_token_output")}
    for d in sorted(texts):
        ids = whole("byte_bpe_50k.json", texts[d], 0)
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 300_000])
def test_shards_round_trip_and_notice_damage(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50_000).astype("<u2")
    lengths = np.array([n // 3, n - n // 3])
    blob = rans.encode_shard(ids, [None, 7], lengths)
    out, docs, sizes = rans.decode_shard(blob)
    assert (out == ids).all() and docs == [None, 7] and (sizes == lengths).all()
    hurt = bytearray(blob)
    hurt[-1 if n > 256 else -9] ^= 1
    with pytest.raises((rans.Damaged, zlib.error)):
        rans.decode_shard(bytes(hurt))


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_give_the_ids_of_the_whole(file, texts):
    odd = ["", "  ", "a  b\n\n c\t\td  ", "don't I'LL we've 'tis '", "日本語 text é", "x\x85y\xa0z", "Á é ½ ²", "\x1c a", "İ", "<|endoftext|> a",
           "a <|endoftext|> b", "a<|startoftext|>b", "<|EndOfText|>x", "< |endoftext|>", "<|endoftext|", "x <|startoftext|> <|endoftext|>",
           "ß ẞ Ǆ", " \n  x", "a\x00b", "𝒳 bold"]
    enc = tokens.Encoder(tokenizer_file(file))
    for t in [*odd, *list(texts.values())[:60]]:
        assert np.frombuffer(enc.ids(t or ""), "<u2").tolist() == whole(file, t, 0)[:-1]


def test_pipeline_stages(spark, texts):
    docs, kept = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), "test")
        kept.append(docs)
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    assert all(d.columns == columns for d in kept[:-1])
    one, two, three, four = ({r.doc_id: r.text for r in d.collect()} for d in kept[:-1])
    ids = sorted(one)
    classes = _classes(np.array([_fingerprint(one[d]) for d in ids], dtype=np.uint64))
    assert set(two) == {ids[c] for c in classes}
    index = decontam.Index([(r.item_id, decontam.word_codes(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()])
    assert set(three) == {d for d, t in two.items() if not decontam.matches(index, [t])[0]}
    assert set(four) == set(three) and not any(secret_scan.base_findings(t or "") for t in four.values())
    assert {r.doc_id for r in kept[-1].collect()} == set(four)
    assert sum(r.length for r in kept[-1].collect()) == sum(len(whole("word_bpe_49k.json", t, 2)) for t in four.values())


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(6)
    machine = toxicity.Machine(np.arange(30), rng.normal(size=30), rng.normal(size=(30, toxicity.FACTORS)), 0.4, 1.3, -0.2)
    for n in (0, 1, 2, 9):
        row = rng.choice(30, n, replace=False)
        told = 0.4 + sum(machine.weights[i] for i in row) + sum(
            float(machine.factors[i] @ machine.factors[j]) for a, i in enumerate(row) for j in row[:a])
        assert machine.score([row])[0] == pytest.approx(1 / (1 + np.exp(-(1.3 * told - 0.2))))


def _grams(text):
    """Padded letter runs, as classes, and their n-grams of one to three, counted."""
    table, counts = langid.class_table(), {}
    runs = re.findall(r"[\x01-\xff]+", "".join(chr(table[ord(c)]) for c in text.lower()))
    line = "\0" + "".join(r + "\0" for r in runs)
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i:i + n]
            if (g[0] != "\0" if n < 3 else g[0] != "\0" or g[2] != "\0"):
                code = sum(ord(c) << 8 * (n - 1 - k) for k, c in enumerate(g)) + (0, 1 << 24, 1 << 25)[n - 1]
                counts[code] = counts.get(code, 0) + 1
    return counts


def test_op6_by_plain_counters(spark, texts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    best = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:langid.PROFILE]]
    sums = {}
    for d, t in texts.items():
        if lang[d] is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            for g, n in _grams(t or "").items():
                sums.setdefault(lang[d], {}).setdefault(g, 0)
                sums[lang[d]][g] += n
    profiles = {name: {g: k for k, g in enumerate(best(c))} for name, c in sums.items()}
    for r in run(spark, "op6_language_id"):
        mine = best(_grams(texts[r.doc_id] or ""))
        far = {name: sum(abs(p[g] - k) if g in p else langid.PROFILE for k, g in enumerate(mine)) for name, p in profiles.items()}
        name = min(sorted(far), key=far.get) if mine else "und"
        assert r.lang_pred == name and r.score == pytest.approx(1 - far[name] / (langid.PROFILE * len(mine)) if mine else 0)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_language_pieces_cut_no_word(monkeypatch, size):
    text = "Über  den Wolken, 12 muss -- die Freiheit wohl  grenzenlos sein"
    want = np.sort(langid.gram_codes(text))
    monkeypatch.setattr(langid, "PIECE", size)
    assert (np.sort(langid.gram_codes(text)) == want).all()
    counts = _grams(text)
    assert dict(zip(*(x.tolist() for x in langid.counted(want)))) == counts


def _climbed(rows):
    """Leaves, subroots, root and proofs by plain hashing; rows are (doc_id, source, lang, n_chars, text)."""
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda r, text: digest("".join(map(said, (*r[:4], text))))
    lower = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def climb(levels, i, folded, proof):
        for level in levels[:-1]:
            run, at = level[i // 16 * 16:i // 16 * 16 + 16], i % 16
            proof += "".join(run[:at] + run[at + 1:])
            folded, i = digest("".join(run[:at] + [folded] + run[at + 1:])), i // 16
        return folded, proof

    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4]))):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grow([leaf_of(r, r[4]) for r in groups[s]]) for s in names}
    top = grow([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded, proof = climb(top, k, *climb(trees[s], i, leaf_of(r, lower(r[4]) if hit else r[4]), ""))
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], digest(proof), folded, folded == top[-1][0]))
    return out


def test_op11_over_several_levels_and_blocks(spark):
    rng = random.Random(11)
    name = lambda: rng.choices(["hot", *(f"s{k}" for k in range(40)), None, "é", ""], [4000, *[10] * 40, 30, 5, 5])[0]
    rows = [(rng.choice([None, i]) if i % 97 == 0 else i, name(), rng.choice(["en", None]), rng.choice([None, i % 7]),
             rng.choice([None, "", f"text {i}", f"Text É {i % 5}"])) for i in range(6000)]
    rows += [rows[5], rows[5]]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, root string")
    got = sorted(map(tuple, merkle.manifest(docs.repartition(7)).collect()), key=repr)
    want = sorted(_climbed(rows), key=repr)
    assert got == want and 0 < sum(not r[6] for r in got) < len(got)
    assert max(sum(r[1] == "hot" for r in rows), 0) > 4096


def test_op12_held_out(spark):
    rows = quality.judge(spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    right = sum(y and p for y, p in held)
    assert right / sum(y for y, _ in held) > 0.97 and right / sum(p for _, p in held) > 0.97
    assert sum(not p for y, p in held if not y) / sum(not y for y, _ in held) > 0.9


def test_quality_indicators_by_plain_strings():
    words = quality.Grams()
    for text in ("", "one", "The the THE end!!", "a1 a1 a1 b22,,, É-x x_y __ 3.14", "日本 語 語"):
        found = text.split()
        told = {("w", w.lower()) for w in found} | {("a", w[:3]) for w in found} | {("z", w[-3:]) for w in found}
        form = ["=" if i and w.lower() == found[i - 1].lower() else quality.shape(w) for i, w in enumerate(found)]
        told |= {("ww", found[i].lower(), found[i + 1].lower()) for i in range(len(found) - 1)}
        told |= {("f", f) for f in form} | {("ff", *form[i:i + 2]) for i in range(len(form) - 1)} | {("fff", *form[i:i + 3]) for i in range(len(form) - 2)}
        assert len(quality.indicators(text, words)) == len(told)
    assert [quality.shape(w) for w in ("Ab12,,", "HELLO!!", "x", "É", "McX", "a-b", "ЯЖ", "Éa")] == ["Xx9,", "X!", "x", "X", "XxX", "x-x", "x", "Xx"]


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 6))
    y = np.where(x[:, 0] + 0.4 * rng.normal(size=80) > 0, 1.0, -1.0)
    cost = np.where(y > 0, 0.7, 0.4)
    w = quality.dual_descent([(np.arange(6), r) for r in x], y, cost, 6, epochs=3000, tolerance=1e-7)
    full = np.column_stack([x, np.ones(80)])
    loss = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (full @ w))).sum()
    assert all(loss(w) <= loss(w + 1e-3 * rng.normal(size=7)) + 1e-9 for _ in range(200))


def test_log_ratios():
    ones, zeros = np.array([9.0, 1, 0, 5]), np.array([0.0, 1, 3, 5])
    p, q = (ones + 1) / (ones + 1).sum(), (zeros + 1) / (zeros + 1).sum()
    assert quality.log_ratios(ones, zeros) == pytest.approx(np.where([True, False, True, True], np.log(p / q), 0))


def _collocations(rows, least, share, longest=5):
    """(lang, phrase, a, l, r, n, score) by plain counting; rows are (lang, text)."""
    counts, totals = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] = totals.get(lang, 0) + len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    key = lang, tuple(words[i:i + n])
                    counts[key] = counts.get(key, 0) + 1
    many = {k: f for k, f in counts.items() if f >= least}
    gone = {(lang, p[i:i + m]) for (lang, p), f in many.items() for m in range(1, len(p)) for i in range(len(p) - m + 1)
            if 100 * f >= share * many[lang, p[i:i + m]]}
    out = []
    for (lang, p), a in many.items():
        if len(p) > 1 and (lang, p) not in gone:
            s, _, l, r = min((1000 * a * totals[lang] // (many[lang, p[:k]] * many[lang, p[k:]]), k, many[lang, p[:k]], many[lang, p[k:]])
                             for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, l, r, totals[lang], s))
    return out


@pytest.mark.parametrize("least,share,rows_a_part", [(3, 100, 1_000_000), (3, 100, 40), (2, 60, 17), (5, 80, 3)])
def test_op13_by_plain_counting(spark, texts, monkeypatch, least, share, rows_a_part):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rng, words = random.Random(5), ["a", "b", "c", "dd", "É", "x-y", "z\x00"]
    rows = [(lang[d], t) for d, t in sorted(texts.items())[:25]]
    rows += [(rng.choice(["q", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", ",,"])
             for _ in range(60))) for _ in range(40)] + [("q", None), ("q", ""), ("long", "k " * 5000)]
    monkeypatch.setattr(collocations, "ROWS_A_PART", rows_a_part)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, phrase string").repartition(5)
    got = [tuple(r)[:1] + tuple(r)[2:] for r in collocations.collocations(df, least, None, share).collect()]
    want = _collocations(rows, least, share)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    if rows_a_part == 40:
        top = collocations.collocations(df, least, 7, share).collect()
        for name in {r.lang for r in top}:
            best = sorted((w for w in want if w[0] == name), key=lambda w: (-w[6], -w[2], w[1].encode()))[:7]
            assert [(r.phrase, r["rank"]) for r in sorted(top, key=lambda r: r["rank"]) if r.lang == name] == [(w[1], k) for k, w in enumerate(best, 1)]


def test_op13_partitions_are_walked_in_the_order_of_the_sort(spark, monkeypatch):
    monkeypatch.setattr(collocations, "ROWS_A_PART", 2)
    rows = [("x", f"w{i:02d}", 1, 100 + i) for i in range(30)]
    rows += [("x", f"w{i:02d} v{j}", 2, 10 + j) for i in range(30) for j in range(i * 7 % 5)]
    stream = spark.createDataFrame(rows, "lang string, phrase string, size int, f long").withColumn("w", F.split("phrase", " "))
    order = [F.coalesce(F.get("w", F.lit(i)), F.lit("")) for i in range(2)]
    got = {r.phrase: (list(r.parts), r.ext) for r in collocations.walked(stream, order, len(rows), 2).collect()}
    most = {i: max((10 + j for j in range(i * 7 % 5)), default=0) for i in range(30)}
    assert got == {p: ([], most[int(p[1:])]) if n == 1 else ([100 + int(p[1:3])], 0) for _, p, n, _ in rows}


def test_op7_items_of_one_template(monkeypatch):
    rng = random.Random(1)
    items = [(i, f"of the w{i % 50} and v{i // 50}") for i in range(2000)]
    index = decontam.Index([(i, decontam.word_codes(t)) for i, t in items])
    monkeypatch.setattr(decontam, "SLICE", 1000)
    text = " ".join(rng.choice(["of the", "and", "x", "w7"]) for _ in range(300)) + " of the w7 and v3 end"
    found = {m[0]: m[2] for m in decontam.matches(index, [text])[0]}
    codes = decontam.word_codes(text)
    assert found == {i: d for i, t in items if (d := decontam.edit_distance_in(decontam.word_codes(t), codes)[0]) <= 1}


def test_op7_short_items():
    index = decontam.Index([(i, decontam.word_codes(t)) for i, t in enumerate(["solo", "two words", "now three words", "four of these words"])], least_words=1)
    found = decontam.matches(index, ["a solo act", "two  Words.", "two other words", "now three words, four of these words", None, ""])
    assert [[m[0] for m in f] for f in found] == [[0], [1], [], [2, 3], [], []]


def test_search_of_large_components(spark):
    rng = random.Random(9)
    size = lambda k: 1 if k == 7 else 10 ** rng.choice([0, 3, 5])
    rows = [(i, [float(rng.choice([-1, 1]) * rng.random() * size(k)) for k in range(8)]) for i in range(300)]
    rows += [(1000 + i, [2.0 ** 20 + i / 1024 if k == 0 else 0.0 for k in range(8)]) for i in range(20)]
    rows += [(2001, [2.0 ** 35 if k == 7 else 0.5 for k in range(8)])]
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    got = {}
    for r in vafile.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1024).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in [i for i in whole if i % 100 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:10]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(scores, 1)]
