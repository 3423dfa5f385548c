"""Set-level jobs against brute force and invariants."""

import itertools
import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pressgauge.operators import (cleaning as N, embedding as E, ml as M, pages as P, ranking as R, similarity as V,
                                  store as D, tfidf as TF)
from pressgauge.operators import experiments as X
from pressgauge.plans.training import training_pipeline
from pressgauge.session import small_side
from pressgauge.sources import articles as A
from pressgauge.sources.training import SourceSpec, detect_encoding, read_sources, validate_sources
from pressgauge.streaming import ingest as I


def brute(queries, corpus, k):
    unit = lambda v: v / (np.linalg.norm(v) + 1e-8)
    out = set()
    for qid, q in queries:
        scored = sorted(((-round(float(unit(q) @ unit(c)), 9), cid) for cid, c in corpus))[:k]
        out |= {(qid, cid, rank + 1) for rank, (_, cid) in enumerate(scored)}
    return out


@pytest.mark.parametrize("hold", ["requests", "corpus"])
@pytest.mark.parametrize("block", [8_000_000, 24])
def test_top_similar_equals_brute_force(spark, monkeypatch, hold, block):
    monkeypatch.setattr(V, "BLOCK_NUMBERS", block)  # 24 numbers: three rows a block, several passes
    rng = np.random.default_rng(7)
    corpus = [(i, np.round(rng.normal(size=8), 3)) for i in range(60)]
    corpus += [(60 + i, corpus[0][1]) for i in range(20)]  # a group of exact copies: ties go by id
    queries = [(i, np.round(rng.normal(size=8), 3)) for i in range(6)] + [(6, corpus[0][1])]
    frame = lambda rows: spark.createDataFrame([(i, v.tolist()) for i, v in rows], "id long, vec array<double>")
    got = V.top_similar(frame(queries), frame(corpus).repartition(5), 4, hold=hold)
    assert {(r.query_id, r.cand_id, r.rank) for r in got.collect()} == brute(queries, corpus, 4)


def test_top_similar_skips_null_and_defines_zero(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<double>")
    c = spark.createDataFrame([(1, None), (2, []), (3, [0.0, 0.0]), (4, [2.0, 0.0])], "id long, vec array<double>")
    assert [(r.cand_id, round(r.similarity, 6)) for r in V.top_similar(q, c, 5).orderBy("rank").collect()] == [(4, 1.0), (3, 0.0)]
    assert V.top_similar(q.limit(0), c, 5).count() == 0 and V.top_similar(q, c.limit(0), 5).count() == 0


def test_tfidf_cosine_excludes_same_site(spark):
    q = spark.createDataFrame([(1, "red green blue", "a.com")], "id long, t string, domain string")
    c = spark.createDataFrame([(1, "red green blue", "www.a.com"), (2, "red green", "b.com"), (3, "black", "c.com")],
                              "id long, t string, domain string")
    settings = TF.TfidfSettings(50, (1, 2), 1, 1.0, False, False)
    got = TF.tfidf_cosine(q, c, "id", "t", 5, settings, domain="domain").orderBy("rank").collect()
    assert [r.cand_id for r in got] == [2, 3] and got[1].similarity == 0.0


def test_tfidf_weights_by_hand(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "bb")], "id long, t string")
    rows = {(r.id, r.term): r.weight for r in TF.tfidf_vocab(df, "id", "t", TF.TfidfSettings(10, (1, 1), 1, 1.0)).collect()}
    idf_a, idf_b = np.log(3 / 2) + 1, 1.0
    a = (1 + np.log(2)) * idf_a
    assert rows[(1, "aa")] == pytest.approx(a / np.hypot(a, idf_b)) and rows[(2, "bb")] == pytest.approx(1.0)


def test_terms_keep_order(spark):
    df = spark.createDataFrame([("Héllo the big x world",)], "t string")
    row = df.select(TF.terms(F.col("t"), TF.TfidfSettings(stop_words=("the",))).alias("v")).first()
    assert row.v == ["hello", "big", "world", "hello big", "big world"]


def test_split_and_folds_do_not_depend_on_partitions(spark):
    df = spark.range(1, 502).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    splits = [sorted((r.doc_id, r.is_test) for r in R.stratified_split(df.repartition(n)).collect()) for n in (1, 8)]
    assert splits[0] == splits[1] and len(splits[0]) == 501
    for label, size in ((0, 334), (1, 167)):
        tests = [d for d, t in splits[0] if t and (d % 3 == 0) == bool(label)]
        assert abs(len(tests) - 0.2 * size) <= 1
    folds = R.kfold(df, 5).groupBy("label", "fold").count().collect()
    assert len(folds) == 10 and {r["count"] for r in folds} <= {33, 34, 66, 67}


def test_dedup_keeps_first(spark):
    rows = [("https://a/x", 1, "2024-01-02", "t", "new"), ("https://a/x", 0, "2024-01-03", "t", "old"),
            ("https://a/x", 0, "2024-01-01", "t", "first"), ("https://b", 1, None, "t", "only")]
    df = spark.createDataFrame(rows, "source_url string, batch int, published_at string, title string, content string")
    for parts in (1, 4):
        got = {(r.source_url, r.content) for r in N.dedup_by_url(df.repartition(parts)).collect()}
        assert got == {("https://a/x", "first"), ("https://b", "only")}


def test_store_merges(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "id string, ingested_at int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("b", 5, "w"), ("c", 1, "q")], "id string, ingested_at int, v string")
    assert {(r.id, r.v) for r in D.upsert_articles(old, new).collect()} == {("a", "z"), ("b", "w"), ("c", "q")}
    have = spark.createDataFrame([("u1", 1)], "url string, id int")
    batch = spark.createDataFrame([("u1", 2), ("u2", 4), ("u2", 3)], "url string, id int")
    assert {(r.url, r.id) for r in D.insert_if_absent(have, batch).collect()} == {("u1", 1), ("u2", 3)}


def test_lookup_loose(spark):
    store = spark.createDataFrame([("1", "https://a.com/x/", "c" * 200), ("2", "https://a.com/x/y", "c" * 200),
                                   ("3", "https://b.com", "short")], "id string, source_url string, content string")
    asked = spark.createDataFrame([("https://A.com/x",), ("https://b.com",), ("https://a.com/x/y?q",)], "url string")
    got = {r.request: r.id for r in D.lookup_by_url_loose(store, asked).collect()}
    assert got == {"https://a.com/x": "1", "https://a.com/x/y?q": "1"}


def test_small_side_goes_by_the_bytes_written(spark):
    """The optimizer broadcasts the written side by its size, and shuffles both beyond the threshold."""
    def plan():
        return spark.range(1_000_000).join(small_side(spark.range(10)), "id")._jdf.queryExecution().sparkPlan().toString()

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        assert "BroadcastHashJoin" in plan()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16b")
        assert "BroadcastHashJoin" not in plan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


PAGE = """<html><head><title>Site | T</title><meta property="og:site_name" content="The Site">
<meta property="article:published_time" content="2024-05-14T08:00:00Z"></head><body><nav>menu menu</nav>
<article class="x"><h1>A long headline here</h1><p>{a}</p><p>tiny</p><p>{b} <b>bold</b> &amp; more</p></article>
<p>outside the article element, long enough</p></body></html>"""


def test_extract_articles(spark):
    html = PAGE.format(a="First paragraph with enough words to count. " * 3, b="Second paragraph")
    rows = [(1, "https://www.news.org/a", html), (2, "https://x.org/b", "<html><body>" + "<p>no</p>" * 10 + "</body></html>"),
            (3, "https://y.org/c", "<div><p>Plain paragraph that is long enough to keep on its own.</p>"
                                    "<p>We use a cookie to remember that you have been here before now.</p>"
                                    "<p>Another plain paragraph that is also long enough to keep.</p></div>")]
    df = spark.createDataFrame(rows, "id int, url string, html string")
    out = {r.id: r for r in P.extract_articles(df).collect()}
    assert out[1].title == "A long headline here" and out[1].source == "The Site" and str(out[1].published_on) == "2024-05-14"
    assert out[1].content.startswith("First paragraph") and out[1].content.endswith("Second paragraph bold & more")
    assert "outside" not in out[1].content and "tiny" not in out[1].content
    assert "cookie" not in out[3].content and out[3].source == "Y" and out[3].title == "Untitled Article"
    assert 2 not in out
    dates = {r.id: r.published_on for r in P.extract_dates(df).collect()}
    assert str(dates[1]) == "2024-05-14" and dates[3] is None


def test_feeds(spark):
    rss = ("<?xml version='1.0'?><rss><channel><item><title><![CDATA[A &amp; B]]></title><link>https://a.com/1?u=2</link>"
           "<pubDate>Tue, 14 May 2024 08:00:00 GMT</pubDate><description>&lt;p&gt;Some text&lt;/p&gt;</description>"
           "<source url='https://s.com'>S</source></item><item><title>No link</title></item></channel></rss>")
    atom = ('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="https://b.com/2#x"/>'
            '<published>2024-05-15</published></entry></feed>')
    df = spark.createDataFrame([(1, rss), (2, atom)], "id int, xml string")
    assert {r.link for r in P.feed_links(df).collect()} == {"https://a.com/1", "https://b.com/2"}
    items = {r.id: r for r in P.feed_items(df, "id").collect()}
    assert items[1].title == "A & B" and items[1].source == "S" and items[1].snippet == "Some text"
    assert str(items[1].published_on) == "2024-05-14" and items[2].link == "https://b.com/2#x"


def test_pages_are_parsed_a_few_at_a_time():
    pages = [f"<title>t{i}</title><meta name='a' content='{i}'><p>text {i}</p>" for i in range(150)]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(150)), "html": pages})
    got = list(P.parsed_batches(iter([batch]), ["page_id"], "html"))
    assert max(b.num_rows for b in got) == P.PARSED < 150
    rows = [r for b in got for r in b.to_pylist()]
    assert [(r["page_id"], r["title_tag"], r["meta"], r["paragraphs"]) for r in rows] == [
        (i, f"t{i}", [("a", str(i))], [f"text {i}"]) for i in range(150)]


def test_sitemap_limits(spark):
    urls = "".join(f"<url><loc>https://a.com/news/2024/{i}</loc></url>" for i in range(250))
    df = spark.createDataFrame([(1, f"<urlset>{urls}</urlset>")], "id int, xml string")
    got = P.sitemap_links(df, "id", scanned=200, kept=100)
    assert got.count() == 100 and got.agg(F.max("position")).first()[0] == 100
    assert P.sitemap_links(df, "id", scanned=200, kept=1000).count() == 200


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "some words in here"), (2, "   short "), (3, None), (4, "some words in here")], "id long, t string")
    rows = {r.id: r.embedding for r in E.embed_documents(df, "id", "t").collect()}
    assert set(rows) == {1, 4} and rows[1] == rows[4] and len(rows[1]) == 64
    assert np.linalg.norm(rows[1]) == pytest.approx(1.0, abs=1e-6)


def test_embed_documents_query_on_words_that_cancel(spark, tmp_path):
    signs, pair = {}, None
    for word in (f"word{i}" for i in range(1000)):
        h = zlib.crc32(word.encode())
        pair = pair or ((signs[(h >> 1) % 64, 1 - h % 2], word) if ((h >> 1) % 64, 1 - h % 2) in signs else None)
        signs[(h >> 1) % 64, h % 2] = word
    rows = [(1, " ".join(pair)), (2, "--- ... !!! ???"), (3, "plain words here")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["embed_documents"](spark, str(tmp_path)).collect()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.execute(entry.oracle_sql()["embed_documents"]).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want) == [(1, 64, 1.0), (3, 64, 1.0)]


def article(i, url, text="long enough content " * 5):
    return (f"title {i}", text, url, f"2024-01-{i:02d}")


def test_stream_equals_batch_and_stores_a_url_once(spark, tmp_path):
    schema = "title string, content string, source_url string, published_at string"
    drops = [[article(1, "https://a.com/1?x"), article(2, "https://a.com/2")],
             [article(3, "https://a.com/1"), article(4, "https://a.com/4/"), article(5, "https://a.com/5", "short")]]
    for n, rows in enumerate(drops):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        I.ingest_stream(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/check").awaitTermination()
    stored = {(r.source_url, r.title) for r in I.read_store(spark, f"{tmp_path}/store").collect()}
    frames = [spark.createDataFrame(rows, schema) for rows in drops]
    batch = {(r.source_url, r.title) for r in I.ingest_batch(*frames, F.current_timestamp()).collect()}
    assert stored == batch == {("https://a.com/1", "title 1"), ("https://a.com/2", "title 2"), ("https://a.com/4", "title 4")}
    runs = spark.read.parquet(f"{tmp_path}/store/runs").orderBy("batch_id").collect()
    assert [(r.scraped, r.stored, r.failed) for r in runs] == [(2, 2, 0), (3, 1, 2)]
    # A repeated micro-batch replaces its own rows and changes nothing.
    I.store_batch(frames[1], 1, f"{tmp_path}/store")
    assert {(r.source_url, r.title) for r in I.read_store(spark, f"{tmp_path}/store").collect()} == stored


def test_csv_sources(spark, tmp_path):
    (tmp_path / "fake.csv").write_text('title,text\n"A ""quoted"" one","two\nlines"\n2024-01-01,x\n', encoding="utf-8")
    (tmp_path / "latin.csv").write_bytes("text\ncafé\n".encode("latin-1"))
    (tmp_path / "lab.csv").write_text("title,text,label\nt,a, True \nt,b,false\nt,c,?\n")
    at = lambda n: str(tmp_path / n)
    specs = [SourceSpec(at("fake.csv"), "f", 1), SourceSpec(at("latin.csv"), "l", 0), SourceSpec(at("lab.csv"), "b", None),
             SourceSpec(at("missing.csv"), "m", 0)]
    assert detect_encoding(spark, at("latin.csv")) == "ISO-8859-1" and detect_encoding(spark, at("fake.csv")) == "UTF-8"
    raw = read_sources(spark, specs)
    got = {(r.source, r.title, r.text) for r in raw.collect()}
    assert ("f", 'A "quoted" one', "two\nlines") in got and ("l", None, "café") in got and ("f", "2024-01-01", "x") in got
    assert {r.source: r.rows for r in validate_sources(raw).collect()} == {"f": 2, "l": 1, "b": 3}
    from pressgauge.plans.training import clean_corpora

    labels = sorted((r.source, r.text_full[-1], r.label) for r in clean_corpora(raw).collect())
    assert ("b", "a", 0) in labels and ("b", "b", 1) in labels and len(labels) == 5
    with pytest.raises(ValueError):
        (tmp_path / "bad.csv").write_text("title,body\na,b\n")
        read_sources(spark, [SourceSpec(at("bad.csv"), "x", 1)])


def test_article_files(spark, tmp_path):
    assert A.load_articles(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "a.csv").write_text("published_at,title,content,source_url,extra\nd,t,c,u,e\n")
    assert A.load_articles(spark, str(tmp_path / "a.csv")).first().asDict() == {
        "title": "t", "content": "c", "source_url": "u", "published_at": "d"}
    df = spark.createDataFrame([("a", "x.com"), ("b", "y.com")], "id string, domain string")
    A.append_articles(df, f"{tmp_path}/store")
    A.append_articles(df, f"{tmp_path}/store")
    back = spark.read.parquet(f"{tmp_path}/store")
    assert back.count() == 4 and "domain=x.com" in "".join(str(p) for p in (tmp_path / "store").iterdir())
    rows = {r.output: (r.present, r.is_complete, r.row_count)
            for r in A.output_inventory(spark, str(tmp_path), ["store", "gone"]).collect()}
    assert rows["gone"] == (False, False, None) and rows["store"][0]
    with pytest.raises(ValueError):
        A.write_clean(df, f"{tmp_path}/x", "xml")


def test_training_pipeline(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta"]
    for name, mark in (("real", "official report"), ("fake", "shocking secret")):
        lines = [f'"{a} {i}","{mark} {a} {b} text number {i} with some words."' for i, (a, b) in
                 enumerate(itertools.islice(itertools.cycle(itertools.product(words, words)), 40))]
        (tmp_path / f"{name}.csv").write_text("title,text\n" + "\n".join(lines) + "\n")
    specs = [SourceSpec(str(tmp_path / "real.csv"), "r", 0), SourceSpec(str(tmp_path / "fake.csv"), "f", 1)]
    out = training_pipeline(spark, specs, f"{tmp_path}/out", num_features=64)
    assert {r.label: r["count"] for r in out["label_distribution"].collect()} == {0: 40, 1: 40}
    m = out["metrics"].first()
    assert m.tn + m.fp + m.fn + m.tp == 16 and m.f1_score > 0.9 and 0.9 < m.roc_auc <= 1.0
    again = M.load_pipeline(f"{tmp_path}/out/model")
    assert again.transform(out["features"]).filter("prediction = label").count() >= 76
    done = A.output_inventory(spark, f"{tmp_path}/out", ["cleaned", "features", "metrics"]).collect()
    assert all(r.is_complete for r in done)


def test_metrics_and_deltas(spark):
    p = spark.createDataFrame([(0, 0.0)] * 5 + [(0, 1.0)] * 2 + [(1, 0.0)] + [(1, 1.0)] * 4, "label int, prediction double")
    r = M.weighted_metrics(M.binary_metrics(M.confusion_counts(p))).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (5, 2, 1, 4)
    assert r.precision == pytest.approx(4 / 6) and r.recall == pytest.approx(0.8) and r.f1_score == pytest.approx(8 / 11)
    assert r.weighted_precision == pytest.approx((4 / 6 * 5 + 5 / 6 * 7) / 12)
    runs = spark.createDataFrame([("Full Model", 0.8), ("x", 0.6), ("y", 0.9)], "experiment_name string, f1_score double")
    deltas = {d.experiment_name: d for d in X.ablation_deltas(runs).collect()}
    assert deltas["x"].delta_f1_pct == pytest.approx(-25.0)
    assert [d.experiment_name for d in X.largest_drops(X.ablation_deltas(runs), 1).collect()] == ["x"]
    none = M.binary_metrics(spark.createDataFrame([(3, 0, 0, 0)], "tn long, fp long, fn long, tp long")).first()
    assert none.precision == 0.0 and none.f1_score == 0.0 and none.accuracy == 1.0


def test_class_weights_and_folds(spark):
    df = spark.createDataFrame([(i, int(i < 2)) for i in range(10)], "doc_id long, label int")
    assert {r.label: r.weight for r in R.class_weights(df).collect()} == {0: 10 / 16, 1: 2.5}
    pipe = Pipeline(stages=M.scale_stages(["label"]))
    assert pipe.fit(df).transform(df).count() == 10


def _cosines(rows, k, idf_docs=None):
    """Plain tf-idf cosines of (id, text) rows among themselves; words and pairs, no limits. Zero-overlap rows fill up."""
    import math
    import re
    from collections import Counter

    def terms(t):
        w = re.findall(r"\w{2,}", t.lower())
        return Counter(w + [" ".join(p) for p in zip(w, w[1:])])
    bags = {i: terms(t) for i, t in rows}

    def vectors(docs):
        n, df = len(docs), Counter(x for d in docs for x in d)
        out = []
        for d in docs:
            v = {x: (1 + math.log(f)) * (math.log((1 + n) / (1 + df[x])) + 1) for x, f in d.items()}
            length = math.sqrt(sum(w * w for w in v.values()))
            out.append({x: w / length for x, w in v.items()})
        return out
    every = vectors([bags[i] for i, _ in rows] * 2)[:len(rows)]
    found = set()
    for q, (i, _) in enumerate(rows):
        s = {j: round(sum(w * every[c].get(x, 0) for x, w in every[q].items()), 9) for c, (j, _) in enumerate(rows)}
        order = sorted(s, key=lambda j: (-s[j], j))
        if idf_docs:
            pool = [j for j in order if s[j] > 0][:idf_docs]
            own = vectors([bags[i]] + [bags[j] for j in pool])
            s = {j: round(sum(w * v.get(x, 0) for x, w in own[0].items()), 9) for j, v in zip(pool, own[1:])}
            rest = [j for j in sorted(bags) if j not in s]
            order = sorted(s, key=lambda j: (-s[j], j)) + rest
        found |= {(i, j, round(s.get(j, 0.0), 7), r) for r, j in enumerate(order[:k], 1)}
    return found


@pytest.mark.parametrize("block,seed,scope", [(1024, 8192, "corpus"), (3, 5, "corpus"), (2, 1, "corpus"), (3, 5, "query")])
def test_inverted_index_is_exact(spark, monkeypatch, block, seed, scope):
    from pressgauge.operators import inverted as I

    monkeypatch.setattr(I, "BLOCK", block)
    monkeypatch.setattr(I, "SEED", seed)
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(40)]
    weight = 1 / np.arange(1, 41)
    rows = [(i, " ".join(rng.choice(words, rng.integers(2, 25), p=weight / weight.sum()))) for i in range(70)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "alone here"), (103, "lonely")]
    df = spark.createDataFrame(rows, "id long, t string")
    settings = TF.TfidfSettings(None, (1, 2), 1, 1.0, strip_accents=False)
    got = TF.tfidf_cosine(df, df, "id", "t", 4, settings, idf_scope=scope, pool=9)
    assert {(r.query_id, r.cand_id, round(r.similarity, 7), r["rank"]) for r in got.collect()} == _cosines(rows, 4, 9 if scope == "query" else None)


def test_tfidf_cosine_writes_only_what_requests_ask_for(spark, monkeypatch):
    # A corpus' terms are shuffled once; what is written are the weights of the terms that a request has.
    held = []
    monkeypatch.setattr(TF, "cut_lineage", lambda df, cut=TF.cut_lineage: held.append(cut(df)) or held[-1])
    corpus = [(i, f"shared only{i} other{i} other{i} third{i}") for i in range(50)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, t string")
    got = TF.tfidf_cosine(frame([(1, "shared words")]), frame(corpus), "id", "t", 2, TF.CROSSCHECK).collect()
    assert [(r.query_id, r.cand_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 0), (1, 1)]
    assert not any("terms" in df.columns or "term" in df.columns for df in held)
    assert max(df.count() for df in held) == 50 + 3


@pytest.mark.parametrize("most", [None, 3])
def test_terms_are_shuffled_as_numbers(spark, monkeypatch, most):
    # The one shuffle of all terms carries hashes and counts; words are longer and sort slower.
    plans = []
    monkeypatch.setattr(TF, "cut_lineage", lambda df, cut=TF.cut_lineage: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    lists = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["a", "c"]), (3, ["d", "d"]), (4, ["e"])], "id long, terms array<string>")
    settings = TF.TfidfSettings(most, (1, 1), 1, 1.0, sublinear=False)
    got = TF.asked_weights(lists.where("id = 1"), lists.where("id > 1"), settings)
    assert "hashpartitioning(idx" in plans[-1] and "hashpartitioning(term" not in plans[-1]
    assert "collect_list" not in plans[-1]
    # Frequencies over four texts: a 2, the others 1; the three commonest terms are a, b and d. Term c adds to a norm only.
    idf = lambda df: math.log(5 / (1 + df)) + 1
    one, two = math.hypot(idf(2), 2 * idf(1)), math.hypot(idf(2), 0 if most else idf(1))
    want = [(False, 2, idf(2) / two), (True, 1, idf(2) / one), (True, 1, 2 * idf(1) / one)]
    assert sorted((r.asks, r.id, round(r.weight, 9)) for r in got.collect()) == [(a, i, round(w, 9)) for a, i, w in want]


def test_term_counts(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["x"])], "id long, terms array<string>")
    assert sorted(tuple(r) for r in TF.term_counts(df).collect()) == [(1, "a", 1), (1, "b", 2), (4, "x", 1)]


def test_index_keeps_blocks_small_and_prunes(spark, monkeypatch):
    from pressgauge.operators import inverted as I

    monkeypatch.setattr(I, "BLOCK", 8)
    rows = [(i, t, w) for i in range(400) for t, w in ((0, 0.1 + (i == 7) * 0.8), (i % 40 + 1, 0.9))]
    index = I.build_index(spark.createDataFrame(rows, "id long, idx long, weight double"))
    sizes = [len(r.entries) for r in index.blocks.where("idx = 0").collect()]
    assert sum(sizes) == 400 and max(sizes) < 40
    q = spark.createDataFrame([(1, 0, 0.1), (1, 4, 0.9)], "query_id long, idx long, weight double")
    got = I.best_matches(index, q, 3).collect()
    assert [r.cand_id for r in sorted(got, key=lambda r: r["rank"])] == [3, 43, 83]
    plan = I.best_matches(index, q, 3)._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


@pytest.mark.parametrize("hold", ["requests", "corpus"])
@pytest.mark.parametrize("domain", [None, "d"])
def test_held_matches_are_those_of_the_index(spark, monkeypatch, hold, domain):
    from pressgauge.operators import inverted as I

    rng = np.random.default_rng(7)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(30)], rng.integers(2, 20))), f"s{i % 7}.com") for i in range(60)]
    few, many = (spark.createDataFrame(r, "id long, t string, d string") for r in (rows[::10], rows))
    q, c = (many, few) if hold == "corpus" else (few, many)
    settings, how = TF.TfidfSettings(None, (1, 2), 1, 1.0, strip_accents=False), []
    monkeypatch.setattr(I, "held_matches", lambda p, r, k, h, *a, f=I.held_matches: how.append(h) or f(p, r, k, h, *a))
    run = lambda: {(r.query_id, r.cand_id, round(r.similarity, 7), r["rank"])
                   for r in TF.tfidf_cosine(q, c, "id", "t", 4, settings, domain=domain).collect()}
    monkeypatch.setattr(I, "HELD", 0)
    index = run()
    assert not how and len(index) == 4 * q.count()
    monkeypatch.setattr(I, "HELD", 600)
    monkeypatch.setattr(I, "PAIRS", 8)
    assert run() == index and how == [hold]


def test_matching_against_few_requests_writes_no_pairs(spark, monkeypatch):
    # All texts are about as near to all requests: the pairs are more than the weights, and stay where they are scored.
    from pressgauge.operators import inverted as I

    held = []
    for module in (I, TF):
        monkeypatch.setattr(module, "cut_lineage", lambda df, cut=module.cut_lineage: held.append(cut(df)) or held[-1])
    frame = lambda n: spark.createDataFrame([(i, f"common words w{i % 3}") for i in range(n)], "id long, t string")
    got = TF.tfidf_cosine(frame(20), frame(300), "id", "t", 2, TF.CROSSCHECK).collect()
    assert {(r.query_id, r.cand_id) for r in got} == {(i, i % 3 + j) for i in range(20) for j in (0, 3)}
    assert max(df.count() for df in held) == 5 * 320 < 20 * 300


def test_matching_plan_has_no_python_and_no_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as D

    def none(*args, **kwargs):
        raise AssertionError("rows through the driver")
    monkeypatch.setattr(D, "toLocalIterator", none)
    rows = [(i, f"w{i} w{i + 1} common w{i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t string")
    many = TF.tfidf_cosine(df, df, "id", "t", 4, TF.TfidfSettings(None, (1, 2), 1, 1.0))
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "Pandas" not in plan and "regexp_extract_all" not in plan
    assert sum(r.query_id == r.cand_id for r in many.where("rank = 1").collect()) == 60


def test_no_sum_inside_a_lambda(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "bb")], "id long, t string")
    plan = TF.tfidf_vocab(df, "id", "t", TF.TfidfSettings(10, (1, 1), 1, 1.0))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan.split("collect_list")[0]


def test_features_are_fitted_on_the_training_part(spark):
    from pressgauge.operators import ml as M

    rows = [(i, i % 2, f"word{i % 5} other", float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, label int, text_full string, x double")
    test = {r.doc_id for r in M.stratified_split(df, "label", "doc_id", 0.2, M.SEED).where("is_test").collect()}
    odd = df.withColumn("x", F.when(F.col("doc_id").isin(*test), 1e6).otherwise(F.col("x")))
    got = [{r.doc_id: r.features for r in M.split_and_prepared(d, True, ["x"], 64).where("not is_test").collect()} for d in (df, odd)]
    assert got[0] == got[1]


def test_named_references(spark):
    from pressgauge.functions import text as T

    row = spark.range(1).select(T.decode_entities(F.lit("&copy; &agrave; &amp;lt; &#9999999; &nosuch; &#233;")).alias("t")).first()
    assert row.t == "© à &lt; � &nosuch; é"


def test_accents(spark):
    df = spark.createDataFrame([(1, "česko źąle őr łódź ét")], "id long, t string")
    got = TF.term_lists(df, "id", "t", TF.TfidfSettings(None, (1, 1), 1, 1.0)).first().terms
    assert got == ["cesko", "zale", "or", "łodz", "et"]


def test_folds_by_subtraction_equal_refitting(spark):
    from pyspark.ml.functions import vector_to_array

    from pressgauge.operators import ml as M

    rng = np.random.default_rng(5)
    rows = [(i, int(rng.random() < 0.3), " ".join(f"w{rng.integers(0, 30)}" for _ in range(rng.integers(1, 12))),
             float(rng.normal(1000, 3)), 7.0) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, label int, text_full string, x double, same double")
    held = M.fold_rows(df, 4, ["x", "same"], 64)
    statistics = M.fold_statistics(held, ["x", "same"])
    texts = held.select("doc_id", "fold").join(df, "doc_id")
    for fold in (1, 3):
        got = {r.doc_id: r for r in M.fold_vectors(held, statistics, fold, ["x", "same"]).withColumn("v", vector_to_array("features")).collect()}
        part = M.with_weights(texts.where(F.col("fold") != fold))
        stages = [*M.tfidf_stages(num_features=64), *M.scale_stages(["x", "same"]), M.combine_stage()]
        want = Pipeline(stages=stages).fit(part).transform(texts).withColumn("v", vector_to_array("features")).collect()
        weight = {r.label: r.weight for r in part.select("label", "weight").distinct().collect()}
        assert len(want) == len(got) == 90
        for r in want:
            assert got[r.doc_id].v == pytest.approx(r.v, abs=1e-8) and got[r.doc_id].weight == pytest.approx(weight[r.label])
            assert got[r.doc_id].is_test == (r.fold == fold)


def test_cross_validation_uses_every_row_once(spark):
    from pressgauge.operators import ml as M

    rows = [(i, i % 2, "good " * 3 if i % 2 else "bad " * 2, float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, label int, text_full string, x double")
    got = M.cross_validate(df, lambda: M.logistic(50), 4, columns=["x"], num_features=32).first()
    assert (got.folds, got["mean"], got["min"], got["max"]) == (4, 1.0, 1.0, 1.0)


def test_containment_join_equals_brute_force(spark):
    from pressgauge.operators import store as D

    rng = np.random.default_rng(8)
    hosts = ["https://a.com", "https://www.bb.org", "http://c.net/x", "ftp://d"]
    urls = [hosts[rng.integers(0, 4)] + "/" + "/".join("pqr"[rng.integers(0, 3)] * rng.integers(1, 5) for _ in range(rng.integers(0, 5)))
            for _ in range(150)] + ["", "a", "a.com", "/", "HTTPS://A.com/", "https://a.com/q/", "zzzzzzzzzz"]
    store = [(i, u, "x" * (50 if i % 11 == 0 else 200), i % 3) for i, u in enumerate(urls)] + [(3, urls[3], "x" * 200, 0)]
    asked = [u[:rng.integers(0, len(u) + 1)] for u in urls[::3]] + [urls[5] + "/more", "", "q", "nowhere.example", "https://a.com"]
    norm = lambda u: u.strip(" ").lower().rstrip("/")
    want = {}
    for r in {norm(u) for u in asked}:
        hits = [(norm(u) != r, len(u), u, i) for i, u, c, _ in store if len(c) > 100 and (r == norm(u) or r in norm(u) or norm(u) in r)]
        if hits:
            want[r] = min(hits)[2:]
    df = spark.createDataFrame(store, "id long, source_url string, content string, n int")
    found = D.lookup_by_url_loose(df, spark.createDataFrame([(u,) for u in asked], "url string"))
    assert found.columns == ["request", *df.columns]
    rows = found.collect()
    assert {r.request: (r.source_url, r.id) for r in rows} == want and len(rows) == len(want)


def _stamps(path):
    import os

    files = (os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))
    return {f: os.stat(f).st_mtime_ns for f in files}


def test_store_merge_rewrites_touched_buckets_only(spark, tmp_path):
    from pressgauge.operators import store as D

    path = str(tmp_path / "store")
    rows = [(f"k{i}", i, f"text {i}") for i in range(300)]
    schema = "id string, ingested_at long, content string"
    D.write_store(spark.createDataFrame(rows, schema), path, buckets=16)
    before = _stamps(path)
    batch = [("k7", 1, "older"), ("k9", 9, "tie"), ("new", 5, "first"), ("new", 6, "second"), ("k20", 1000, "newer")]
    written = D.merge_store(spark, path, spark.createDataFrame(batch, schema), buckets=16, merge_keys=1)
    got = {r.id: r.content for r in D.read_buckets(spark, path).collect()}
    want = {k: c for k, _, c in rows} | {"k9": "tie", "new": "second", "k20": "newer"}
    assert got == want and D.read_buckets(spark, path).count() == 301
    after = _stamps(path)
    kept = {f for f in before if after.get(f) == before[f]}
    assert 1 <= written <= 3 and len(kept) >= len(before) * (16 - written) / 16 - 1 and len(kept) < len(before)
    D.merge_store(spark, path, spark.createDataFrame(batch, schema), buckets=16)
    assert {r.id: r.content for r in D.read_buckets(spark, path).collect()} == want
    assert D.merge_store(spark, path, spark.createDataFrame([("k7", 1, "older")], schema), buckets=16) == 0
    D.merge_store(spark, path, spark.createDataFrame([("k1", 0, "no"), ("late", 3, "b"), ("late", 2, "a")], schema), buckets=16, insert_only=True)
    got = {r.id: r.content for r in D.read_buckets(spark, path).collect()}
    assert got == want | {"late": "a"}


def test_backfill_touches_only_what_lacks_a_vector(spark, tmp_path):
    from pressgauge.operators import embedding as E, store as D

    path = str(tmp_path / "store")
    rows = [(i, "scraped_news", "plain words " * 20, [0.5] if i % 25 else None) for i in range(200)]
    D.write_store(spark.createDataFrame(rows, "id long, article_type string, content string, embedding array<float>"), path, buckets=32)
    before = _stamps(path)
    done = E.backfill_store(spark, path, buckets=32)
    got = D.read_buckets(spark, path).collect()
    assert len(got) == 200 and all(r.embedding for r in got) and {len(r.embedding) for r in got if r.id % 25 == 0} == {64}
    after = _stamps(path)
    assert 1 <= done <= 8 and any(after.get(f) == t for f, t in before.items())


def test_store_merge_moves_no_text(spark, tmp_path, monkeypatch):
    from pressgauge.operators import store as D

    plans, write = [], D._write_buckets

    def keep(df, path, mode):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(df, path, mode)
    path, schema = str(tmp_path / "store"), "id string, ingested_at long, content string"
    D.write_store(spark.createDataFrame([(f"k{i}", i, "t") for i in range(50)], schema), path)
    monkeypatch.setattr(D, "_write_buckets", keep)
    D.merge_store(spark, path, spark.createDataFrame([("k1", 99, "u")], schema))
    assert plans and all("Sort" not in p and "Exchange hashpartitioning" not in p for p in plans)


def test_sensationalism_goes_from_model_to_zscore_to_heuristic(spark):
    from pressgauge.operators import linguistic as G, sensationalism as Z
    from pressgauge.plans.catalog_scores import stand_in_model

    rows = [(1, "t", " ".join(["word"] * 40)), (2, "t", " ".join(["other"] * 8)), (3, "Shock!", "no way"), (4, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, content string")
    stats = Z.feature_statistics(G.linguistic_features(df.select("content"), "content"))
    run = lambda **kw: {r.id: (r.sensationalism_method, r.sensationalism) for r in Z.sensationalism_chain(df, **kw).collect()}
    plain = {r.id: r.sensationalism for r in Z.sensationalism_heuristic(df).collect()}
    every = run(stats=stats, model=stand_in_model())
    assert [every[i][0] for i in (1, 2, 3, 4)] == ["model", "z_score", "heuristic", "heuristic"]
    assert every[3][1] == plain[3] and every[4][1] == plain[4]
    only = run(stats=stats)
    assert only[1][0] == "z_score" and only[2] == every[2]
    assert {i: ("heuristic", v) for i, v in plain.items()} == run()
    assert run(model=stand_in_model())[2] == ("heuristic", plain[2])


def test_stored_crosscheck_by_embedding_then_text(spark):
    from pressgauge.operators import crosscheck as K

    long = "storm over the northern harbour destroyed many boats " * 4
    store = [(1, "http://a.com/x", long, "scraped_news", [1.0, 0.0]), (2, "http://b.com/y", "short", "scraped_news", [1.0, 0.0]),
             (3, "http://c.com/z", "quiet election in a small village far away " * 4, "scraped_news", None),
             (4, "http://d.com/w", long, "user_article", [1.0, 0.0])]
    store = spark.createDataFrame([(i, u, u, "t", c, "s", k, e) for i, u, c, k, e in store],
                                  "id long, url string, source_url string, title string, content string, source string, article_type string, embedding array<float>")
    asked = spark.createDataFrame([(10, "http://q.com/1", long, [0.8, 0.6]), (11, "http://q.com/2", "quiet election in a village", None),
                                   (12, "http://q.com/3", "zzz yyy", None)], "id long, url string, content string, embedding array<float>")
    scores, pairs = K.crosscheck_stored(asked, store)
    got = {r.query_id: r for r in scores.collect()}
    assert {(r.query_id, r.cand_id) for r in pairs.collect()} == {(10, 1), (11, 3)}
    assert round(got[10].max_similarity, 6) == 0.8 and got[11].total_compared == 1
    assert (got[12].cross_check_score, got[12].status, got[12].total_compared) == (0.4, "Comparison Failed", 2)
    none, _ = K.crosscheck_stored(asked, store.where("id = 4"))
    assert {r.cross_check_score for r in none.collect()} == {0.3}


def test_a_micro_batch_reads_the_folders_of_its_ids_only(spark, tmp_path):
    from pressgauge.streaming import ingest as I

    store = str(tmp_path / "store")
    schema = "title string, content string, source_url string, published_at string"
    text = "a text that is long enough to be stored as an article of its own " * 3
    make = lambda ids: spark.createDataFrame([(f"t{i}", text, f"https://a.com/{i}", None) for i in ids], schema)
    I.store_batch(make(range(300)), 0, store, F.lit("2024-01-01").cast("timestamp"))
    I.store_batch(make([5, 6, 1000]), 1, store, F.lit("2024-01-01").cast("timestamp"))
    I.store_batch(make([5, 6, 1000]), 1, store, F.lit("2024-01-01").cast("timestamp"))
    assert I.read_store(spark, store).count() == 301
    one = I.seen_ids(spark, store, ["a"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "prefix" in plan.split("PartitionFilters: [")[1][:200]
    assert {r.id[:1] for r in one.collect()} == {"a"} and one.count() < 60


def test_compaction_keeps_rows_and_leaves_large_folders(spark, tmp_path):
    from pressgauge.sources import articles as A

    path = str(tmp_path / "by_domain")
    rows = spark.createDataFrame([(i, "hot.com" if i % 3 else f"d{i % 5}.com", "x" * 50) for i in range(300)], "id long, domain string, content string")
    for part in range(4):
        A.append_articles(rows.where(F.col("id") % 4 == part), path)
    files = len(spark.read.parquet(path).inputFiles())
    assert A.compact_articles(spark, path) == 6 and A.compact_articles(spark, path) == 0
    again = spark.read.parquet(path)
    assert len(again.inputFiles()) < files and again.count() == 300 and again.select("id").distinct().count() == 300


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace as Some

    from pressgauge.session import shared_folder

    conf = Some(get=lambda *a: None)
    far = Some(conf=conf, sparkContext=Some(getConf=lambda: conf, master="spark://host:7077", applicationId="x", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        shared_folder(far)


def test_positions_number_a_sorted_table(spark):
    from pressgauge.operators.ranking import positions

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7).orderBy("x")
    out = positions(df)
    assert {(r.x, r.position) for r in out.collect()} == {(i, i + 1) for i in range(1000)}
    assert positions(df.limit(0)).count() == 0


def test_vocabulary_fitted_by_grouping_gives_the_same_vectors(spark):
    texts = ["red green red blue", "green blue blue", "red red sky", "", "sky blue sky green", "red sky at night"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string")

    def vectors(model):
        words = model.stages[3].vocabulary
        return {r.doc_id: {words[i]: round(float(r.v[int(i)]), 9) for i in r.v.indices}
                for r in model.transform(df).select("doc_id", F.col("v").alias("v")).collect()}

    for limit, low, high in ((50, 2, 0.95), (50, 0.3, 4), (50, 1, 1.0)):
        old = Pipeline(stages=M.vocabulary_stages("t", limit, low, high, "v")).fit(df)
        assert vectors(M.fit_vocabulary(df, "t", limit, low, high, "v")) == vectors(old)
    assert M.fit_vocabulary(df, "t", 3, 1, 10, "v").stages[3].vocabulary == ["red", "blue", "sky"]


def test_sentiment_joins_counted_features(spark):
    from pressgauge.functions import lexicons as L
    from pressgauge.operators import linguistic as G

    texts = spark.createDataFrame([(1, "Very good. Very bad!"), (2, ""), (3, "left out")], "doc_id long, text string")
    mood = spark.createDataFrame([(1, 0.5, 0.1, 0.2, 0.3), (2, -0.5, 0.4, 0.5, 0.6)], "doc_id long, a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    want = G.linguistic_features(texts.join(mood, "doc_id"), "text", sentiment=names).select("doc_id", *L.FEATURE_NAMES)
    got = G.with_sentiment(G.linguistic_features(texts, "text").drop("text"), mood, "doc_id", names)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


def test_rows_of_a_fit_lie_in_as_many_tasks_as_it_may_use(spark, monkeypatch):
    from pressgauge.operators import ml as M

    monkeypatch.setattr(M, "LEAST_ROWS", 10)
    cores = spark.sparkContext.defaultParallelism
    parts = lambda n, *a: M.sized(spark.range(0, n, 1, 4 * cores), *a).rdd.getNumPartitions()
    assert parts(1000 * cores, 1, None) == cores and parts(1000 * cores, cores) == 1 and parts(9) == 1
    assert parts(1000 * cores) == min(cores, M.FLAT_TASKS)
    monkeypatch.setattr(M, "ROWS_A_TASK", 500)
    assert parts(1000 * cores, cores) == 2 * cores


def test_forest_keeps_the_nodes_of_its_rows_and_grows_the_same_trees(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from pressgauge.operators import ml as M

    rng = np.random.default_rng(4)
    rows = [(Vectors.dense(x), float(x[0] + x[1] > 0), 1.0) for x in rng.standard_normal((200, 4))]
    df = spark.createDataFrame(rows, ["features", "label", "weight"]).coalesce(1).cache()
    grown = M.forest(5, 6)
    assert grown.getCacheNodeIds()
    assert grown.fit(df).toDebugString.split("\n")[1:] == M.forest(5, 6).setCacheNodeIds(False).fit(df).toDebugString.split("\n")[1:]


def test_training_takes_texts_apart_once(spark):
    """The rows that idf and scaling are fitted on hold counts, not texts, and the model still scores raw rows."""
    from pyspark.ml.feature import HashingTF, IDF, Tokenizer

    from pressgauge.operators import ml as M

    plain, learned = M.unlearned([*M.tfidf_stages(num_features=64), *M.scale_stages(["x"])])
    assert isinstance(plain[0], Tokenizer) and isinstance(plain[-1], HashingTF) and isinstance(learned[0], IDF)
    columns = ["doc_id", "text_full", "words", "raw_features", "x"]
    assert M.read_by(learned, columns) == ["raw_features", "x"]
    rows = [(i, f"{'good calm' if i % 2 else 'bad loud'} word{i % 5}", float(i % 2), float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text_full string, label double, x double")
    done = M.train(df, M.feature_pipeline(M.linear_svc(20), columns=["x"], num_features=64))
    assert [type(s).__name__ for s in done.model.stages][:3] == ["Tokenizer", "StopWordsRemover", "HashingTF"]
    again = done.model.transform(done.test)
    assert again.count() == done.test.count() and again.where("prediction <> label").count() == 0


def test_fits_are_not_sent_the_names_of_components(spark):
    from pyspark.ml.feature import VectorAssembler

    from pressgauge.operators import ml as M

    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame([(1.0, 2.0)], "a double, b double"))
    assert "ml_attr" in df.schema["features"].metadata
    assert "ml_attr" not in M.sized(df).schema["features"].metadata and M.sized(df).first().features.toArray().tolist() == [1.0, 2.0]


def _own_tables(spark, folder, documents, benchmark):
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in documents],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


def test_feature_breakdown_gives_all_features(spark, tmp_path):
    from pressgauge.functions import lexicons as L
    from pressgauge.operators import linguistic as G
    from pressgauge.plans.catalog_corpus import stand_in_lists

    texts = [(1, "The THE and 2024! Is that 12% of the study?\nNo."), (2, "de la que und"), (3, ""), (4, "one one two. three")]
    con = _own_tables(spark, tmp_path, texts, [(0, "x")])
    got = entry.queries()["feature_breakdown"](spark, str(tmp_path))
    assert sorted(got.columns) == sorted(["doc_id", *L.FEATURE_NAMES])
    rows = {r.doc_id: r.asDict() for r in got.collect()}
    want = G.linguistic_features(spark.createDataFrame(texts, "doc_id long, text string"), "text", stand_in_lists())
    assert rows == {r.doc_id: {n: round(r[n], 9) if n != "doc_id" else r[n] for n in got.columns}
                    for r in want.select(*got.columns).collect()}
    twin = con.execute(entry.oracle_sql()["feature_breakdown"])
    names = [d[0] for d in twin.description]
    assert rows == {r["doc_id"]: r for r in (dict(zip(names, r)) for r in twin.fetchall())}


def test_similarity_plot_shows_every_other_article(spark, tmp_path):
    # Twenty texts, of which some share no word with a request: none is left out, one row each.
    docs = [(i, f"title{i}\nred w{i % 4} green w{i % 7}" if i % 3 else f"alone{i}") for i in range(20)]
    con = _own_tables(spark, tmp_path, docs, [(0, "red green w1"), (1, "nothing shared")])
    got = entry.queries()["similarity_plot"](spark, str(tmp_path))
    rows = sorted((r.query_id, r.similarity, r.credibility, r.source, r.type) for r in got.collect())
    assert len(rows) == 2 + 2 * 20 and sum(r[1] == 0 for r in rows) == 7 + 20
    twin = con.execute(f"SELECT query_id, similarity, credibility, source, type FROM ({entry.oracle_sql()['similarity_plot']})")
    assert rows == sorted(twin.fetchall())


@pytest.mark.parametrize("held,cell", [("requests", 1024), ("corpus", 1024), (None, 8)])
@pytest.mark.parametrize("domain", [None, "d"])
def test_all_pairs_are_those_of_a_limit_beyond_all(spark, monkeypatch, held, cell, domain):
    from pressgauge.operators import inverted as I

    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(25)], rng.integers(0, 9))), f"s{i % 7}.com") for i in range(40)]
    few, many = (spark.createDataFrame(r, "id long, t string, d string") for r in (rows[::5], rows))
    q, c = (many, few) if held == "corpus" else (few, many)
    settings, how = TF.TfidfSettings(None, (1, 2), 1, 1.0, strip_accents=False), []
    pairs = lambda df: {(r.query_id, r.cand_id, round(r.similarity, 7)) for r in df.collect()}
    want = pairs(TF.tfidf_cosine(q, c, "id", "t", 99, settings, domain=domain))
    monkeypatch.setattr(I, "held_matches", lambda p, r, k, h, *a, f=I.held_matches: how.append(h) or f(p, r, k, h, *a))
    monkeypatch.setattr(I, "CELL", cell)
    if held is None:
        monkeypatch.setattr(I, "HELD", 0)
    got = TF.tfidf_cosine(q, c, "id", "t", None, settings, domain=domain)
    assert "rank" not in got.columns and got.count() == len(want) and pairs(got) == want
    assert how == ([] if held is None else [held])
    shared = TF.tfidf_cosine(q, c, "id", "t", None, settings, domain=domain, keep_unrelated=False)
    assert pairs(shared) == {p for p in want if p[2] > 0}


def test_weights_are_those_of_the_smaller_sides_terms(spark, monkeypatch):
    # Many requests against few stored texts: a request's other terms add to its norm and are not written.
    held = []
    monkeypatch.setattr(TF, "cut_lineage", lambda df, cut=TF.cut_lineage: held.append(cut(df)) or held[-1])
    frame = lambda rows: spark.createDataFrame(rows, "id long, t string")
    many, few = [(i, f"shared only{i} other{i} other{i}") for i in range(30)], [(7, "shared alone")]
    got = TF.tfidf_cosine(frame(many), frame(few), "id", "t", 2, TF.TfidfSettings(None, (1, 1), 1, 1.0, sublinear=False)).collect()
    idf = lambda df: math.log(32 / (1 + df)) + 1
    unit = lambda *w: idf(31) / math.hypot(idf(31), *w)
    want = round(unit(idf(1), 2 * idf(1)) * unit(idf(1)), 9)
    assert sorted((r.query_id, r.cand_id, r.similarity) for r in got) == [(i, 7, want) for i in range(30)]
    assert held[0].count() == 30 + 2


def test_fits_share_the_executors_only_as_far_as_their_rows_fit(spark, monkeypatch):
    from pressgauge.functions import lexicons as L

    rows = [(i, i % 2, f"word{i % 5} other w{i}", *(float((i * k) % 7) for k in range(28))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, label int, text_full string, " + ", ".join(f"{n} double" for n in L.FEATURE_NAMES))

    class Seen(Exception):
        pass

    def stop(jobs, threads=5):
        raise Seen(threads)
    monkeypatch.setattr(M, "in_parallel", stop)

    def at_once():
        out = []
        for run in (lambda: M.cross_validate(df, X.experiment_svc, num_features=64), lambda: X.compare_models(df, num_features=64),
                    lambda: X.ablation(df, num_features=64)):
            with pytest.raises(Seen) as seen:
                run()
            out.append(seen.value.args[0])
        return out

    assert M.storage_bytes(spark) > 1 << 28 and at_once() == [5, 5, 5]
    monkeypatch.setattr(M, "storage_bytes", lambda spark: 0)
    assert at_once() == [1, 1, 1]
