"""Sentiment, credibility, sensationalism and corroboration against hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from pressgauge.functions import lexicons as L
from pressgauge.operators import credibility as C, crosscheck as K, scoring as S, sensationalism as Z, sentiment as M

LEX = [("good", 1.9), ("bad", -2.5), ("great", 3.1), ("no", -1.2)]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEX, "word string, valence double")


def compound(s):
    return round(s / math.sqrt(s * s + 15), 4)


@pytest.mark.parametrize("text, total", [
    ("it is good", 1.9),
    ("it is very good", 1.9 + 0.293),
    ("very it good", 1.9 + 0.293 * 0.95),
    ("it is GOOD", 1.9 + 0.733),
    ("not good", 1.9 * -0.74),
    ("slightly bad", -2.5 + 0.293),
    ("good!!", 1.9 + 0.584),
    ("good but bad", 1.9 * 0.5 - 2.5 * 1.5),
    ("never so good", (1.9 + 0.293) * 1.25),
    ("no good", 1.9 * -0.74),
    ("nothing here", 0.0),
    ("", 0.0),
])
def test_sentiment(spark, lexicon, text, total):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    assert M.sentiment_scores(df, "id", "t", lexicon).first().compound == pytest.approx(compound(total), abs=1e-4)


def test_sentiment_neighbours_in_the_lexicon(spark, monkeypatch):
    """A booster that is itself a lexicon word does not boost, at any of the three places; masks of any width agree."""
    lex = spark.createDataFrame([*LEX, ("very", 0.5), ("least", 0.1)], "word string, valence double")
    rows = [(0, "very good"), (1, "very it good"), (2, "very it is good"), (3, "least good"), (4, "no good"), (5, "no very"),
            (6, None), (7, "x")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: r.compound for r in M.sentiment_scores(df, "id", "t", lex).collect()}
    # "very" is silent as a booster word, and no booster as a lexicon word.
    totals = [1.9, 1.9, 1.9, 0.1 + 1.9, 1.9 * -0.74, 0.0, 0.0, 0.0]
    assert got == {i: pytest.approx(compound(t), abs=1e-4) for i, t in enumerate(totals)}
    from pressgauge.operators import lexicon as X

    monkeypatch.setattr(X, "MASK_BITS", 64)
    assert {r.id: r.compound for r in M.sentiment_scores(df, "id", "t", lex).collect()} == got


def test_sentiment_plan_takes_any_lexicon(spark):
    lex = spark.range(200_000).selectExpr("concat('w', id) AS word", "0.5 AS valence")
    df = spark.createDataFrame([(1, "w7 and w199999 or x")], "id int, t string")
    out = M.sentiment_scores(df, "id", "t", lex)
    assert out.first().compound == pytest.approx(compound(1.0), abs=1e-4)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_sentiment_shares(spark, lexicon):
    row = M.sentiment_scores(spark.createDataFrame([(1, "it is good")], "id int, t string"), "id", "t", lexicon).first()
    assert (row.pos, row.neg, row.neu) == (round(2.9 / 4.9, 3), 0.0, round(2 / 4.9, 3))


def test_sentiment_flow(spark, lexicon):
    df = spark.createDataFrame([(1, "It is good. It is bad! Fine")], "id int, t string")
    rows = sorted(M.sentiment_flow(df, "id", "t", lexicon).collect(), key=lambda r: r.sentence_number)
    assert [r.sentence for r in rows] == ["It is good.", "It is bad!", "Fine"]
    assert rows[0].compound > 0 > rows[1].compound and rows[2].compound == 0
    summary = M.sentence_summary(M.sentiment_flow(df, "id", "t", lexicon), "id").first()
    assert summary.total_sentences == 3


def test_whois(spark):
    raw = ('{"WhoisRecord":{"createdDate":"2010-06-01T00:00:00Z","registrarName":"GoDaddy.com, LLC",'
           '"nameServers":{"hostNames":["NS1.AWSDNS.com","b","c","d"]},"registrant":{"organization":"News Ltd"},'
           '"registryData":{"expiresDate":"2024-06-20","updatedDate":"2024-05-30","dnssec":"signedDelegation",'
           '"status":["clientTransferProhibited x"]}}}')
    df = spark.createDataFrame([("a.com", raw), ("b.com", '{"WhoisRecord":{}}'), ("c.com", "junk")], "domain string, raw string")
    out = C.parse_whois(df, "raw", F.lit("2024-06-01").cast("date")).withColumn("text", C.whois_description())
    a, b, c = sorted(out.collect(), key=lambda r: r.domain)
    assert a.age_years == 14.0 and a.registrar_trusted and not a.privacy_protected and a.registrant_org == "News Ltd"
    assert a.hosting_provider == "AWS Route 53" and a.dnssec_enabled and a.domain_locked and len(a.name_servers) == 4
    assert a.days_until_expiry == 19 and a.days_since_update == 2
    assert "expires in 19 days" in a.text and "DNSSEC, Transfer Lock" in a.text
    assert not b.verified and b.text is None and not c.verified


def test_credibility_known_sources(spark):
    rows = [("https://www.bbc.com/news/article/1", "Title", "word " * 400), ("https://infowars.com/x", "T", "short"),
            ("https://theonion.com/x", "T", "short"), ("https://my-very-long-domain-name-1234.tk/a", "T", "short")]
    df = spark.createDataFrame(rows, "url string, title string, content string")
    bbc, info, onion, odd = C.credibility(df).collect()
    assert (bbc.domain_age, bbc.url_structure, bbc.site_structure, bbc.content_format) == (90, 85, 85, 90)
    assert bbc.credibility == pytest.approx((90 * .25 + 85 * .2 + 85 * .3 + 90 * .25) / 100)
    assert (info.domain_age, info.url_structure, info.site_structure, info.content_format) == (20, 30, 25, 30)
    assert info.known_source == "Known Issue: Conspiracy theories" and onion.content_format == 60
    # 50 -30 tld -15 digits -10 long label -10 dashes -> bounded at 0 from below
    assert odd.url_structure == 0 and odd.site_structure == 50 and odd.content_format == 35


def test_heuristic(spark):
    df = spark.createDataFrame([("SHOCKING!", "You won't believe this amazing secret!"), ("", "plain words only here")],
                               "title string, content string")
    loud, calm = Z.sensationalism_heuristic(df).collect()
    assert loud.suspicious_keywords == 3 and loud.sensationalism == 1.0
    assert calm.sensationalism == pytest.approx(0.35)


def test_zscore_direction(spark):
    rows = [(float(i), *[0.0] * 27) for i in range(5)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in L.FEATURE_NAMES)).withColumn("id", F.col("clickbait_score"))
    out = Z.sensationalism_zscore(df, Z.feature_statistics(df)).orderBy("id").collect()
    assert [r.sensationalism for r in out] == sorted(r.sensationalism for r in out)
    assert out[2].sensationalism == pytest.approx(0.5)
    assert out[4].top_contributors[0].feature == "clickbait_score"
    z = -(4 - 2) / math.sqrt(2) * 0.15
    assert out[4].combined_z == pytest.approx(z / sum(L.ZSCORE_WEIGHTS.values()))


def test_model_absent(spark):
    row = Z.predict_batch(spark.createDataFrame([("a",)], "t string")).first()
    assert row.sensationalism == 0.5 and not row.analysis_available and row.interpretation.level == "Moderate"


def test_corroboration_formula(spark):
    pairs = spark.createDataFrame([(1, 0.8, True, "a.com"), (1, 0.4, False, "b.com"), (1, 0.2, False, ""),
                                   (2, 0.5, False, "a.com")],
                                  "query_id long, similarity double, is_reliable boolean, domain string")
    one, two = K.corroboration(K.corroboration_metrics(pairs)).orderBy("query_id").collect()
    weight = 0.7 + 0.3 * 0.8 / 1.4
    assert one.score == pytest.approx(min(1, 0.8 * weight * 1.1)) and one.source_diversity == 2
    assert two.score == pytest.approx(0.5 * 0.5 * 1.05) and two.status == "No Corroboration"


def test_crosscheck_special_cases(spark):
    requests = spark.createDataFrame([(1, "https://a.com/x"), (2, "https://b.com/y"), (3, "https://c.com/z")], "id long, url string")
    pairs = spark.createDataFrame([(1, 9, 0.99, True, "a.com", "https://A.com/x/")],
                                  "query_id long, cand_id long, similarity double, is_reliable boolean, domain string, cand_url string")
    compared = spark.createDataFrame([(3, 4)], "query_id long, found long")
    out = {r.query_id: r for r in K.crosscheck_score(requests, pairs, compared).collect()}
    assert out[1].cross_check_score == 1.0 and out[1].status == "Perfect Match"
    assert out[1].credible_sources_count == 1 and out[3].total_compared == 4
    assert out[2].cross_check_score == 0.30 and out[3].cross_check_score == 0.40


def test_overall(spark):
    cols = [F.lit(v) for v in (0.8, 0.6, 0.4, 0.2)]
    row = spark.range(1).select(S.overall_score(*cols).alias("a"), S.overall_score(*cols, invert=False).alias("b")).first()
    assert row.a == pytest.approx(0.65) and row.b == pytest.approx(0.5)


def test_approximate_search_reaches_its_recall(spark):
    """Clustered vectors, with a third of the rows equal: recall of at least 0.9, exact scores, ties by id."""
    import numpy as np

    from pressgauge.operators import approximate as A, similarity as V

    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 16))
    rows = [(i, [float(x) for x in centres[i % 30] + 0.3 * rng.standard_normal(16)]) for i in range(600)]
    rows += [(i, rows[0][1]) for i in range(600, 900)] + [(900, None), (901, [])]
    stored = spark.createDataFrame(rows, "id long, vec array<double>")
    asked = stored.where("id % 20 = 0")
    exact = {(r.query_id, r.cand_id): r.similarity for r in V.top_similar(asked, stored, 10).collect()}
    got = A.top_similar_approximate(asked, stored, 10).collect()
    found = {(r.query_id, r.cand_id): r.similarity for r in got}
    assert len(found.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(abs(found[p] - exact[p]) < 1e-8 for p in found.keys() & exact.keys())
    first = sorted((r.rank, r.cand_id) for r in got if r.query_id == 0)
    assert first == [(i + 1, c) for i, c in enumerate([0, *range(600, 609)])]
    assert A.top_similar_approximate(asked.limit(0), stored, 10).count() == 0
    assert A.top_similar_approximate(asked, stored.limit(0), 10).count() == 0


def test_bits_follow_the_angles():
    import numpy as np

    from pressgauge.operators import approximate as A

    close, far = A.most_bits(np.full(10, 0.99), 0.9), A.most_bits(np.full(10, 0.3), 0.9)
    assert close > far > 0 and A.most_bits(np.full(10, -1.0), 0.9) == 0
    assert A.hit_rate(np.array([0.3]), A.TABLES, far) >= 0.9 > A.hit_rate(np.array([0.3]), A.TABLES, far + 1)


def test_approximate_candidates_are_no_rows(spark):
    """Far neighbours leave few bits and half of all pairs as candidates: the plan has no join of pairs, and no list of keys."""
    import numpy as np

    from pressgauge.operators import approximate as A

    rng = np.random.default_rng(2)
    stored = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(32)]) for i in range(400)], "id long, vec array<double>")
    found = A.top_similar_approximate(stored.where("id % 10 = 0"), stored, 10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert found.where("rank = 1 AND query_id = cand_id").count() == 40


def test_leaders_are_those_of_a_whole_sort():
    """Batches with ties, copies, NaN and infinity: the k best by rounded score and id, as a sort of everything gives them."""
    import numpy as np

    from pressgauge.operators import similarity as V

    rng = np.random.default_rng(3)
    table = np.round(rng.standard_normal((7, 500)), 1) + rng.uniform(-4e-10, 4e-10, (7, 500))
    table[0, ::3], table[1, 5], table[2, :], table[3, 4:] = np.nan, np.inf, -np.inf, np.nan
    ids = rng.permutation(500).astype(np.int64)
    best = V.Leaders(7, 10, 9)
    for begin in (0, 3, 100, 108, 300):
        end = {0: 3, 3: 100, 100: 108, 108: 300, 300: 500}[begin]
        best.add(table[:, begin:end].copy(), ids[begin:end])
    got = best.rows(np.arange(7) * 10)
    for q in range(7):
        usable = np.flatnonzero(np.isfinite(table[q]))
        want = sorted((-np.round(table[q, i], 9), ids[i]) for i in usable)[:10]
        mine = got[got.query_id == q * 10]
        assert [(-s, i) for s, i in zip(mine.similarity, mine.cand_id)] == want
