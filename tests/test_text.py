"""Text, URL and ladder functions on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from pressgauge.functions import ladders as B, lexicons as L, text as X, urls as U
from pressgauge.operators import linguistic as G, statistics as ST


def value(spark, make, *texts):
    """Apply a column function to one row of string columns."""
    row = spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts))))
    return row.select(make(*[F.col(f"c{i}") for i in range(len(texts))]).alias("v")).first().v


@pytest.mark.parametrize("text, expected", [
    ("", ""), (None, ""), ("  a\t\tb ", "a b"), ("see https://x.org/a?b now", "see   now"),
    ("www.site.org rest", "rest"), ("mail me@x.org!", "mail"), ("a <b>bold</b> x", "a  bold  x"),
    ("won't 50% $5 é ß", "won t 50   5 é ß"), ("wow!? ok.", "wow!? ok."), ("a @b c", "a  b c"), ("a b", "a b"),
])
def test_normalize_text(spark, text, expected):
    assert value(spark, X.normalize_text, text) == expected


def test_word_functions(spark):
    assert value(spark, X.words, " Ab  c\nd ") == ["Ab", "c", "d"]
    assert value(spark, X.whitespace_words, " Ab  c\nd ") == 3
    assert value(spark, X.single_space_words, "a  b ") == 4
    assert value(spark, X.word_tokens, "Über café's 3x") == ["über", "café", "s", "3x"]
    assert value(spark, lambda c: X.content_tokens(c, ["the"]), "The cat is here") == ["cat", "here"]
    assert value(spark, lambda c: X.repetition_ratio(X.word_tokens(c)), "a b a c b a") == pytest.approx(2 / 3)
    assert value(spark, lambda c: X.repetition_ratio(X.word_tokens(c)), "") == 0.0
    assert value(spark, lambda c: X.unique_ratio(X.word_tokens(c)), "a b a c") == 0.75
    assert value(spark, lambda a, b: X.word_jaccard(X.word_tokens(a), X.word_tokens(b)), "a b c", "b c d") == 0.5


def test_counts(spark):
    count = lambda text, entries: value(spark, lambda c: X.count_words(c, entries), text)
    assert count("Very, very good; everything", ["very"]) == 2
    assert count("stunning", ["stunning", "stunning"]) == 2
    assert count("éthe the", ["the"]) == 1
    assert count("of the of the", ["of the"]) == 2
    assert value(spark, lambda c: X.count_char(c, "!"), "a!!b!") == 3
    assert value(spark, lambda c: X.count_char(c, "  "), "a   b    c") == 3


@pytest.mark.parametrize("text", [
    "This will blow your mind blown jaw dropping", "you won't believe it, won't believe, can't believe",
    "breaking news: breaking! must see must see", "urgent urgent warning the truth about mind blown",
    "biggest ever never before first time just in", ""])
def test_alternations_equal_patterns(spark, text):
    slow = value(spark, lambda c: X.count_patterns(F.lower(c), [X.whole(g) for g in L.CLICKBAIT]), text)
    fast = value(spark, lambda c: X.count_alternations(X.word_tokens(c), F.lower(c), L.CLICKBAIT), text)
    assert slow == fast


def test_listed_equals_words(spark):
    text = "According to research, research shows data; as a result, as a result because"
    for entries in (L.EVIDENCE, L.PROFESSIONAL, L.EMOTIONAL):
        slow = value(spark, lambda c: X.count_words(c, entries), text)
        assert slow == value(spark, lambda c: X.count_listed(X.word_tokens(c), F.lower(c), entries), text)


def test_html_and_cutting(spark):
    assert value(spark, X.clean_html, "<p>A &amp; B&nbsp;&#233;&#x1F600;</p>\n x") == "A & Bé😀 x".replace("B", "B ")
    assert value(spark, lambda c: X.truncate_at_word(c, 7), "hello big world") == "hello..."
    assert value(spark, lambda c: X.truncate_at_word(c, 4), "abcdefgh") == "abcd..."
    assert value(spark, lambda c: X.truncate_at_word(c, 40), "short") == "short"
    assert value(spark, X.strip_unprintable, "a\x00b 😀 é–x") == "a b é–x"


@pytest.mark.parametrize("text, day", [
    ("2024-05-14T10:11:12Z", "2024-05-14"), ("2024-05-14", "2024-05-14"), ("14/05/2024", "2024-05-14"),
    ("05/14/2024", "2024-05-14"), ("Tue, 14 May 2024 08:00:00 GMT", "2024-05-14"), ("soon", "2000-01-01")])
def test_parse_published(spark, text, day):
    assert str(value(spark, lambda c: X.parse_published(c, F.to_date(F.lit("2000-01-01"))), text)) == day


def test_looks_binary(spark):
    assert value(spark, X.looks_binary, "plain text") is False
    assert value(spark, X.looks_binary, "\x00" * 101 + "a" * 5000) is True
    assert value(spark, X.looks_binary, "\x00\x01\x02\x03ab") is True


def test_urls(spark):
    assert value(spark, U.clean_url, "https://a.b/c/?x=1#t") == "https://a.b/c"
    assert value(spark, U.clean_url, "https://a.b?x") == "https://a.b"
    assert value(spark, U.domain_of, "HTTPS://WWW.x.org:80/a".replace("WWW", "www")) == "x.org:80"
    assert value(spark, U.domain_of, "x.org/a") == "x.org"
    assert value(spark, U.domain_raw, "http://www.x.org?q=1") == "www.x.org?q=1"
    assert value(spark, U.base_domain, "edition.cnn.com") == "cnn.com"
    assert value(spark, U.base_domain, "localhost") == "localhost"
    for base, href, full in [("https://a.b/x/y", "z", "https://a.b/x/z"), ("https://a.b", "/q", "https://a.b/q"),
                             ("https://a.b/x", "//c.d/e", "https://c.d/e"), ("https://a.b/x", "?k=1", "https://a.b/x?k=1"),
                             ("https://a.b/x", "http://c/d", "http://c/d")]:
        assert value(spark, U.absolute_url, base, href) == full


@pytest.mark.parametrize("domain, expected", [
    ("uk.reuters.com", True), ("edition.cnn.com", True), ("m.theguardian.com", True), ("reuters.co.uk", True),
    ("", False), ("blog.example.net", False), ("notcnn.org", False)])
def test_is_reliable(spark, domain, expected):
    assert value(spark, lambda c: U.is_reliable(c, L.RELIABLE_SOURCES), domain) is expected


def test_legacy_reliability_accepts_empty(spark):
    assert value(spark, lambda c: U.is_reliable(c, L.RELIABLE_SOURCES, legacy=True), "") is True


@pytest.mark.parametrize("url, strict, quick, link", [
    ("https://a.b/", False, False, False), ("https://a.b/2024/05/story-of-the-day", True, True, True),
    ("https://a.b/tag/x", False, False, False), ("https://a.b/news/world", True, True, True),
    ("https://a.b/some-long-article-slug-here", True, False, True)])
def test_article_url_rules(spark, url, strict, quick, link):
    assert value(spark, U.is_article_url_strict, url) is strict
    assert value(spark, U.is_article_url_quick, url) is quick
    assert value(spark, U.is_article_link, url) is link


def test_ladders(spark):
    row = spark.range(1).select(
        B.verdict(F.lit(0.695)).alias("a"), B.verdict(F.lit(0.4)).alias("b"), B.credibility_band(F.lit(0.39)).alias("c"),
        B.relevance_scale(F.lit(0.2)).alias("d"), B.relevance_scale(F.lit(0.0)).alias("e"),
        B.metric_status("site_structure", F.lit(70)).alias("f")).first()
    assert (row.a, row.b, row.c, row.f) == ("HIGH CREDIBILITY", "MEDIUM CREDIBILITY", "fake", "Good")
    assert row.d == pytest.approx(0.9) and row.e == pytest.approx(0.1)


def test_features_by_hand(spark):
    text = "SHOCKING news! According to officials, the study is very very bad. Really? 2024"
    row = G.linguistic_features(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert row.word_count == 13 and row.exclamation_count == 1 and row.question_count == 1
    assert row.all_caps_words == 1 and row.clickbait_matches == 1 and row.emotional_word_count == 1
    assert row.clickbait_score == pytest.approx(1 / 13)
    # officials, study, according to
    assert row.professional_word_count == 3
    # 2024 as a year, "study" as evidence word
    assert row.data_references == 2
    assert row.avg_sentence_length == pytest.approx(13 / 4)
    assert row.sentiment_polarity == 0.0
    empty = G.linguistic_features(spark.createDataFrame([(None,)], "t string"), "t").first()
    assert all(empty[n] == 0.0 for n in L.FEATURE_NAMES)


def test_feature_order(spark):
    df = G.linguistic_features(spark.createDataFrame([("a",)], "t string"), "t")
    assert df.columns == ["t", *L.FEATURE_NAMES] and len(L.FEATURE_NAMES) == 28
    assert sum(L.FEATURE_GROUP_SIZES.values()) == 28


def test_raw_features_see_percent_and_money(spark):
    df = spark.createDataFrame([("50% of $5 and you won't believe",)], "t string")
    assert G.linguistic_features(df, "t").first().data_references == 0
    raw = G.linguistic_features(df, "t", raw=True).first()
    assert raw.data_references == 2 and raw.clickbait_matches == 1


def test_language_scores(spark):
    df = spark.createDataFrame([("Title", "First one. second two! Third  three ."), ("x", "")], "title string, content string")
    a, b = G.language_scores(df).collect()
    # Pieces: "Title First one", " second two", " Third  three ", "" -> 2 of 4 capitalised.
    assert a.capitalization == pytest.approx(0.5)
    assert a.grammar == pytest.approx(0.0)
    assert b.capitalization == 0.5


def test_word_frequency_maps(spark):
    df = spark.createDataFrame([(1, "Data data shocking and one weird trick, one weird trick")], "id int, t string")
    row = ST.word_frequency(df, "id", "t", L.CREDIBLE_WORDS, L.SUSPICIOUS_WORDS).first()
    assert row.credible_words == {"data": 2} and row.suspicious_words == {"shocking": 1}
    assert row.total_words == 10 and row.unique_words == 6 and row.listed_phrases == 2


ODD = ["", " ", "a@b c@ @d @e@f g@@h x @", "İstanbul DİNÇ. ﬁn ß ǅ ⅷ Ⅷ A1 B-C ÀÉ", "x y z\x1cq\x85r\t\n w  v", "12.5 1.2.3 2024 $5 5% 1..2",
       "of the of the, of\nthe often the of theme", "áb \U0001d400\U0001f600 ퟿_9", "must see must read cover-up covered-up", "AB!CD?E.f " * 3]


def test_split_tokens_equal_matched_ones(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string").withColumn("n", X.normalize_text(F.col("t")))
    cased = F.filter(X.words(F.col("t")), lambda w: w.rlike(r"\p{Lu}") & ~w.rlike(r"[\p{Ll}\p{Lt}]"))
    lists = [["of", "the", "must see", "a"], ["the", "cover-up", "often"]]
    few = X.listed_tokens(X.word_tokens(F.col("t")), *lists)
    mails = rf"(?<!{X.NOT_SPACE}){X.NOT_SPACE}+@{X.NOT_SPACE}+"
    pairs = {
        "words": (X.words(F.col("t")), F.regexp_extract_all("t", F.lit(f"({X.NOT_SPACE}+)"))),
        "blanks": (X.blank_words(F.col("n")), F.regexp_extract_all("n", F.lit(f"({X.NOT_SPACE}+)"))),
        "tokens": (X.word_tokens(F.col("t")), F.regexp_extract_all(F.lower("t"), F.lit(f"({X.WORD}+)"))),
        "upper": (F.filter(X.words(F.col("t")), X.is_upper), cased),
        "listed": (F.array(*[X.count_listed(few, F.lower("t"), x) for x in lists]),
                   F.array(*[X.count_words(F.col("t"), x) for x in lists])),
        "refs": (X.count_data_references(F.col("t")), X.count_patterns(F.col("t"), L.DATA_REFERENCE_PATTERNS)),
        "clean": (F.col("n"), X.strip(F.regexp_replace(F.regexp_replace(X.collapse(F.col("t")), mails, " "),
                                                       r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\p{Z}.!?]", " "))),
    }
    for row in df.select("t", *[F.struct(a.alias("a"), b.alias("b")).alias(k) for k, (a, b) in pairs.items()]).collect():
        for name in pairs:
            assert row[name].a == row[name].b, (name, row.t)
