"""Whole-article analysis as one plan over a set of articles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from pressgauge.functions import lexicons as L, text as X
from pressgauge.operators import credibility as C, crosscheck as K, linguistic as G, scoring as S
from pressgauge.operators import sensationalism as Z, sentiment as M, similarity as V, statistics as ST
from pressgauge.operators.tfidf import CROSSCHECK, TfidfSettings
from pressgauge.session import cut_lineage


@dataclass
class AnalysisSettings:
    """Word and domain lists, and which side of the cross-check is held by the tasks.

    ``hold="corpus"`` suits many articles against a bounded set of stored
    news; ``hold="requests"`` suits a batch of requests against a large store.
    """

    words: G.WordLists = field(default_factory=G.WordLists)
    sources: C.SourceLists = field(default_factory=C.SourceLists)
    credible_words: list[str] = field(default_factory=lambda: L.CREDIBLE_WORDS)
    suspicious_words: list[str] = field(default_factory=lambda: L.SUSPICIOUS_WORDS)
    tfidf: TfidfSettings = CROSSCHECK
    k: int = 20
    hold: str = "requests"
    #: A trained pipeline and the feature statistics of a reference corpus; without them the heuristic scores all.
    model: PipelineModel | None = None
    statistics: DataFrame | None = None
    #: Lists of the tone, and the valence lexicon of the sentence flow (none: no flow).
    positive: list[str] = field(default_factory=lambda: list(L.TONE_POSITIVE))
    negative: list[str] = field(default_factory=lambda: list(L.TONE_NEGATIVE))
    lexicon: DataFrame | None = None


def analyze_articles(articles: DataFrame, corpus: DataFrame, settings: AnalysisSettings | None = None,
                     whois: DataFrame | None = None, analyzed_at: Column | None = None,
                     checked: DataFrame | None = None) -> DataFrame:
    """One analysis row per article of ``id, url, title, content, source``.

    Language, credibility, word counts and the sensationalism heuristic are
    expressions on the article row. Only the cross-check looks at other
    articles; it yields one row per article, joined back on the unique id.
    """
    st = settings or AnalysisSettings()
    scored = G.language_scores(articles)
    scored = C.credibility(scored, st.sources, whois)
    scored = Z.sensationalism_chain(scored, st.statistics, st.model, lists=st.words, words=tuple(st.suspicious_words))
    scored = ST.with_word_frequency(scored, "content", st.credible_words, st.suspicious_words)
    if checked is None:
        checked = K.crosscheck(articles, corpus, tuple(st.sources.reliable), st.k, st.tfidf, st.hold)
    slim = scored.select(
        "id", "url", "title", "source", "domain", "known_source", "language_score", "credibility", "sensationalism",
        "sensationalism_method", C.enhanced_info(scored).alias("enhanced_info"),
        "capitalization", "punctuation", "complexity", "grammar", *C.METRICS, "total_words", "unique_words",
        "credible_words", "suspicious_words", X.whitespace_words(F.col("content")).alias("word_count"))
    joined = slim.join(checked.withColumnRenamed("query_id", "id").withColumnRenamed("status", "cross_check_status"), "id")
    out = S.score_columns(joined)
    label = lambda c, v: F.struct(F.lit(c).alias("label"), F.round(v, 1).alias("value"))
    return out.select(
        "id", S.article_key(F.col("url")).alias("article_key"), "url", "title", "source", "domain",
        (analyzed_at if analyzed_at is not None else F.current_timestamp()).alias("analyzed_at"),
        "language_score", "credibility_score", "cross_check_score", "sensationalism", "sensationalism_method", "overall_score", "verdict",
        "sensationalism_level", "band", "known_source", "cross_check_status", "word_count", "total_words",
        "unique_words", "credible_words", "suspicious_words",
        F.array(*[label(n.capitalize(), F.col(n) * 100)
                  for n in ("capitalization", "punctuation", "complexity", "grammar")]).alias("language_chart"),
        F.array(*[label(n, F.col(n)) for n in C.METRICS]).alias("credibility_chart"),
        F.struct("similar_count", "total_compared", "max_similarity", "avg_similarity", "credible_sources_count",
                 "source_diversity").alias("cross_check"),
        K.corroboration_description(F.col("cross_check_score")).alias("cross_check_description"), "enhanced_info")


def stored_analysis(articles: DataFrame, store: DataFrame, settings: AnalysisSettings | None = None,
                    whois: DataFrame | None = None, analyzed_at: Column | None = None, related: int = 8, points: int = 50,
                    map_points: int = 30) -> DataFrame:
    """The whole row that is stored for an article: its analysis, and the charts and lists that go with it.

    ``store`` has ``id, url, source_url, title, content, source, article_type, credibility_score, overall_score`` and may have
    ``embedding``. The cross-check runs against it by embedding, then by text. Added to ``analyze_articles``: ``tone``,
    ``sentiment_flow``, ``cross_check_points``, ``similarity_map`` (the article itself first, with its new score) and
    ``related_articles``. Lists have at most as many entries as is displayed, or one per sentence, so no group is
    unbounded; the article's row meets them on its id.
    """
    st = settings or AnalysisSettings()
    reliable = tuple(st.sources.reliable)
    checked, pairs = K.crosscheck_stored(articles, store, reliable, st.k, st.tfidf)
    row = cut_lineage(analyze_articles(articles, store, st, whois, analyzed_at, checked))
    listed = lambda df, key, order, *fields: df.groupBy(F.col(key).alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(*order, *fields))))
    named = pairs.withColumn("title", F.col("cand_title"))
    shown = K.crosscheck_points(named.drop("similarity"), named, points)
    chart4 = listed(shown, "query_id", [(-F.col("x")).alias("order"), "cand_id"], "x", "y", "similarity_pct", "title", "domain",
                    "is_reliable", "has_similarity_data").toDF("id", "cross_check_points")
    asked = articles.select("id", "content", "title", "source").join(row.select("id", "credibility_score", "overall_score"), "id")
    near = V.jaccard_map(asked, store, "id", "content", map_points)
    chart5 = listed(near, "query_id", ["point"], "x", "y", "title", "source", "overall_score", "is_current").toDF("id", "similarity_map")
    cards = K.related_articles(articles, store, reliable, related, st.tfidf)
    chart6 = listed(cards, "query_id", ["rank"], "cand_id", "title", "source", "url", "snippet", "relevance",
                    "source_credibility").toDF("id", "related_articles")
    tone = G.tone_keywords(articles.select("id", "content"), "content", st.positive, st.negative).select(
        "id", F.struct("positive", "negative", "neutral").alias("tone"))
    out = row.join(tone, "id")
    parts = [chart4, chart5, chart6]
    if st.lexicon is not None:
        flow = M.sentiment_flow(articles.select("id", "content"), "id", "content", st.lexicon)
        parts.append(listed(flow, "id", ["sentence_number"], "sentence", "compound", "pos", "neg", "neu").toDF("id", "sentiment_flow"))
    for part in parts:
        out = out.join(part, "id", "left")
    return out
