"""Corroboration of an article by stored articles, and related articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pressgauge.functions import ladders, lexicons as L, urls as U
from pressgauge.operators.cleaning import candidate_filter
from pressgauge.operators.ranking import top_k
from pressgauge.operators.similarity import settled, top_similar
from pressgauge.operators.tfidf import CROSSCHECK, RELATED, TfidfSettings, tfidf_cosine
from pressgauge.session import cut_lineage, small_side


def corroboration_metrics(pairs: DataFrame, group: str = "query_id", extra: Sequence[Column] = ()) -> DataFrame:
    """Similarity, credible-source and domain figures per query.

    ``pairs`` has ``similarity, is_reliable, domain``; rows without a
    similarity do not count. ``extra`` aggregates ride along in the same pass.
    """
    s, ok = F.col("similarity"), F.col("is_reliable") & F.col("similarity").isNotNull()
    named = s.isNotNull() & (F.col("domain") != "")
    return pairs.groupBy(group).agg(
        F.count(s).alias("total_compared"),
        F.max(s).alias("max_similarity"), F.avg(s).alias("avg_similarity"),
        F.count_if(s > 0.6).alias("similar_count"), F.count_if(ok & (s > 0.6)).alias("credible_similar_count"),
        F.count_if(ok).alias("credible_sources_count"),
        F.coalesce(F.max(F.when(ok, s)), F.lit(0.0)).alias("credible_max_similarity"),
        F.coalesce(F.avg(F.when(ok, s)), F.lit(0.0)).alias("credible_avg_similarity"),
        F.coalesce(F.sum(F.when(ok, s)), F.lit(0.0)).alias("_credible_sum"), F.sum(s).alias("_sum"),
        F.count_distinct(F.when(named, F.col("domain"))).alias("source_diversity"), *extra)


def corroboration(metrics: DataFrame) -> DataFrame:
    """Score formula on ``corroboration_metrics``: base × credibility weight × (1 + diversity boost)."""
    boost = F.least(F.lit(0.3), F.col("source_diversity") * 0.05)
    share = F.when(F.col("_sum") > 0, F.col("_credible_sum") / F.col("_sum")).otherwise(F.lit(0.0))
    weight = F.when(F.col("credible_sources_count") > 0, 0.7 + 0.3 * share).otherwise(F.lit(0.5))
    out = metrics.withColumns({"diversity_boost": boost, "credibility_weight": weight})
    formula = F.col("max_similarity") * F.col("credibility_weight") * (1 + F.col("diversity_boost"))
    # ``least`` skips nulls: a query without compared candidates has no score.
    score = F.when(formula.isNotNull(), F.least(F.lit(1.0), formula))
    return out.withColumn("score", score).withColumn("status", ladders.corroboration_status(F.col("score"))).drop(
        "_sum", "_credible_sum")


def corroboration_description(score: Column) -> Column:
    """Wording of the corroboration status."""
    pct = F.format_string("%.1f", score * 100)
    sources = F.col("source_diversity").cast("string")
    return (
        F.when(score >= 0.7, F.concat(F.lit("Strong similarity ("), pct, F.lit("%) found from "), sources,
                                      F.lit(" sources, including "), F.col("credible_sources_count").cast("string"),
                                      F.lit(" credible sources.")))
        .when(score >= 0.5, F.concat(F.lit("Moderate similarity ("), pct, F.lit("%) found from "), sources,
                                     F.lit(" sources.")))
        .when(score >= 0.3, F.concat(F.lit("Limited similarity ("), pct,
                                     F.lit("%) found. Limited corroboration available.")))
        .otherwise(F.lit("No significant similarity found. Cannot verify story through cross-checking.")))


def self_match(query_url: Column, cand_url: Column) -> Column:
    """The same page: equal or contained either way when normalised. An empty URL is no page and never the same."""
    q, c = U.normalized_url(query_url), U.normalized_url(cand_url)
    return (q != "") & (c != "") & ((q == c) | c.contains(q) | q.contains(c))


def describe_candidates(pairs: DataFrame, corpus: DataFrame, reliable: Sequence[str], key: str = "id",
                        url: str = "url", hold: str = "requests") -> DataFrame:
    """Attach title, URL, domain and reliability of the candidates; corpus text is not read.

    ``hold`` tells which side is bounded: the candidates themselves, or the
    pairs, which are k rows per request.
    """
    cands = corpus.select(F.col(key).cast("long").alias("cand_id"), F.col(url).alias("cand_url"),
                          F.col("title").alias("cand_title"), U.domain_of(F.col(url)).alias("domain"))
    if hold == "corpus":
        joined = pairs.join(small_side(cands), "cand_id")
    else:
        joined = cands.join(settled(pairs), "cand_id")
    return joined.withColumn("is_reliable", U.is_reliable(F.col("domain"), reliable))


def crosscheck_score(requests: DataFrame, pairs: DataFrame, compared: DataFrame | None = None,
                     key: str = "id", url: str = "url") -> DataFrame:
    """Cross-check score per request from its described candidate pairs.

    A self-match above 0.95 scores 1 and counts as one source, credible if the
    matched candidate is reliable; otherwise the formula over the other
    candidates. A request with nothing found scores 0.30, one whose found
    candidates (``compared``: request ids, and their number ``found`` where
    that column is there) could not be compared 0.40.
    """
    wanted = requests.select(F.col(key).cast("long").alias("query_id"), F.col(url).alias("query_url"))
    # The wanted requests and their k candidates meet once; all figures come from that one aggregate.
    both = pairs.join(wanted, "query_id")
    q, c = U.normalized_url(F.col("query_url")), U.normalized_url(F.col("cand_url"))
    same = F.coalesce((q == c) & (q != ""), F.lit(False))
    perfect = F.when(self_match(F.col("query_url"), F.col("cand_url")) & (F.col("similarity") > 0.95), F.col("similarity"))
    flagged = both.select("query_id", "is_reliable", "domain", perfect.alias("_self"),
                          F.when(~same, F.col("similarity")).alias("similarity"))
    own_source = F.max(F.when(F.col("_self").isNotNull(), F.struct("_self", F.col("is_reliable").cast("int").alias("r"))))
    scored = corroboration(corroboration_metrics(flagged, extra=[F.max("_self").alias("self_similarity"),
                                                                 own_source.getField("r").alias("_own_reliable")]))
    scored = scored.withColumn("status", F.when(F.col("score").isNotNull(), F.col("status")))
    out = wanted.join(scored, "query_id", "left")
    number = F.lit(0)
    if compared is not None:
        seen = F.col("found") if "found" in compared.columns else F.lit(1)
        out = out.join(compared.select(F.col("query_id"), seen.cast("long").alias("_found")), "query_id", "left")
        number = F.coalesce("_found", F.lit(0))
    found = number > 0
    is_self = F.col("self_similarity").isNotNull()
    score = (F.when(is_self, F.lit(1.0)).when(F.col("score").isNotNull(), F.col("score"))
             .when(found, F.lit(0.40)).otherwise(F.lit(0.30)))
    status = (F.when(is_self, F.lit("Perfect Match")).when(F.col("status").isNotNull(), F.col("status"))
              .when(found, F.lit("Comparison Failed")).otherwise(F.lit("No Corroboration Found")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "query_id", score.alias("cross_check_score"), status.alias("status"),
        F.when(is_self, 1).otherwise(zero("similar_count")).alias("similar_count"),
        F.when(is_self, 1).when(F.col("score").isNull() & found, number).otherwise(zero("total_compared")).alias("total_compared"),
        F.when(is_self, F.col("self_similarity")).otherwise(F.coalesce("max_similarity", F.lit(0.0))).alias("max_similarity"),
        F.when(is_self, F.col("self_similarity")).otherwise(F.coalesce("avg_similarity", F.lit(0.0))).alias("avg_similarity"),
        F.when(is_self, zero("_own_reliable")).otherwise(zero("credible_sources_count")).alias("credible_sources_count"),
        F.when(is_self, 1).otherwise(zero("source_diversity")).alias("source_diversity"))


def crosscheck(requests: DataFrame, corpus: DataFrame, reliable: Sequence[str] = tuple(L.RELIABLE_SOURCES),
               k: int = 20, settings: TfidfSettings = CROSSCHECK, hold: str = "requests",
               key: str = "id", text: str = "content") -> DataFrame:
    """Text path of the cross-check: joint tf-idf, k best candidates that share a term, score formula."""
    pairs = tfidf_cosine(requests, corpus, key, text, k, settings, keep_unrelated=False).where("similarity > 0")
    return crosscheck_score(requests, describe_candidates(pairs, corpus, reliable, key, hold=hold), key=key)


def crosscheck_stored(requests: DataFrame, store: DataFrame, reliable: Sequence[str] = tuple(L.RELIABLE_SOURCES),
                      k: int = 20, settings: TfidfSettings = CROSSCHECK, exclude_url: str = "", min_len: int = 100,
                      key: str = "id", text: str = "content") -> tuple[DataFrame, DataFrame]:
    """The cross-check against a store: scores, and the described pairs that they come from.

    Stored articles pass the candidate filter first (``article_type, source_url, content``). Requests and candidates that
    both have an ``embedding`` are compared by it; requests left without a pair are compared by text. Every request knows
    how many candidates there were, so one that could be compared with none of them scores 0.40, and one without any
    candidate 0.30.
    """
    candidates = candidate_filter(store, exclude_url, min_len)
    has = lambda df: "embedding" in df.columns
    pairs = None
    if has(requests) and has(store):
        vectors = lambda df: df.select(F.col(key).alias("id"), F.col("embedding").alias("vec"))
        pairs = cut_lineage(top_similar(vectors(requests), vectors(candidates), k).where("similarity > 0"))
        rest = requests.join(pairs.select(F.col("query_id").alias(key)).distinct(), key, "left_anti")
    else:
        rest = requests
    by_text = tfidf_cosine(rest, candidates, key, text, k, settings, keep_unrelated=False).where("similarity > 0")
    both = by_text if pairs is None else pairs.select(*by_text.columns).unionByName(by_text)
    described = cut_lineage(describe_candidates(both, candidates.withColumn("url", F.col("source_url")), reliable, key))
    found = candidates.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    compared = requests.select(F.col(key).cast("long").alias("query_id"), F.lit(found).alias("found"))
    return crosscheck_score(requests, described, compared, key), described


def crosscheck_points(candidates: DataFrame, similarities: DataFrame, shown: int | None = 50, title: int | None = 60) -> DataFrame:
    """Chart points of a query's candidates: similarity where known, else 0; ``shown`` points and ``title`` characters
    each (all: None).

    ``candidates``: ``query_id, cand_id, title, domain, is_reliable``;
    ``similarities``: ``query_id, cand_id, similarity``.
    """
    joined = candidates.join(similarities.select("query_id", "cand_id", "similarity"), ["query_id", "cand_id"], "left")
    points = joined.select(
        "query_id", "cand_id", F.round(F.coalesce("similarity", F.lit(0.0)), 3).alias("x"),
        F.when(F.col("is_reliable"), 0.85).otherwise(0.50).alias("y"),
        F.round(F.coalesce(F.col("similarity") * 100, F.lit(0.0)), 1).alias("similarity_pct"),
        (F.substring("title", 1, title) if title else F.col("title")).alias("title"), "domain", "is_reliable",
        F.col("similarity").isNotNull().alias("has_similarity_data"))
    return top_k(points, "query_id", [F.desc("x"), F.asc("cand_id")], shown).drop("rank") if shown else points


def related_articles(queries: DataFrame, corpus: DataFrame, reliable: Sequence[str] = tuple(L.RELIABLE_SOURCES),
                     k: int = 8, settings: TfidfSettings = RELATED, key: str = "id",
                     title: int | None = 150, snippet: int | None = 250) -> DataFrame:
    """Cards of the k most relevant corpus articles from reliable domains other than the query's.

    Both sides have ``key, url, title, content``; title and whole content are compared. ``title`` and
    ``snippet`` are the characters shown of title and content (all: None).
    """
    cards = corpus.withColumn("domain", U.domain_of(F.col("url"))).filter(
        (F.col("domain") != "") & F.col("url").startswith("http") & U.is_reliable(F.col("domain"), reliable))
    cards = cards.withColumn("_card", F.concat(F.col("title"), F.lit(" "), F.col("content")))
    asked = queries.withColumn("domain", U.domain_of(F.col("url"))).withColumn("_card", F.col("content"))
    pairs = tfidf_cosine(asked, cards, key, "_card", k, settings, domain="domain")
    cut = lambda c, n: (F.substring(c, 1, n) if n else F.col(c)).alias(c)
    shown = cards.select(F.col(key).cast("long").alias("cand_id"), cut("title", title),
                         F.col("domain").alias("source"), "url", cut("content", snippet).alias("snippet"))
    return shown.join(settled(pairs), "cand_id").select(
        "query_id", "rank", "cand_id", "title", "source", "url", "snippet",
        F.round(ladders.relevance_scale(F.col("similarity")), 2).alias("relevance"),
        U.source_tier(F.col("source")).alias("source_credibility"))


def similarity_plot(article: DataFrame, others: DataFrame, k: int | None = None, key: str = "id", text: str = "content",
                    own_point: float = 1.0, settings: TfidfSettings = CROSSCHECK) -> DataFrame:
    """Plot rows: the articles themselves at ``own_point``, and every other article (with ``k`` the most similar only) with
    its similarity and credibility band."""
    pairs = tfidf_cosine(article, others, key, text, k, settings)
    shown = others.select(F.col(key).cast("long").alias("cand_id"), "title", "source", "credibility_score")
    # All pairs are many: they meet the others where they were scored and are not written.
    rows = shown.join(settled(pairs) if k else pairs, "cand_id").select(
        "query_id", "similarity", F.col("credibility_score").alias("credibility"), "title", "source",
        ladders.credibility_band(F.col("credibility_score")).alias("type"))
    own = article.select(F.col(key).cast("long").alias("query_id"), F.lit(own_point).alias("similarity"),
                         F.col("credibility_score").alias("credibility"), "title", "source", F.lit("user").alias("type"))
    return own.unionByName(rows)
