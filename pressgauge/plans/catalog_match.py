"""Queries over similarity, corroboration and related articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgauge.functions import ladders as B, text as X, urls as U
from pressgauge.operators import approximate as A, crosscheck as K, ranking as R, similarity as V, tfidf as TF
from pressgauge.plans.catalog_corpus import STOPS
from pressgauge.plans.registry import (ARTICLES_SQL, REQUESTS_SQL, STORE_SQL, Tables, W, clean_url_sql, domain_sql,
                                       query, sql_in, tok)
from pressgauge.plans.catalog_store import reliable_sql

RELIABLE = ["src1.com", "src4.com", "src12.com", "fr.src2.com", "ththth.example.net"]
SITE_RELIABLE = ["site2.com", "site5.com", "site7.com"]

# --- Embeddings ------------------------------------------------------------------------


def centroids(t: Tables):
    """One query vector per label: the mean of all its vectors, dimension by dimension."""
    width = len(t.embeddings.select("embedding").first()[0])
    e = F.col("embedding").cast("array<double>")
    means = t.embeddings.groupBy("label").agg(*[F.avg(F.get(e, F.lit(i))).alias(f"d{i}") for i in range(width)])
    return means.select(F.col("label").cast("long").alias("id"), F.array(*[f"d{i}" for i in range(width)]).alias("vec"))


def vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def top_sql(k: int) -> str:
    return f"""
el AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
cen AS (SELECT label AS query_id, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS m FROM el GROUP BY label, i) GROUP BY label),
sims AS (SELECT query_id::BIGINT AS query_id, vec_id AS cand_id, e.label,
  round(list_dot_product(q, embedding::DOUBLE[]) / ((sqrt(list_dot_product(q, q)) + 1e-8) *
    (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8)), 9) AS similarity FROM cen, embeddings e),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, cand_id) AS rank FROM sims QUALIFY rank <= {k})"""


def top_pairs(t: Tables, k: int = 20):
    """Best stored vectors per centroid with a URL, domain and reliability from their label."""
    top = V.top_similar(centroids(t), vectors(t), k)
    url = F.concat(F.lit("https://www.site"), F.col("label").cast("string"), F.lit(".com/"), F.col("id").cast("string"))
    cands = vectors(t).select(F.col("id").alias("cand_id"), url.alias("cand_url"), F.col("label").alias("cand_label"))
    return top.join(cands, "cand_id").withColumn("domain", U.domain_of(F.col("cand_url"))).withColumn(
        "is_reliable", U.is_reliable(F.col("domain"), SITE_RELIABLE))


PAIRS_SQL = top_sql(20) + f""",
pairs AS (SELECT *, 'site' || label || '.com' AS domain, ('site' || label || '.com') IN {sql_in(SITE_RELIABLE)} AS is_reliable,
  'https://www.site' || label || '.com/' || cand_id AS cand_url FROM top)"""


@query("cosine_similarity", "I1", """
SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
  ((sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) + 1e-8) *
   (sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-8)), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(t: Tables):
    a, b = t.embeddings, t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.cosine_similarity(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("top_similar", "I2 C4 E6 F2", f"""
WITH {top_sql(10)} SELECT query_id, cand_id, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM top""")
def _(t: Tables):
    return V.top_similar(centroids(t), vectors(t), 10).select("query_id", "cand_id", F.round("similarity", 6).alias("similarity"),
                                                               "rank")


@query("top_similar_by_request", "I2 E6 F2", """
WITH el AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
cen AS (SELECT label AS cand_id, list(m ORDER BY i) AS q FROM el GROUP BY label),
s AS (SELECT vec_id AS query_id, cand_id::BIGINT AS cand_id, round(list_dot_product(q, embedding::DOUBLE[]) / ((sqrt(list_dot_product(q, q)) + 1e-8) *
    (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8)), 9) AS similarity FROM cen, embeddings)
SELECT query_id, cand_id, round(similarity, 6) AS similarity,
  (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, cand_id))::INTEGER AS rank FROM s QUALIFY rank <= 3""")
def _(t: Tables):
    # Many queries against a bounded candidate set: the candidates are the held side.
    return V.top_similar(vectors(t), centroids(t), 3, hold="corpus").select(
        "query_id", "cand_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("top_similar_approximate", "I2", """
SELECT count(*) AS requests, true AS recall_reached, true AS scores_exact FROM embeddings WHERE vec_id % 100 = 0""")
def _(t: Tables):
    # Every hundredth vector against all: the approximate matches beside the exact ones.
    asked = vectors(t).where(F.col("id") % 100 == 0)
    exact = V.top_similar(asked, vectors(t), 10).select("query_id", "cand_id", "similarity")
    found = A.top_similar_approximate(asked, vectors(t), 10).select("query_id", "cand_id", F.col("similarity").alias("found"))
    both = exact.join(found, ["query_id", "cand_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("requests"), (F.count("found") >= 0.9 * F.count("similarity")).alias("recall_reached"),
                    (F.count_if(F.abs(F.col("found") - F.col("similarity")) > 1e-6) == 0).alias("scores_exact"))


@query("top_k_per_group", "E6 F4", """
SELECT source, doc_id, n_chars, (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id))::INTEGER AS rank
FROM documents QUALIFY rank <= 8""")
def _(t: Tables):
    return R.top_k(t.documents.select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.asc("doc_id")], 8)


@query("similarity_aggregate", "D11", f"""
WITH {PAIRS_SQL}, f AS (SELECT query_id, avg(similarity) AS m FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC) <= 5) GROUP BY query_id)
SELECT query_id, round(max(similarity), 6) AS max_similarity, round(avg(similarity), 6) AS mean_similarity,
  round(sum(similarity * CASE WHEN is_reliable THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) / sum(CASE WHEN is_reliable THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END), 6) AS weighted_mean,
  round(any_value(m), 6) AS top5_mean FROM pairs JOIN f USING (query_id) GROUP BY query_id""")
def _(t: Tables):
    out = V.similarity_aggregate(top_pairs(t))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "query_id"])


METRICS_SQL = """m AS (SELECT query_id, count(*) AS total_compared, max(similarity) AS mx, avg(similarity) AS av,
  count(*) FILTER (similarity > 0.6) AS similar_count, count(*) FILTER (is_reliable AND similarity > 0.6) AS credible_similar_count,
  count(*) FILTER (is_reliable) AS credible_sources_count,
  coalesce(max(similarity) FILTER (is_reliable), 0.0::DOUBLE) AS cmx, coalesce(avg(similarity) FILTER (is_reliable), 0.0::DOUBLE) AS cav,
  coalesce(sum(similarity) FILTER (is_reliable), 0.0::DOUBLE) AS cs, sum(similarity) AS s,
  count(DISTINCT domain) FILTER (domain <> '') AS source_diversity FROM pairs GROUP BY query_id),
co AS (SELECT *, least(0.3::DOUBLE, source_diversity * 0.05::DOUBLE) AS boost, CASE WHEN credible_sources_count > 0
    THEN 0.7::DOUBLE + 0.3::DOUBLE * CASE WHEN s > 0 THEN cs / s ELSE 0.0::DOUBLE END ELSE 0.5::DOUBLE END AS wt FROM m),
sc AS (SELECT *, least(1.0::DOUBLE, mx * wt * (1 + boost)) AS score FROM co)"""
_STATUS = ("CASE WHEN score >= 0.7 THEN 'Strong Corroboration' WHEN score >= 0.5 THEN 'Moderate Corroboration' "
           "WHEN score >= 0.3 THEN 'Weak Corroboration' ELSE 'No Corroboration' END")


@query("corroboration_metrics", "D12", f"""
WITH {PAIRS_SQL}, {METRICS_SQL} SELECT query_id, total_compared, round(mx, 6) AS max_similarity, round(av, 6) AS avg_similarity, similar_count,
  credible_similar_count, credible_sources_count, round(cmx, 6) AS credible_max_similarity, round(cav, 6) AS credible_avg_similarity, source_diversity FROM m""")
def _(t: Tables):
    out = K.corroboration_metrics(top_pairs(t))
    return out.select("query_id", "total_compared", "similar_count", "credible_similar_count", "credible_sources_count",
                      "source_diversity", *[F.round(c, 6).alias(c) for c in (
                          "max_similarity", "avg_similarity", "credible_max_similarity", "credible_avg_similarity")])


@query("corroboration", "J8", f"""
WITH {PAIRS_SQL}, {METRICS_SQL} SELECT query_id, round(wt, 5) AS credibility_weight, round(boost, 5) AS diversity_boost,
  round(score, 5) AS score, {_STATUS} AS status FROM sc""")
def _(t: Tables):
    out = K.corroboration(K.corroboration_metrics(top_pairs(t)))
    return out.select("query_id", "status", *[F.round(c, 5).alias(c) for c in (
        "credibility_weight", "diversity_boost", "score")])


@query("crosscheck_embeddings", "J9 C6", f"""
WITH {PAIRS_SQL.replace("pairs AS (", "all_pairs AS (")}, own AS (SELECT *, 'https://www.site' || query_id || '.com/' AS query_url FROM all_pairs),
perfect AS (SELECT query_id, max(similarity) AS own_sim FROM own WHERE similarity > 0.95 AND
  (contains(cand_url, rtrim(query_url, '/')) OR contains(rtrim(query_url, '/'), cand_url)) GROUP BY query_id),
pairs AS (SELECT * FROM own WHERE cand_url <> rtrim(query_url, '/')), {METRICS_SQL}
SELECT sc.query_id, round(CASE WHEN own_sim IS NOT NULL THEN 1.0::DOUBLE ELSE score END, 5) AS cross_check_score,
  CASE WHEN own_sim IS NOT NULL THEN 'Perfect Match' ELSE {_STATUS} END AS status FROM sc LEFT JOIN perfect USING (query_id)""")
def _(t: Tables):
    requests = centroids(t).select("id", F.concat(F.lit("https://www.site"), F.col("id").cast("string"), F.lit(".com/")).alias("url"))
    out = K.crosscheck_score(requests, top_pairs(t))
    return out.select("query_id", F.round("cross_check_score", 5).alias("cross_check_score"), "status")


@query("crosscheck_points", "J10 C5 F4", f"""
WITH {PAIRS_SQL}, c AS (SELECT *, CASE WHEN rank % 2 = 0 THEN similarity END AS known FROM pairs)
SELECT query_id, cand_id, round(coalesce(known, 0), 3) AS x, CASE WHEN is_reliable THEN 0.85::DOUBLE ELSE 0.50::DOUBLE END AS y,
  domain, is_reliable, known IS NOT NULL AS has_similarity_data FROM c
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(known, 0), 3) DESC, cand_id) <= 15""")
def _(t: Tables):
    pairs = top_pairs(t).withColumn("title", F.col("cand_url"))
    known = pairs.filter(F.col("rank") % 2 == 0)
    out = K.crosscheck_points(pairs.drop("similarity", "rank"), known, 15)
    return out.select("query_id", "cand_id", "x", "y", "domain", "is_reliable", "has_similarity_data")


_SELF = "rtrim(lower(trim({})), '/')"


@query("self_match", "C6", f"""
WITH v AS (SELECT page_id, url AS q, unnest([upper(url), {clean_url_sql('url')} || '/more', 'https://elsewhere.example.com/x']) AS c FROM pages)
SELECT page_id, c AS cand_url, {_SELF.format('q')} = {_SELF.format('c')} OR contains({_SELF.format('c')}, {_SELF.format('q')})
  OR contains({_SELF.format('q')}, {_SELF.format('c')}) AS is_self FROM v""")
def _(t: Tables):
    u = F.col("url")
    cands = F.array(F.upper(u), F.concat(U.clean_url(u), F.lit("/more")), F.lit("https://elsewhere.example.com/x"))
    rows = t.pages.select("page_id", "url", F.explode(cands).alias("cand_url"))
    return rows.select("page_id", "cand_url", K.self_match(F.col("url"), F.col("cand_url")).alias("is_self"))


@query("exclude_same_site", "C10", f"""
WITH p AS (SELECT page_id, {domain_sql('url')} AS a FROM pages), n AS (SELECT page_id - 1 AS page_id, a AS b FROM p)
SELECT page_id, a, b FROM p JOIN n USING (page_id)
WHERE NOT (a = b OR contains(a, b) OR contains(b, a) OR split_part(a, '.', 1) = split_part(b, '.', 1))""")
def _(t: Tables):
    p = t.pages.select("page_id", U.domain_of(F.col("url")).alias("a"))
    n = p.select((F.col("page_id") - 1).alias("page_id"), F.col("a").alias("b"))
    return p.join(n, "page_id").filter(~U.same_site(F.col("a"), F.col("b")))


# --- Words ---------------------------------------------------------------------------------

@query("word_jaccard", "G3", f"""
WITH w AS (SELECT doc_id, list_distinct({tok('text')}) AS a FROM documents), n AS (SELECT doc_id - 1 AS doc_id, a AS b FROM w)
SELECT doc_id, CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 9)
  ELSE 0 END AS jaccard FROM w JOIN n USING (doc_id)""")
def _(t: Tables):
    w = t.texts.select("doc_id", F.array_distinct(X.word_tokens(F.col("text"))).alias("a"))
    n = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return w.join(n, "doc_id").select("doc_id", F.round(X.word_jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


@query("jaccard_map", "I3 G3 F4", f"""
WITH {STORE_SQL}, {REQUESTS_SQL},
q AS (SELECT id AS query_id, list_distinct({tok('content')}) AS a FROM requests),
c AS (SELECT id AS cand_id, list_distinct({tok('content')}) AS b, source, credibility_score, overall_score FROM store WHERE length(content) > 0),
j AS (SELECT query_id, cand_id, source, credibility_score, overall_score,
  round(len(list_intersect(a, b)) / greatest(1, len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 9) AS x FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, cand_id) AS rank FROM j QUALIFY rank <= 29)
SELECT query_id, (rank + 1)::INTEGER AS point, x, credibility_score AS y, source, overall_score, false AS is_current FROM r
UNION ALL SELECT id, 1, 1.0::DOUBLE, 0.5::DOUBLE, source, 0.5::DOUBLE, true FROM requests""")
def _(t: Tables):
    q = t.requests.withColumns({"credibility_score": F.lit(None).cast("double"), "overall_score": F.lit(None).cast("double")})
    return V.jaccard_map(q, t.store, "id", "content").drop("title")


@query("title_overlap", "I9", f"""
WITH {ARTICLES_SQL}, w AS (SELECT id, list_distinct({tok('title')}) AS a, list_distinct({tok('content')}) AS q FROM articles)
SELECT id, CASE WHEN len(q) > 0 THEN round(least(0.9::DOUBLE, greatest(0.3::DOUBLE, len(list_intersect(a, q)) / len(q)::DOUBLE * 0.8)), 6) ELSE 0.5 END AS relevance FROM w""")
def _(t: Tables):
    words = X.word_tokens(F.col("content"))
    return t.articles.select("id", F.round(B.title_overlap(X.word_tokens(F.col("title")), words), 6).alias("relevance"))


@query("relevance_scale", "I7 I8", """
WITH s AS (SELECT doc_id, text, (n_chars % 251) / 1000.0::DOUBLE AS s, n_chars % 9 AS r, split_part(text, chr(10), 1) AS h FROM documents),
v AS (SELECT *, CASE WHEN s > 0.1 THEN 0.7::DOUBLE + (s - 0.1::DOUBLE) * 2 WHEN s > 0.05 THEN 0.4::DOUBLE + (s - 0.05::DOUBLE) * 6 ELSE 0.1::DOUBLE + s * 6 END AS z FROM s)
SELECT doc_id, round(least(0.9::DOUBLE, greatest(0.1::DOUBLE, z)), 6) AS scaled,
  round(least(0.9::DOUBLE, greatest(0.2::DOUBLE, 0.8::DOUBLE - r * 0.1::DOUBLE + CASE (length(h) > 20)::INTEGER + (length(text) > 50)::INTEGER
    WHEN 2 THEN 0.1::DOUBLE WHEN 1 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)), 6) AS fallback FROM v""")
def _(t: Tables):
    s = F.col("n_chars") % 251 / 1000.0
    head = F.substring_index("text", "\n", 1)
    return t.documents.select("doc_id", F.round(B.relevance_scale(s), 6).alias("scaled"),
                              F.round(B.relevance_fallback(F.col("n_chars") % 9, head, F.col("text")), 6).alias("fallback"))


# --- tf-idf ---------------------------------------------------------------------------------

TRAINER = TF.TfidfSettings(stop_words=STOPS)
CROSS = TF.TfidfSettings(None, (1, 2), 1, 1.0, sublinear=False, strip_accents=False, stop_words=STOPS)
RELATED = TF.TfidfSettings(None, (1, 2), 1, 1.0, sublinear=False, strip_accents=False, stop_words=STOPS)


def terms_sql(settings: TF.TfidfSettings, rows: str) -> str:
    """CTEs terms(id, side, term) .. weights(id, side, term, weight) over ``rows`` = (id, side, body)."""
    body = "strip_accents(lower(body))" if settings.strip_accents else "lower(body)"
    tf = "1 + ln(tf)" if settings.sublinear else "tf::DOUBLE"
    limit = f" ORDER BY cf DESC, term LIMIT {settings.max_features}" if settings.max_features else ""
    return f"""
uni AS (SELECT id, side, list_filter(regexp_extract_all({body}, '{W}{{2,}}'), lambda w: w NOT IN {sql_in(settings.stop_words)}) AS u FROM {rows}),
grams AS (SELECT id, side, unnest(list_concat(u, list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1]))) AS term FROM uni),
tfs AS (SELECT id, side, term, count(*) AS tf FROM grams GROUP BY id, side, term),
docs_n AS (SELECT count(*) AS n FROM {rows}),
dfs AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tfs GROUP BY term),
vocab AS (SELECT term, df, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM dfs, docs_n
  WHERE df >= {settings.min_df} AND df <= {settings.max_df}::DOUBLE * n{limit}),
raw AS (SELECT id, side, term, ({tf}) * idf AS w FROM tfs JOIN vocab USING (term)),
weights AS (SELECT id, side, term, w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) AS weight FROM raw)"""


@query("tfidf_vocab", "I5", f"""
WITH rows_in AS (SELECT doc_id AS id, 0 AS side, text AS body FROM documents), {terms_sql(TRAINER, 'rows_in')}
SELECT id, term, round(weight, 6) AS weight FROM weights""")
def _(t: Tables):
    return TF.tfidf_vocab(t.texts, "doc_id", "text", TRAINER).select("id", "term", F.round("weight", 6).alias("weight"))


def cosine_sql(settings: TF.TfidfSettings, left: str, right: str, k: int | None, extra: str = "true") -> str:
    """CTE best(query_id, cand_id, similarity, rank), all pairs without a k; left and right are (id, body, domain)."""
    limit = "" if k is None else f" QUALIFY rank <= {k}"
    return f"""
rows_in AS (SELECT id, 0 AS side, body FROM {left} UNION ALL SELECT id, 1, body FROM {right}), {terms_sql(settings, 'rows_in')},
dots AS (SELECT a.id AS query_id, b.id AS cand_id, sum(a.weight * b.weight) AS s FROM weights a JOIN weights b ON a.term = b.term
  AND a.side = 0 AND b.side = 1 GROUP BY 1, 2),
every AS (SELECT q.id AS query_id, c.id AS cand_id, round(coalesce(s, 0), 9) AS similarity FROM {left} q JOIN {right} c ON {extra}
  LEFT JOIN dots ON dots.query_id = q.id AND dots.cand_id = c.id),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, cand_id) AS rank FROM every{limit})"""


@query("tfidf_cosine", "I6", f"""
WITH {ARTICLES_SQL}, {REQUESTS_SQL}, l AS (SELECT id, content AS body FROM requests), r AS (SELECT id, content AS body FROM articles),
{cosine_sql(CROSS, 'l', 'r', 10)} SELECT query_id, cand_id, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM best""")
def _(t: Tables):
    return TF.tfidf_cosine(t.requests, t.articles, "id", "content", 10, CROSS).select(
        "query_id", "cand_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("tfidf_cosine_per_request", "I6", f"""
WITH {ARTICLES_SQL}, {REQUESTS_SQL}, l AS (SELECT id, content AS body FROM requests), r AS (SELECT id, content AS body FROM articles),
{cosine_sql(CROSS, 'l', 'r', 50)}, pairs AS (SELECT query_id, cand_id FROM best WHERE similarity > 0),
own_n AS (SELECT query_id, count(*) + 1 AS n FROM pairs GROUP BY query_id),
own_docs AS (SELECT query_id, cand_id, term, tf FROM pairs JOIN tfs ON side = 1 AND id = cand_id
  UNION ALL SELECT query_id, NULL, term, tf FROM own_n JOIN tfs ON side = 0 AND id = query_id),
own_idf AS (SELECT query_id, term, ln((1 + any_value(n))::DOUBLE / (1 + count(*))) + 1 AS idf FROM own_docs JOIN own_n USING (query_id) GROUP BY 1, 2),
own_w AS (SELECT query_id, cand_id, term, tf * idf AS w FROM own_docs JOIN own_idf USING (query_id, term)),
own_len AS (SELECT query_id, cand_id, sqrt(sum(w * w)) AS length FROM own_w GROUP BY 1, 2),
own_dot AS (SELECT a.query_id, b.cand_id, sum(a.w * b.w) AS s FROM own_w a JOIN own_w b ON a.query_id = b.query_id AND a.term = b.term
  AND a.cand_id IS NULL AND b.cand_id IS NOT NULL GROUP BY 1, 2),
own_best AS (SELECT d.query_id, d.cand_id, round(s / (q.length * c.length), 9) AS similarity FROM own_dot d
  JOIN own_len q ON q.query_id = d.query_id AND q.cand_id IS NULL JOIN own_len c ON c.query_id = d.query_id AND c.cand_id = d.cand_id)
SELECT query_id, cand_id, round(similarity, 6) AS similarity, (row_number() OVER w)::INTEGER AS rank FROM own_best
WINDOW w AS (PARTITION BY query_id ORDER BY own_best.similarity DESC, cand_id) QUALIFY row_number() OVER w <= 10""")
def _(t: Tables):
    out = TF.tfidf_cosine(t.requests, t.articles, "id", "content", 10, CROSS, idf_scope="query", pool=50)
    return out.select("query_id", "cand_id", F.round("similarity", 6).alias("similarity"), "rank")


CROSSCHECK_SQL = f"""
pairs AS (SELECT b.*, {domain_sql('a.url')} AS domain, a.url AS cand_url, {reliable_sql(domain_sql('a.url'), RELIABLE)} AS is_reliable
  FROM best b JOIN articles a ON a.id = b.cand_id WHERE b.similarity > 0), {METRICS_SQL}"""


@query("crosscheck", "J9 J8 D12", f"""
WITH {ARTICLES_SQL}, {REQUESTS_SQL}, l AS (SELECT id, content AS body FROM requests), r AS (SELECT id, content AS body FROM articles),
{cosine_sql(CROSS, 'l', 'r', 20)}, {CROSSCHECK_SQL}
SELECT query_id, round(score, 5) AS cross_check_score, {_STATUS} AS status, similar_count, total_compared, round(mx, 5) AS max_similarity,
  credible_sources_count, source_diversity FROM sc""")
def _(t: Tables):
    out = K.crosscheck(t.requests, t.articles, RELIABLE, 20, CROSS)
    return out.select("query_id", F.round("cross_check_score", 5).alias("cross_check_score"), "status", "similar_count",
                      "total_compared", F.round("max_similarity", 5).alias("max_similarity"), "credible_sources_count",
                      "source_diversity")


@query("related_articles", "I10 C10 B14 B16", f"""
WITH {ARTICLES_SQL}, {REQUESTS_SQL}, l AS (SELECT id, content AS body, {domain_sql('url')} AS domain FROM requests),
r AS (SELECT id, title || ' ' || content AS body, {domain_sql('url')} AS domain FROM articles WHERE {reliable_sql(domain_sql('url'), RELIABLE)}),
{cosine_sql(RELATED, 'l', 'r', 8, "NOT (q.domain = c.domain OR contains(q.domain, c.domain) OR contains(c.domain, q.domain) OR split_part(q.domain, '.', 1) = split_part(c.domain, '.', 1))")}
SELECT query_id, rank::INTEGER AS rank, cand_id, r.domain AS source, round(least(0.9::DOUBLE, greatest(0.1::DOUBLE, CASE WHEN similarity > 0.1 THEN 0.7::DOUBLE + (similarity - 0.1::DOUBLE) * 2
  WHEN similarity > 0.05 THEN 0.4::DOUBLE + (similarity - 0.05::DOUBLE) * 6 ELSE 0.1::DOUBLE + similarity * 6 END)), 2) AS relevance
FROM best JOIN r ON r.id = cand_id""")
def _(t: Tables):
    out = K.related_articles(t.requests, t.articles, RELIABLE, 8, RELATED)
    return out.select("query_id", "rank", "cand_id", "source", "relevance")


@query("similarity_plot", "I11 B25", f"""
WITH {STORE_SQL}, {REQUESTS_SQL}, l AS (SELECT id, content AS body FROM requests), r AS (SELECT id, content AS body FROM store),
{cosine_sql(CROSS, 'l', 'r', None)}
SELECT query_id, round(similarity, 6) AS similarity, credibility_score AS credibility, source,
  CASE WHEN credibility_score >= 0.7 THEN 'real' WHEN credibility_score >= 0.4 THEN 'mixed' ELSE 'fake' END AS type
FROM best JOIN store ON store.id = cand_id
UNION ALL SELECT id, 1.0::DOUBLE, 0.5::DOUBLE, source, 'user' FROM requests""")
def _(t: Tables):
    q = t.requests.withColumn("credibility_score", F.lit(0.5))
    out = K.similarity_plot(q, t.store, settings=CROSS)
    return out.select("query_id", F.round("similarity", 6).alias("similarity"), "credibility", "source", "type")
