"""Queries over credibility, sensationalism, sentiment and the composite score."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgauge.functions import lexicons as L, urls as U
from pressgauge.operators import credibility as C, linguistic as G, scoring as S, sensationalism as Z, sentiment as M
from pressgauge.plans import analysis as AN
from pressgauge.plans.catalog_corpus import LANGUAGE_SQL, WORDS_A, WORDS_B, features_sql, stand_in_lists
from pressgauge.plans.registry import (ARTICLES_SQL, REQUESTS_SQL, Tables, base_sql, char_count, contains_any_sql,
                                       domain_sql, path_sql, query, sql_count_phrases, sql_count_words, sql_in, tok,
                                       ws_count)
from pressgauge.plans.catalog_match import CROSS, METRICS_SQL, cosine_sql
from pressgauge.plans.catalog_store import reliable_sql
from pressgauge.session import cut_lineage

# Stand-in source lists over the fixture's own domains.
SOURCES = C.SourceLists(
    reliable=["src1.com", "src4.com", "fr.src2.com", "src12.com"],
    problem={"src7.com": "Health misinformation", "src9.com": "Satirical content", "de.src11.com": "Misleading headlines"},
    long_standing=["src4.com", "src15.com"], mid_age=["src12.com", "fr.src16.com"])


def source_lists_sql() -> str:
    names = sorted({*SOURCES.reliable, *SOURCES.problem, *SOURCES.long_standing, *SOURCES.mid_age})
    rows = ", ".join(
        f"('{d}', {d in SOURCES.reliable}, {repr(SOURCES.problem[d]) if d in SOURCES.problem else 'NULL'}, "
        f"{d in SOURCES.long_standing}, {d in SOURCES.mid_age})" for d in names)
    return f"lists(dom, reliable, issue, long_standing, mid_age) AS (VALUES {rows})"


_IF = lambda cond, points: f"CASE WHEN {cond} THEN {points} ELSE 0 END"

_URL_SCORE = (
    "50 + CASE WHEN domain LIKE '%.edu' THEN 30 WHEN domain LIKE '%.gov' THEN 30 WHEN domain LIKE '%.org' THEN 20 "
    "WHEN domain LIKE '%.com' THEN 10 WHEN regexp_matches(domain, '\\.(tk|ml|ga|cf)$') THEN -30 ELSE 0 END + "
    + " + ".join([
        _IF(contains_any_sql("domain", ["news", "report", "times"]), 5), _IF("regexp_matches(domain, '[0-9]{4,}')", -15),
        _IF("length(split_part(domain, '.', 1)) > 20", -10),
        _IF("length(domain) - length(replace(domain, '-', '')) > 3", -10),
        _IF(contains_any_sql(path_sql("url"), ["/article/", "/news/"]), 5),
        _IF(f"length({path_sql('url')}) - length(replace({path_sql('url')}, '/', '')) > 6", -5)]))
_SITE_SCORE = "50 + " + " + ".join([
    _IF(contains_any_sql("domain", ["news", "times", "post", "herald"]), 15), _IF("length(domain) < 15", 10),
    _IF("regexp_matches(domain, '\\.(edu|gov|org)$')", 20)])
_FORMAT_SCORE = "50 + " + " + ".join([
    _IF("regexp_matches(url, '/[0-9]{4}/[0-9]{2}/[0-9]{2}/')", 15),
    _IF("contains(url, '/article') OR contains(url, '/story')", 10), _IF("length(url) > 150", -10),
    _IF("len(regexp_extract_all(url, '\\p{Lu}')) > length(url) * 0.3", -15),
    f"CASE WHEN content <> '' THEN CASE WHEN {ws_count('content')} > 300 THEN 10 WHEN {ws_count('content')} < 100 THEN -15 ELSE 0 END"
    + " + " + _IF("contains(content, chr(10) || chr(10))", 5) + " ELSE 0 END",
    _IF("length(title) > 100", -10), _IF(f"{char_count('title', '!')} > 2", -10)])

CREDIBILITY_SQL = f"""{source_lists_sql()},
dom AS (SELECT *, {domain_sql('url')} AS domain, {base_sql(domain_sql('url'))} AS base_domain FROM articles),
listed AS (SELECT a.*, coalesce(d.reliable, false) AS dr, d.issue AS di, coalesce(d.long_standing, false) AS dl,
    coalesce(d.mid_age, false) AS dm, coalesce(b.reliable, false) AS br, b.issue AS bi
  FROM dom a LEFT JOIN lists d ON a.domain = d.dom LEFT JOIN lists b ON a.base_domain = b.dom),
cred AS (SELECT id, url, title, source, domain, base_domain, dr, dl, dm,
  CASE WHEN dl THEN 90.0::DOUBLE WHEN dm THEN 75.0::DOUBLE WHEN dr THEN 70.0::DOUBLE WHEN di IS NOT NULL THEN 20.0::DOUBLE ELSE 50.0::DOUBLE END AS domain_age,
  CASE WHEN br THEN 85.0::DOUBLE WHEN bi IS NOT NULL THEN 30.0::DOUBLE ELSE greatest(0, least(100, {_URL_SCORE}))::DOUBLE END AS url_structure,
  CASE WHEN br THEN 85.0::DOUBLE WHEN bi IS NOT NULL THEN 25.0::DOUBLE ELSE greatest(0, least(100, {_SITE_SCORE}))::DOUBLE END AS site_structure,
  CASE WHEN br THEN 90.0::DOUBLE WHEN contains(bi, 'Satirical') THEN 60.0::DOUBLE WHEN bi IS NOT NULL THEN 30.0::DOUBLE
    ELSE greatest(0, least(100, {_FORMAT_SCORE}))::DOUBLE END AS content_format,
  CASE WHEN di IS NOT NULL THEN 'Known Issue: ' || di WHEN dr THEN 'Verified Reliable Source' END AS known_source
  FROM listed),
scored AS (SELECT *, (domain_age * 0.25::DOUBLE + url_structure * 0.20::DOUBLE + site_structure * 0.30::DOUBLE
  + content_format * 0.25::DOUBLE) / 100 AS credibility FROM cred)"""


@query("credibility", "J1 J2 J3 J4 J5 B15 C2", f"""
WITH {ARTICLES_SQL}, {CREDIBILITY_SQL}
SELECT id, domain, domain_age, url_structure, site_structure, content_format, known_source, round(credibility, 6) AS credibility FROM scored""")
def _(t: Tables):
    return C.credibility(t.articles, SOURCES).select("id", "domain", *C.METRICS, "known_source",
                                                     F.round("credibility", 6).alias("credibility"))


@query("url_structure_of_pages", "J2 J3", f"""
WITH a AS (SELECT page_id AS id, url, {domain_sql('url')} AS domain, html AS content, '' AS title FROM pages)
SELECT id, greatest(0, least(100, {_URL_SCORE}))::DOUBLE AS url_structure,
  greatest(0, least(100, {_SITE_SCORE}))::DOUBLE AS site_structure,
  greatest(0, least(100, {_FORMAT_SCORE}))::DOUBLE AS content_format FROM a""")
def _(t: Tables):
    a = t.pages.select(F.col("page_id").alias("id"), "url", F.col("html").alias("content"), F.lit("").alias("title"))
    return C.credibility(a, SOURCES).select("id", "url_structure", "site_structure", "content_format")


@query("credibility_chart", "J18 DM11", f"""
WITH {ARTICLES_SQL}, {CREDIBILITY_SQL}
{' UNION ALL '.join(f"SELECT id, '{n}' AS label, round({c}, 1) AS value FROM scored" for c, n in (
    ('domain_age', 'Domain Age'), ('url_structure', 'URL Structure'), ('site_structure', 'Site Structure'), ('content_format', 'Content Format')))}""")
def _(t: Tables):
    return C.credibility_chart(C.credibility(t.articles, SOURCES), "id")


_DESC = {
    "url_structure": "CASE WHEN v >= 85 THEN 'Professional domain structure with trusted TLD' WHEN v >= 70 THEN 'Well-structured domain name with news indicators' WHEN v >= 50 THEN 'Standard domain structure without red flags' ELSE 'Domain structure shows suspicious patterns' END",
    "site_structure": "CASE WHEN dr THEN 'Established news organization with full transparency' WHEN v >= 70 THEN 'Professional news site structure' WHEN v >= 50 THEN 'Standard website structure for news content' ELSE 'Site structure lacks professional news indicators' END",
    "content_format": "CASE WHEN v >= 85 THEN 'Professional article formatting with proper structure' WHEN v >= 70 THEN 'Well-formatted content with news article indicators' WHEN v >= 50 THEN 'Standard content formatting' ELSE 'Content format shows quality concerns' END",
    "domain_age": "CASE WHEN dl THEN 'Long-standing reputable news organization (' || domain || ')' WHEN dm THEN 'Established news outlet with good track record' WHEN dr THEN 'Recognized news source in the industry' WHEN v >= 50 THEN 'Domain shows moderate maturity indicators' ELSE 'Limited history or unknown domain reputation' END"}


@query("credibility_details", "B26 B27", f"""
WITH {ARTICLES_SQL}, {CREDIBILITY_SQL}
{' UNION ALL '.join(f"SELECT id, '{k}' AS metric, v::INTEGER AS score, {d} AS description FROM (SELECT *, {k} AS v FROM scored)" for k, d in _DESC.items())}""")
def _(t: Tables):
    return C.credibility_details(C.credibility(t.articles, SOURCES), "id").select("id", "metric", "score", "description")


_SIMPLE = f"replace({domain_sql('url')}, 'www.', '')"


@query("credibility_simple", "J6", f"""
WITH {ARTICLES_SQL}, d AS (SELECT id, {_SIMPLE} AS domain, {ws_count('content')} AS n FROM articles)
SELECT id, CASE WHEN domain IN {sql_in(['src1.com', 'src4.com'])} THEN 0.85::DOUBLE ELSE 0.45::DOUBLE END AS credibility_simple,
  CASE WHEN n > 1000 THEN 0.80::DOUBLE WHEN n > 500 THEN 0.70::DOUBLE WHEN n > 200 THEN 0.60::DOUBLE ELSE 0.50::DOUBLE END AS content_quality FROM d""")
def _(t: Tables):
    return C.credibility_simple(t.articles, ("src1.com", "src4.com")).select("id", "credibility_simple", "content_quality")


def whois_rows(t: Tables):
    """WHOIS answers for every site of the pages, built from the pages' own columns."""
    site = t.pages.groupBy(U.domain_of(F.col("url")).alias("domain")).agg(F.min("page_id").alias("n"))
    day = lambda y, n: F.concat((F.lit(y) + F.col("n") % n).cast("string"), F.lit("-03-14"))
    raw = F.concat(
        F.lit('{"WhoisRecord":{"registrarName":"'), F.when(F.col("n") % 3 == 0, "Namecheap, Inc.").otherwise("Other Reg"),
        F.lit('","registrant":{"name":"'), F.when(F.col("n") % 4 == 0, "Domains By Proxy").otherwise("News Ltd"),
        F.lit('"},"nameServers":{"hostNames":["ns1.'), F.when(F.col("n") % 2 == 0, "cloudflare.com").otherwise("example.net"),
        F.lit('"]},"registryData":{"createdDate":"'), day(1998, 27), F.lit('T00:00:00Z","updatedDate":"'), day(2020, 4),
        F.lit('","expiresDate":"'), day(2025, 4), F.lit('","dnssec":"'),
        F.when(F.col("n") % 5 == 0, "signed").otherwise("unsigned"), F.lit('"}}}'))
    return site.select("domain", "n", raw.alias("raw"))


_SITES_SQL = f"sites AS (SELECT {domain_sql('url')} AS domain, min(page_id) AS n FROM pages GROUP BY 1)"


@query("parse_whois", "J7", f"""
WITH {_SITES_SQL}, d AS (SELECT *, ((1998 + n % 27) || '-03-14')::DATE AS created, ((2025 + n % 4) || '-03-14')::DATE AS expires,
  ((2020 + n % 4) || '-03-14')::DATE AS updated FROM sites)
SELECT domain, true AS verified, round((DATE '2024-06-01' - created) / 365.25::DOUBLE, 2) AS age_years,
  CASE WHEN n % 3 = 0 THEN 'Namecheap, Inc.' ELSE 'Other Reg' END AS registrar, n % 3 = 0 AS registrar_trusted,
  n % 4 = 0 AS privacy_protected, CASE WHEN n % 4 = 0 THEN '' ELSE 'News Ltd' END AS registrant_org,
  (expires - DATE '2024-06-01')::INTEGER AS days_until_expiry, (DATE '2024-06-01' - updated)::INTEGER AS days_since_update,
  CASE WHEN n % 2 = 0 THEN 'Cloudflare' ELSE 'Unknown' END AS hosting_provider, n % 5 = 0 AS dnssec_enabled FROM d""")
def _(t: Tables):
    out = C.parse_whois(whois_rows(t), "raw", F.lit("2024-06-01").cast("date"))
    return out.select("domain", "verified", "age_years", "registrar", "registrar_trusted", "privacy_protected",
                      "registrant_org", "days_until_expiry", "days_since_update", "hosting_provider", "dnssec_enabled")


@query("whois_description", "B27 J7", f"""
WITH {_SITES_SQL}, d AS (SELECT domain, n, 1998 + n % 27 AS y, 2025 + n % 4 AS until,
  round((DATE '2024-06-01' - ((1998 + n % 27) || '-03-14')::DATE) / 365.25::DOUBLE, 2) AS age FROM sites)
SELECT domain, concat_ws('. ', 'Domain registered in ' || y || ' (' || floor(age)::BIGINT || CASE
    WHEN age >= 20 THEN '+ years). Highly established online presence' WHEN age >= 10 THEN ' years). Well-established presence'
    WHEN age >= 5 THEN ' years). Established presence' WHEN age >= 2 THEN ' years). Moderate history' ELSE ' year(s)). Relatively new' END,
  CASE WHEN n % 3 = 0 THEN 'Registered with reputable registrar: Namecheap, Inc.' ELSE 'Registered with: Other Reg' END,
  CASE WHEN n % 4 = 0 THEN '⚠️ Domain uses privacy protection - owner identity hidden' ELSE 'Public registration: News Ltd' END,
  'Valid until ' || until, CASE WHEN n % 2 = 0 THEN 'Hosted on Cloudflare' END,
  CASE WHEN n % 5 = 0 THEN 'Security features: DNSSEC enabled' END) || '.' AS description FROM d""")
def _(t: Tables):
    out = C.parse_whois(whois_rows(t), "raw", F.lit("2024-06-01").cast("date"))
    return out.select("domain", C.whois_description().alias("description"))


@query("fresh_whois", "C9", f"""
WITH {_SITES_SQL}, c AS (SELECT domain, n AS hours FROM sites WHERE n % 48 < 24)
SELECT s.domain, c.domain IS NOT NULL AS is_fresh FROM sites s LEFT JOIN c USING (domain)""")
def _(t: Tables):
    sites = whois_rows(t).select("domain", "n")
    as_of = F.lit("2024-06-02 00:00:00").cast("timestamp")
    cache = sites.select("domain", (as_of - F.make_interval(hours=(F.col("n") % 48).cast("int"))).alias("cached_at"))
    return C.fresh_whois(sites.select("domain"), cache, as_of).select("domain", "is_fresh")


_AGE = "round((DATE '2024-06-01' - ((1998 + n % 27) || '-03-14')::DATE) / 365.25::DOUBLE, 2)"


@query("credibility_with_whois", "J1 J5 J7", f"""
WITH {_SITES_SQL}, p AS (SELECT page_id, {domain_sql('url')} AS domain FROM pages), a AS (SELECT domain, {_AGE} AS age FROM sites)
SELECT page_id, domain, age AS age_years, CASE WHEN age >= 20 THEN 95.0::DOUBLE WHEN age >= 10 THEN 90.0::DOUBLE WHEN age >= 5 THEN 85.0::DOUBLE
  WHEN age >= 3 THEN 75.0::DOUBLE WHEN age >= 2 THEN 65.0::DOUBLE WHEN age >= 1 THEN 55.0::DOUBLE ELSE 40.0::DOUBLE END AS domain_age
FROM p JOIN a USING (domain)""")
def _(t: Tables):
    whois = C.parse_whois(whois_rows(t), "raw", F.lit("2024-06-01").cast("date")).select("domain", "verified", "age_years")
    pages = t.pages.select("page_id", "url", F.col("html").alias("content"), F.lit("").alias("title"))
    return C.credibility(pages, SOURCES, whois).select("page_id", "domain", "age_years", "domain_age")


# --- Sensationalism -----------------------------------------------------------------

HEURISTIC_WORDS = [*WORDS_A, "de", "of the"]


def heuristic_sql(content: str, title: str) -> str:
    plain = [w for w in HEURISTIC_WORDS if " " not in w]
    hits = f"({sql_count_words('w', plain)} + {sql_count_phrases(content, ['of the'])})"
    in_title = "(" + " + ".join(f"(list_contains(hw, '{w}'))::INTEGER" for w in plain) + f" + ({sql_count_phrases(title, ['of the'])} > 0)::INTEGER)"
    inten = " + ".join(char_count("lower(c)", w) for w in L.HEURISTIC_INTENSIFIERS)
    cap = lambda e, m: f"least({e}, {m}::DOUBLE)"
    emo = [f"len(list_filter(w, lambda x: x IN {sql_in(ws)}))" for ws in (
        ["very", "extremely", "absolutely", "completely", "totally", "incredibly", "amazingly"],
        ["shocking", "stunning", "devastating", "horrifying", "terrifying", "outrageous"],
        ["never", "always", "all", "every", "none", "nothing", "everything"])]
    emotion = " + ".join(cap(f"{e} / n * 20", 0.15) for e in emo)
    return f"""
heur AS (SELECT id, {content} AS c, {title} AS h, {tok(content)} AS w, {tok(title)} AS hw,
  greatest({ws_count(content)}, 1)::DOUBLE AS n FROM articles),
heur_parts AS (SELECT id, n, h, {hits.replace(content, 'c')} AS hits, {char_count('c', '!')} AS marks, {char_count('c', '?')} AS asks,
  len(regexp_extract_all(c, '\\p{{Lu}}')) / greatest(length(c), 1)::DOUBLE AS caps, {in_title.replace(title, 'h')} AS th,
  len(regexp_extract_all(h, '\\p{{Lu}}')) / greatest(length(h), 1)::DOUBLE AS tcaps, {emotion} AS emotion, ({inten}) AS inten FROM heur),
heuristic AS (SELECT id, hits AS suspicious_keywords, marks AS exclamations, round(caps, 6) AS caps_ratio, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE,
  0.35::DOUBLE + {cap('hits / n * 30', 0.3)} + {cap('marks / n * 12', 0.2)} + {cap('asks / n * 6', 0.15)} + {cap('caps * 2.5::DOUBLE', 0.2)}
  + CASE WHEN h <> '' THEN {cap('th * 0.1::DOUBLE', 0.2)} + {cap(char_count('h', '!') + ' * 0.08::DOUBLE', 0.15)}
    + {cap(char_count('h', '?') + ' * 0.04::DOUBLE', 0.08)} + {cap('tcaps * 2', 0.15)} ELSE 0.0::DOUBLE END * 0.4::DOUBLE
  + {cap('emotion', 0.15)} + {cap('inten / n * 15', 0.15)})), 6) AS sensationalism FROM heur_parts)"""


@query("sensationalism_heuristic", "J13", f"""
WITH {ARTICLES_SQL}, {heuristic_sql('content', 'title')}
SELECT id, suspicious_keywords, exclamations, caps_ratio, sensationalism FROM heuristic""")
def _(t: Tables):
    out = Z.sensationalism_heuristic(t.articles, words=tuple(HEURISTIC_WORDS))
    return out.select("id", "suspicious_keywords", "exclamations", F.round("caps_ratio", 6).alias("caps_ratio"),
                      "sensationalism")


def zscore_parts(negated) -> tuple[str, dict[str, str]]:
    """SQL of the statistics, and of every feature's weighted contribution."""
    stats = ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in L.ZSCORE_WEIGHTS)
    parts = {}
    for n, weight in L.ZSCORE_WEIGHTS.items():
        sign = "-" if L.FEATURE_NAMES.index(n) in negated else ""
        parts[n] = (f"CASE WHEN s_{n} > 0 THEN greatest(-3.0::DOUBLE, least(3.0::DOUBLE, {sign}(({n} - m_{n}) / s_{n}))) ELSE 0 END "
                    f"* {weight}::DOUBLE")
    return stats, parts


def contributors_sql() -> str:
    stats, parts = zscore_parts(L.ZSCORE_NEGATED_BY_NAME)
    rows = ", ".join(f"{{'feature': '{n}', 'v': {part}}}" for n, part in parts.items())
    return f"""
WITH feats AS ({features_sql(stand_in_lists())}), st AS (SELECT {stats} FROM feats),
long AS (SELECT doc_id, unnest([{rows}]) AS c FROM feats, st)
SELECT doc_id, (row_number() OVER w - 1)::INTEGER AS pos, c.feature AS feature, round(c.v, 5) + 0 AS contribution FROM long
WINDOW w AS (PARTITION BY doc_id ORDER BY abs(round(c.v, 9)) DESC, c.feature) QUALIFY row_number() OVER w <= 5"""


def zscore_sql() -> str:
    stats, parts = zscore_parts(L.ZSCORE_NEGATED)
    total = sum(L.ZSCORE_WEIGHTS.values())
    return f"""
WITH feats AS ({features_sql(stand_in_lists())}), st AS (SELECT {stats} FROM feats),
z AS (SELECT doc_id, ({' + '.join(parts.values())}) / {total}::DOUBLE AS combined_z FROM feats, st)
SELECT doc_id, round(combined_z, 5) AS combined_z, round(1 / (1 + exp(-0.5::DOUBLE * combined_z)), 5) AS calmness,
  round(1 - 1 / (1 + exp(-0.5::DOUBLE * combined_z)), 5) AS sensationalism FROM z"""


@query("sensationalism_zscore", "J12", zscore_sql())
def _(t: Tables):
    feats = G.linguistic_features(t.texts.select("doc_id", "text"), "text", stand_in_lists()).drop("text")
    # Written once: the statistics and the scores read the same 28 columns.
    feats = cut_lineage(feats.select("doc_id", *[F.round(n, 9).alias(n) for n in L.FEATURE_NAMES]))
    out = Z.sensationalism_zscore(feats, Z.feature_statistics(feats))
    return out.select("doc_id", *[F.round(c, 5).alias(c) for c in ("combined_z", "calmness", "sensationalism")])


_MARGIN = "40.0 * caps_density + 0.4 * avg_word_length - 3.0"


def stand_in_model():
    """A linear classifier with fixed coefficients, in the shape of a saved pipeline: a twin can state it."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer, VectorAssembler

    return PipelineModel([SQLTransformer(statement=f"SELECT *, {_MARGIN} AS margin, -({_MARGIN}) AS margin_0 FROM __THIS__"),
                          VectorAssembler(inputCols=["margin_0", "margin"], outputCol="rawPrediction")])


@query("sensationalism_chain", "J11 J12 J13", f"""
WITH {ARTICLES_SQL}, {heuristic_sql('content', 'title')}, zs AS ({zscore_sql()}), fs AS ({features_sql(stand_in_lists())}),
c AS (SELECT a.id, {ws_count('a.content')} AS n, h.sensationalism AS by_heuristic, zs.sensationalism AS by_z,
  1 / (1 + exp(-({_MARGIN}))) AS by_model FROM articles a JOIN heuristic h USING (id) JOIN zs ON zs.doc_id = a.id JOIN fs ON fs.doc_id = a.id)
SELECT id, CASE WHEN n >= 200 THEN 'model' WHEN n >= 60 THEN 'z_score' ELSE 'heuristic' END AS method,
  round(CASE WHEN n >= 200 THEN by_model WHEN n >= 60 THEN by_z ELSE by_heuristic END, 5) AS sensationalism FROM c""")
def _(t: Tables):
    """Long texts by the model, shorter ones by z-scores, the shortest by the heuristic."""
    feats = G.linguistic_features(t.articles.select("content"), "content", stand_in_lists())
    out = Z.sensationalism_chain(t.articles, Z.feature_statistics(feats), stand_in_model(), lists=stand_in_lists(), words=HEURISTIC_WORDS,
                                 model_words=200, zscore_words=60)
    return out.select("id", F.col("sensationalism_method").alias("method"), F.round("sensationalism", 5).alias("sensationalism"))


@query("zscore_contributors", "J12", contributors_sql())
def _(t: Tables):
    feats = G.linguistic_features(t.texts.select("doc_id", "text"), "text", stand_in_lists()).drop("text")
    feats = cut_lineage(feats.select("doc_id", *[F.round(n, 9).alias(n) for n in L.FEATURE_NAMES]))
    out = Z.sensationalism_zscore(feats, Z.feature_statistics(feats), by_name=True)
    return out.select("doc_id", F.posexplode_outer("top_contributors").alias("pos", "c")).select(
        "doc_id", "pos", F.col("c.feature").alias("feature"), (F.round("c.contribution", 5) + 0.0).alias("contribution"))


@query("feature_breakdown", "J14", f"""
WITH feats AS ({features_sql(stand_in_lists())})
SELECT doc_id, {', '.join(L.FEATURE_NAMES)} FROM feats""")
def _(t: Tables):
    feats = G.linguistic_features(t.texts.select("doc_id", "text"), "text", stand_in_lists()).drop("text")
    # All 28 features, each read from the group that holds it.
    out = G.feature_breakdown(feats)
    return out.select("doc_id", *[F.round(f"{f.name}.{n}", 9).alias(n) for f in out.schema.fields if f.name != "doc_id"
                                  for n in f.dataType.names])


# --- Sentiment --------------------------------------------------------------------------

LEXICON = [("the", 0.4), ("and", -0.6), ("la", 1.2), ("de", -0.3), ("und", 0.9), ("with", -1.1), ("que", 0.5),
           ("nicht", -1.9), ("with", -1.1)]


def lexicon(t: Tables):
    return t.spark.createDataFrame(LEXICON, "word string, valence double").distinct()


@query("sentiment_scores", "H21 H22")
def _(t: Tables):
    return M.sentiment_features(M.sentiment_scores(t.texts, "doc_id", "text", lexicon(t)))


@query("subjectivity", "H23", f"""
WITH lex(word, s) AS (VALUES ('the', 0.4::DOUBLE), ('de', 0.7::DOUBLE), ('und', 0.1::DOUBLE)),
t AS (SELECT doc_id, unnest({tok('text')}) AS word FROM documents)
SELECT d.doc_id, coalesce(round(avg(s), 6), 0) AS sentiment_subjectivity
FROM documents d LEFT JOIN (SELECT doc_id, s FROM t JOIN lex USING (word)) x USING (doc_id) GROUP BY d.doc_id""")
def _(t: Tables):
    lex = t.spark.createDataFrame([("the", 0.4), ("de", 0.7), ("und", 0.1)], "word string, subjectivity double")
    out = M.subjectivity(t.texts, "doc_id", "text", lex)
    return out.select("doc_id", F.round("sentiment_subjectivity", 6).alias("sentiment_subjectivity"))


@query("sentiment_flow", "H24 D16 E5")
def _(t: Tables):
    flow = M.sentiment_flow(t.texts, "doc_id", "text", lexicon(t))
    return flow.select("doc_id", "sentence_number", "compound", "pos", "neg", "neu")


@query("sentence_summary", "D16")
def _(t: Tables):
    return M.sentence_summary(M.sentiment_flow(t.texts, "doc_id", "text", lexicon(t)), "doc_id").withColumn(
        "avg_sentiment", F.round("avg_sentiment", 6))


@query("features_with_sentiment", "H13 H21 H22 H23")
def _(t: Tables):
    mood = M.sentiment_features(M.sentiment_scores(t.texts, "doc_id", "text", lexicon(t))).withColumn("subj", F.lit(0.0))
    # The features are counted where the texts lie; only numbers meet the scores.
    counted = G.linguistic_features(t.texts.select("doc_id", "text"), "text", stand_in_lists()).drop("text")
    return G.with_sentiment(counted, mood, "doc_id", ["sentiment_polarity", "subj", "sentiment_intensity", "sentiment_balance"]).select(
        "doc_id", *[F.round(n, 6).alias(n) for n in L.FEATURE_NAMES])


# --- Composite score -----------------------------------------------------------------------

@query("overall_score", "J15 B23", f"""
WITH {ARTICLES_SQL}, {LANGUAGE_SQL}, {CREDIBILITY_SQL}, {heuristic_sql('content', 'title')},
j AS (SELECT a.id, round(l.language_score, 3) AS ls, round(s.credibility, 3) AS cs, round((n_chars % 101) / 100.0::DOUBLE, 3) AS xs, h.sensationalism AS se
  FROM articles a JOIN lang l USING (id) JOIN scored s USING (id) JOIN heuristic h USING (id))
SELECT id, round(ls * 0.25::DOUBLE + cs * 0.25::DOUBLE + xs * 0.25::DOUBLE + (1.0::DOUBLE - se) * 0.25::DOUBLE, 9) AS inverted,
  round(ls * 0.25::DOUBLE + cs * 0.25::DOUBLE + xs * 0.25::DOUBLE + se * 0.25::DOUBLE, 9) AS plain FROM j""")
def _(t: Tables):
    df = G.language_scores(t.articles)
    df = C.credibility(df, SOURCES)
    df = Z.sensationalism_heuristic(df, words=tuple(HEURISTIC_WORDS))
    parts = [F.round("language_score", 3), F.round("credibility", 3), F.round(F.col("n_chars") % 101 / 100.0, 3),
             F.col("sensationalism")]
    return df.select("id", F.round(S.overall_score(*parts), 9).alias("inverted"),
                     F.round(S.overall_score(*parts, invert=False), 9).alias("plain"))


def analysis_settings() -> AN.AnalysisSettings:
    return AN.AnalysisSettings(words=stand_in_lists(), sources=SOURCES, credible_words=WORDS_A,
                               suspicious_words=HEURISTIC_WORDS, tfidf=CROSS, k=20, hold="corpus")


ANALYSIS_SQL = f"""
WITH {ARTICLES_SQL}, {REQUESTS_SQL}, {LANGUAGE_SQL}, {CREDIBILITY_SQL}, {heuristic_sql('content', 'title')},
l AS (SELECT id, content AS body FROM articles), r AS (SELECT id, content AS body FROM requests), {cosine_sql(CROSS, 'l', 'r', 20)},
described AS (SELECT b.*, {domain_sql('n.url')} AS domain, n.url AS cand_url, a.url AS query_url, {reliable_sql(domain_sql('n.url'), SOURCES.reliable)} AS is_reliable
  FROM best b JOIN requests n ON n.id = b.cand_id JOIN articles a ON a.id = b.query_id WHERE b.similarity > 0),
perfect AS (SELECT query_id FROM described WHERE similarity > 0.95 AND (contains(cand_url, query_url) OR contains(query_url, cand_url)) GROUP BY query_id),
pairs AS (SELECT * FROM described WHERE cand_url <> query_url), {METRICS_SQL},
checked AS (SELECT a.id, CASE WHEN p.query_id IS NOT NULL THEN 1.0::DOUBLE WHEN score IS NOT NULL THEN score ELSE 0.30::DOUBLE END AS cross_check,
  CASE WHEN p.query_id IS NOT NULL THEN 'Perfect Match' WHEN score IS NULL THEN 'No Corroboration Found' WHEN score >= 0.7 THEN 'Strong Corroboration'
    WHEN score >= 0.5 THEN 'Moderate Corroboration' WHEN score >= 0.3 THEN 'Weak Corroboration' ELSE 'No Corroboration' END AS cross_check_status
  FROM articles a LEFT JOIN sc ON sc.query_id = a.id LEFT JOIN perfect p ON p.query_id = a.id),
parts AS (SELECT a.id, a.url, a.title, a.source, s.domain, s.known_source, round(g.language_score, 3) AS language_score,
  round(s.credibility, 3) AS credibility_score, round(c.cross_check, 3) AS cross_check_score, h.sensationalism, c.cross_check_status,
  {ws_count('a.content')} AS word_count, {tok('a.content')} AS words
  FROM articles a JOIN lang g USING (id) JOIN scored s USING (id) JOIN heuristic h USING (id) JOIN checked c USING (id)),
total AS (SELECT *, round(language_score * 0.25::DOUBLE + credibility_score * 0.25::DOUBLE + cross_check_score * 0.25::DOUBLE
  + (1.0::DOUBLE - sensationalism) * 0.25::DOUBLE, 3) AS overall_score FROM parts)
SELECT id, md5(url) AS article_key, title, source, domain, language_score, credibility_score, cross_check_score, sensationalism, overall_score,
  CASE WHEN floor(overall_score * 100 + 0.5) >= 70 THEN 'HIGH CREDIBILITY' WHEN floor(overall_score * 100 + 0.5) >= 40
    THEN 'MEDIUM CREDIBILITY' ELSE 'LOW CREDIBILITY' END AS verdict,
  CASE WHEN sensationalism < 0.3 THEN 'Low' WHEN sensationalism < 0.7 THEN 'Moderate' ELSE 'High' END AS sensationalism_level,
  CASE WHEN credibility_score >= 0.7 THEN 'real' WHEN credibility_score >= 0.4 THEN 'mixed' ELSE 'fake' END AS band,
  known_source, cross_check_status, word_count, len(words) AS total_words, len(list_distinct(words)) AS unique_words FROM total"""


@query("analyze_articles", "J16 J15 J9", ANALYSIS_SQL)
def _(t: Tables):
    """Every document scored against the benchmark items as stored news."""
    out = AN.analyze_articles(t.articles, t.requests, analysis_settings(), analyzed_at=F.lit("2024-06-01"))
    return out.select("id", "article_key", "title", "source", "domain", "language_score", "credibility_score",
                      "cross_check_score", "sensationalism", "overall_score", "verdict", "sensationalism_level", "band",
                      "known_source", "cross_check_status", "word_count", "total_words", "unique_words")


@query("stored_analysis", "J16 J18 J9 C5")
def _(t: Tables):
    """Every benchmark item as a new article against the stored documents: the whole stored row."""
    store = t.store.withColumn("source_url", F.col("url"))
    settings = AN.AnalysisSettings(words=stand_in_lists(), sources=SOURCES, credible_words=WORDS_A, suspicious_words=HEURISTIC_WORDS,
                                   tfidf=CROSS, positive=WORDS_A, negative=WORDS_B, lexicon=lexicon(t))
    out = AN.stored_analysis(t.requests, store, settings, analyzed_at=F.lit("2024-06-01"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return out.select("id", "language_score", "credibility_score", "cross_check_score", "sensationalism", "sensationalism_method",
                      "overall_score", "cross_check_status", "cross_check_description", "tone", "enhanced_info",
                      size("cross_check_points").alias("cross_check_points"), size("similarity_map").alias("similarity_map"),
                      size("related_articles").alias("related_articles"), size("sentiment_flow").alias("sentiment_flow"),
                      F.element_at("similarity_map", 1)["overall_score"].alias("own_point"))


@query("chart_tables", "J18 DM11", f"""
WITH {ARTICLES_SQL}, {LANGUAGE_SQL}
SELECT id, 'language' AS chart, 'Capitalization' AS label, round(capitalization, 6) AS value FROM lang
UNION ALL SELECT id, 'language', 'Complexity', round(complexity, 6) FROM lang""")
def _(t: Tables):
    df = G.language_scores(t.articles)
    return S.chart_rows(df, "id", "language", {"Capitalization": F.round("capitalization", 6),
                                                "Complexity": F.round("complexity", 6)})
