"""Queries over the labelled corpus: cleaning, statistics, text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgauge.functions import lexicons as L, text as X
from pressgauge.operators import cleaning as N, linguistic as G, ranking as R, statistics as ST
from pressgauge.plans.registry import (ARTICLES_SQL, CORPUS_SQL, S, Tables, W, char_count, query, sql_count_phrases,
                                       sql_count_words, sql_in, tok, ws, ws_count)

# Stand-in lists: words and phrases that do occur in the fixture texts.
WORDS_A = ["the", "and", "of", "that", "with"]
WORDS_B = ["de", "la", "les", "que", "und", "der"]
WORDS_C = ["los", "para", "nicht", "une", "is", "the"]
PHRASES = ["of the", "in the", "de la", "que de", "in der"]
GROUPS = [["the", "and", "is"], ["of the", "de la", "in der"], ["que", "the", "with"]]
STOPS = ("the", "and", "les", "der", "die", "que", "for", "une")


def stand_in_lists() -> G.WordLists:
    return G.WordLists(clickbait=GROUPS, emotional=WORDS_A, intensifiers=WORDS_B, tentative=WORDS_C,
                       evidence=["is", "of the"], professional=["de", "of", "de la"], balanced=["que", "und", "with"],
                       stop_words=STOPS)


# --- Cleaning --------------------------------------------------------------------

@query("fill_missing", "B1", """
SELECT doc_id, coalesce(CASE WHEN lang = 'de' THEN NULL ELSE text END, '') AS text, '' AS title FROM documents""")
def _(t: Tables):
    return N.fill_missing(t.documents.select(
        "doc_id", F.when(F.col("lang") != "de", F.col("text")).alias("text")))


@query("text_full", "B2", """
SELECT doc_id, split_part(text, chr(10), 1) || chr(10) || chr(10) || text AS text_full FROM documents""")
def _(t: Tables):
    return t.articles.select(F.col("id").alias("doc_id"), X.text_full(F.col("title"), F.col("content")).alias("text_full"))


@query("normalize_label", "B3", """
SELECT doc_id, CASE WHEN lower(trim(raw)) IN ('true', '1', '1.0') THEN 0
  WHEN lower(trim(raw)) IN ('false', '0', '0.0') THEN 1 END AS label
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' True ' WHEN 1 THEN 'FALSE' WHEN 2 THEN quality || '.0'
  WHEN 3 THEN quality::VARCHAR ELSE 'unknown' END AS raw FROM labels)""")
def _(t: Tables):
    raw = (F.when(F.col("doc_id") % 5 == 0, " True ").when(F.col("doc_id") % 5 == 1, "FALSE")
           .when(F.col("doc_id") % 5 == 2, F.concat(F.col("quality").cast("string"), F.lit(".0")))
           .when(F.col("doc_id") % 5 == 3, F.col("quality").cast("string")).otherwise("unknown"))
    return t.labels.select("doc_id", N.normalize_label(raw).alias("label"))


@query("text_metrics", "B4", """
SELECT doc_id, length(text) AS text_length, len(string_split(text, ' ')) AS word_count FROM documents""")
def _(t: Tables):
    return N.text_metrics(t.documents.withColumnRenamed("text", "text_full")).select(
        "doc_id", "text_length", "word_count")


@query("drop_invalid", "B5", """
SELECT d.doc_id, d.label FROM (
  SELECT d.doc_id, CASE WHEN d.lang = 'es' THEN chr(10) || chr(10) WHEN d.lang = 'fr' THEN '' ELSE d.text END AS text_full,
    1 - l.quality AS label FROM documents d LEFT JOIN labels l USING (doc_id)) d
WHERE text_full IS NOT NULL AND text_full NOT IN ('', chr(10) || chr(10)) AND label IS NOT NULL""")
def _(t: Tables):
    docs = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", F.when(F.col("lang") == "es", "\n\n").when(F.col("lang") == "fr", "").otherwise(
            F.col("text")).alias("text_full"), (1 - F.col("quality")).alias("label"))
    return N.drop_invalid(docs).select("doc_id", "label")


@query("clean_and_enrich", "B6 C1", f"""
WITH {CORPUS_SQL} SELECT doc_id, md5(text_full) AS text_hash, label, source, text_length, word_count FROM corpus""")
def _(t: Tables):
    return t.corpus.select("doc_id", F.md5("text_full").alias("text_hash"), "label", "source", "text_length",
                           "word_count")


@query("attach_labels", "C1", "SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def _(t: Tables):
    return N.attach_labels(t.documents.select("doc_id", "source"), t.labels)


@query("union_all", "G1", """
SELECT doc_id, 'documents' AS origin FROM documents UNION ALL SELECT item_id, 'benchmark' FROM benchmark
UNION ALL SELECT page_id, 'pages' FROM pages""")
def _(t: Tables):
    part = lambda df, key, name: df.select(F.col(key).alias("doc_id"), F.lit(name).alias("origin"))
    return N.union_all([part(t.documents, "doc_id", "documents"), part(t.benchmark, "item_id", "benchmark"),
                        part(t.pages, "page_id", "pages")])


@query("profile_source", "A4", """
SELECT 'doc_id' AS column_name, 'bigint' AS data_type, count(*) AS row_count, count(*) FILTER (doc_id IS NULL) AS null_count,
  min(doc_id::VARCHAR) AS sample_value, NULL::BIGINT AS distinct_labels FROM labels
UNION ALL SELECT 'quality', 'int', count(*), count(*) FILTER (quality IS NULL), min(quality::VARCHAR),
  count(DISTINCT quality) FROM labels
UNION ALL SELECT 'toxic', 'int', count(*), count(*) FILTER (toxic IS NULL), min(toxic::VARCHAR), NULL FROM labels""")
def _(t: Tables):
    return ST.profile_source(t.labels, "quality")


# --- Statistics ------------------------------------------------------------------

@query("label_distribution", "D1 F1", f"""
WITH {CORPUS_SQL} SELECT label, count(*) AS count FROM corpus GROUP BY label""")
def _(t: Tables):
    return ST.label_distribution(t.corpus)


@query("source_distribution", "D2 F1", f"""
WITH {CORPUS_SQL} SELECT source, count(*) AS count FROM corpus GROUP BY source""")
def _(t: Tables):
    return ST.source_distribution(t.corpus)


_STATS = ", ".join(
    f"{'round(' if f in ('avg', 'stddev') else ''}{'stddev_samp' if f == 'stddev' else f}({c})"
    f"{', 6)' if f in ('avg', 'stddev') else ''} AS {f}_{c}"
    for c in ("text_length", "word_count") for f in ("avg", "min", "max", "stddev"))


@query("text_statistics", "D3", f"WITH {CORPUS_SQL} SELECT {_STATS} FROM corpus")
def _(t: Tables):
    out = ST.text_statistics(t.corpus)
    return out.select(*[F.round(c, 6).alias(c) if c.startswith(("avg", "stddev")) else c for c in out.columns])


@query("label_by_source", "D4 F1", f"""
WITH {CORPUS_SQL} SELECT source, label, count(*) AS count FROM corpus GROUP BY source, label""")
def _(t: Tables):
    return ST.label_by_source(t.corpus)


@query("data_summary", "D5", f"""
WITH {CORPUS_SQL}, g AS (
  SELECT 'source' AS section, source AS item, count(*) AS n, avg(text_length) AS a, avg(word_count) AS b FROM corpus GROUP BY source
  UNION ALL SELECT 'label', label::VARCHAR, count(*), avg(text_length), avg(word_count) FROM corpus GROUP BY label
  UNION ALL SELECT 'total', 'all', count(*), avg(text_length), avg(word_count) FROM corpus)
SELECT section, item, n AS count, round(n / (SELECT count(*) FROM corpus)::DOUBLE * 100, 6) AS percent,
  round(a, 6) AS avg_text_length, round(b, 6) AS avg_word_count FROM g""")
def _(t: Tables):
    out = ST.data_summary(t.corpus)
    return out.select("section", "item", "count", *[F.round(c, 6).alias(c) for c in (
        "percent", "avg_text_length", "avg_word_count")])


@query("perform_aggregations", "D6", f"""
WITH {CORPUS_SQL}
SELECT 'label_distribution' AS statistic, label::VARCHAR AS item, count(*) AS count FROM corpus GROUP BY label
UNION ALL SELECT 'source_distribution', source, count(*) FROM corpus GROUP BY source
UNION ALL SELECT 'label_by_source', source || '/' || label, count(*) FROM corpus GROUP BY source, label
UNION ALL SELECT 'text_statistics', 'max_text_length', max(text_length) FROM corpus""")
def _(t: Tables):
    tables = ST.perform_aggregations(t.corpus)
    row = lambda name, item, n: tables[name].select(F.lit(name).alias("statistic"), item.alias("item"),
                                                    n.cast("long").alias("count"))
    return N.union_all([
        row("label_distribution", F.col("label").cast("string"), F.col("count")),
        row("source_distribution", F.col("source"), F.col("count")),
        row("label_by_source", F.concat_ws("/", "source", F.col("label").cast("string")), F.col("count")),
        row("text_statistics", F.lit("max_text_length"), F.col("max_text_length"))])


@query("ranked_sources", "E4", f"""
WITH {CORPUS_SQL}, c AS (SELECT source, count(*) AS count FROM corpus GROUP BY source)
SELECT source, count, round(count / sum(count) OVER ()::DOUBLE * 100, 6) AS percent,
  row_number() OVER (ORDER BY count DESC, source) AS position FROM c""")
def _(t: Tables):
    return ST.ranked_sources(t.corpus).withColumn("percent", F.round("percent", 6))


_PHRASE_LIST = ["the", "de la", "on", "tion", "of the", "qu", "not in any text"]


def _phrase_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT label, count(*) AS documents, '{p}' AS phrase, "
        f"sum({char_count('lower(text_full)', p)})::BIGINT AS occurrences FROM corpus GROUP BY label"
        for p in _PHRASE_LIST)


@query("phrase_counts", "D13", f"WITH {CORPUS_SQL} {_phrase_sql()}")
def _(t: Tables):
    return ST.phrase_counts(t.corpus, _PHRASE_LIST)


@query("phrase_lift", "D14", f"""
WITH {CORPUS_SQL}, p AS ({_phrase_sql()}), r AS (
  SELECT phrase, max(CASE WHEN label = 1 THEN occurrences / documents::DOUBLE END) AS fake_rate,
    max(CASE WHEN label = 0 THEN occurrences / documents::DOUBLE END) AS real_rate FROM p GROUP BY phrase)
SELECT phrase, round(fake_rate, 6) AS fake_rate, round(real_rate, 6) AS real_rate, round(fake_rate / real_rate, 6) AS lift
FROM r WHERE real_rate > 0""")
def _(t: Tables):
    out = ST.phrase_lift(t.corpus, _PHRASE_LIST)
    return out.select("phrase", *[F.round(c, 6).alias(c) for c in ("fake_rate", "real_rate", "lift")])


@query("word_frequency", "D15 G4 B29", f"""
WITH t AS (SELECT doc_id, text, {tok('text')} AS w FROM documents)
SELECT doc_id, len(w) AS total_words, len(list_distinct(w)) AS unique_words,
  {sql_count_words('w', WORDS_A)} AS credible_total, {sql_count_words('w', WORDS_B)} AS suspicious_total,
  len(list_distinct(list_filter(w, lambda x: x IN {sql_in(WORDS_B)}))) AS suspicious_distinct,
  {sql_count_phrases('text', ['of the'])} + {sql_count_phrases('text', ['de la'])} AS listed_phrases
FROM t""")
def _(t: Tables):
    out = ST.word_frequency(t.texts, "doc_id", "text", [*WORDS_A, "of the"], [*WORDS_B, "de la"])
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0), lambda s, x: s + x)
    return out.select("doc_id", "total_words", "unique_words", total("credible_words").alias("credible_total"),
                      total("suspicious_words").alias("suspicious_total"),
                      F.size("suspicious_words").alias("suspicious_distinct"), "listed_phrases")


@query("lexicon_matches", "C11", f"""
WITH lex(word, category) AS (VALUES {', '.join(f"('{w}', 'a')" for w in WORDS_A)}, {', '.join(f"('{w}', 'b')" for w in WORDS_B)}),
t AS (SELECT doc_id, unnest({tok('text')}) AS word FROM documents)
SELECT doc_id, category, count(*) AS hits FROM t JOIN lex USING (word) GROUP BY doc_id, category""")
def _(t: Tables):
    lex = t.spark.createDataFrame([(w, "a") for w in WORDS_A] + [(w, "b") for w in WORDS_B],
                                  "word string, category string")
    return ST.lexicon_matches(t.texts, "doc_id", "text", lex)


# --- Splits ------------------------------------------------------------------------

@query("stratified_split", "E2", f"""
WITH {CORPUS_SQL} SELECT doc_id, label,
  percent_rank() OVER (PARTITION BY label ORDER BY md5(doc_id || '42'), doc_id) < 0.2 AS is_test FROM corpus""")
def _(t: Tables):
    return R.stratified_split(t.corpus.select("doc_id", "label"))


@query("kfold", "E3", f"""
WITH {CORPUS_SQL} SELECT doc_id, label,
  ntile(10) OVER (PARTITION BY label ORDER BY md5(doc_id || '42'), doc_id)::INTEGER AS fold FROM corpus""")
def _(t: Tables):
    return R.kfold(t.corpus.select("doc_id", "label"), 10)


@query("class_weights", "K4", f"""
WITH {CORPUS_SQL} SELECT label, count(*) AS n, round((SELECT count(*) FROM corpus) / (2.0::DOUBLE * count(*)), 9) AS weight
FROM corpus GROUP BY label""")
def _(t: Tables):
    return R.class_weights(t.corpus).withColumn("weight", F.round("weight", 9))


# --- Scalar text functions -----------------------------------------------------------

def norm_sql(text: str) -> str:
    out = f"regexp_replace({text}, '{S}+', ' ', 'g')"
    ns = S.replace("[", "[^", 1)
    out = f"regexp_replace({out}, 'https?://{ns}+|www\\.{ns}+', ' ', 'g')"
    out = f"regexp_replace({out}, '{ns}+@{ns}+', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^\\n]*?>', ' ', 'g')"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}_\\t-\\r\\x1c-\\x20\\x{{85}}\\p{{Z}}.!?]', ' ', 'g')"
    return f"regexp_replace({out}, '^{S}+|{S}+\\z', '', 'g')"


@query("normalize_text", "H1", f"""
SELECT doc_id, md5({norm_sql('text')}) AS text_hash, length({norm_sql('text')}) AS chars FROM documents""")
def _(t: Tables):
    body = X.normalize_text(F.col("text"))
    return t.texts.select("doc_id", body.alias("b")).select("doc_id", F.md5("b").alias("text_hash"),
                                                              F.length("b").alias("chars"))


@query("tokens", "H2 G4", f"""
WITH t AS (SELECT doc_id, list_filter({tok('text')}, lambda w: length(w) > 2 AND w NOT IN {sql_in(STOPS)}) AS k FROM documents)
SELECT doc_id, len(k) AS tokens, len(list_distinct(k)) AS distinct_tokens, md5(array_to_string(k, ' ')) AS token_hash FROM t""")
def _(t: Tables):
    k = t.texts.select("doc_id", X.content_tokens(F.col("text"), STOPS).alias("k"))
    return k.select("doc_id", F.size("k").alias("tokens"), F.size(F.array_distinct("k")).alias("distinct_tokens"),
                    F.md5(F.array_join("k", " ")).alias("token_hash"))


@query("count_patterns", "H3", f"""
WITH t AS (SELECT doc_id, text, {tok('text')} AS w FROM documents)
SELECT doc_id, {' + '.join(sql_count_words('w', g) if ' ' not in g[0] else sql_count_phrases('text', g) for g in GROUPS)} AS matches FROM t""")
def _(t: Tables):
    return t.texts.select("doc_id", X.count_patterns(F.lower("text"), [X.whole(g) for g in GROUPS]).alias("matches"))


@query("count_words", "H4", f"""
WITH t AS (SELECT doc_id, text, {tok('text')} AS w FROM documents)
SELECT doc_id, {sql_count_words('w', WORDS_C + ['the'])} AS matches,
  {' + '.join(sql_count_phrases('text', [p]) for p in PHRASES)} AS phrase_matches FROM t""")
def _(t: Tables):
    return t.texts.select("doc_id", X.count_words(F.col("text"), WORDS_C + ["the"]).alias("matches"),
                          X.count_words(F.col("text"), PHRASES).alias("phrase_matches"))


@query("count_data_refs", "H5", """
SELECT doc_id, len(regexp_extract_all(text, '\\p{Nd}+%')) + len(regexp_extract_all(text, '\\p{Nd}{4}'))
  + len(regexp_extract_all(text, '\\$\\p{Nd}+')) + len(regexp_extract_all(text, '\\p{Nd}+\\.\\p{Nd}+'))
  + len(regexp_extract_all(text, '(?i)study|research|analysis|report|findings|data|statistics')) AS refs FROM documents""")
def _(t: Tables):
    return t.texts.select("doc_id", X.count_patterns(F.col("text"), L.DATA_REFERENCE_PATTERNS).alias("refs"))


@query("token_ratios", "H6 H7", f"""
WITH t AS (SELECT doc_id, {tok('text')} AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x FROM t), c AS (SELECT doc_id, x, count(*) AS n FROM u GROUP BY doc_id, x),
a AS (SELECT doc_id, count(*) FILTER (n > 1) AS again, count(*) AS d, sum(n) AS total FROM c GROUP BY doc_id)
SELECT t.doc_id, coalesce(round(again / d::DOUBLE, 9), 0) AS repetition_ratio,
  coalesce(round(d / total::DOUBLE, 9), 0) AS unique_word_ratio FROM t LEFT JOIN a USING (doc_id)""")
def _(t: Tables):
    w = t.texts.select("doc_id", X.word_tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.round(X.repetition_ratio(F.col("w")), 9).alias("repetition_ratio"),
                    F.round(X.unique_ratio(F.col("w")), 9).alias("unique_word_ratio"))


@query("punctuation_and_caps", "H8 H9", f"""
WITH t AS (SELECT doc_id, text, {ws('text')} AS w FROM documents)
SELECT doc_id, {char_count('text', '!')} AS exclamations, {char_count('text', '?')} AS questions,
  len(list_filter(w, lambda x: length(x) > 1 AND regexp_matches(x, '\\p{{Lu}}') AND NOT regexp_matches(x, '[\\p{{Ll}}\\p{{Lt}}]'))) AS caps_words,
  round({char_count('text', '!')} / greatest(1, len(w))::DOUBLE, 9) AS exclamation_density FROM t""")
def _(t: Tables):
    w = t.texts.select("doc_id", "text", X.words(F.col("text")).alias("w"))
    marks = X.count_char(F.col("text"), "!")
    return w.select("doc_id", marks.alias("exclamations"), X.count_char(F.col("text"), "?").alias("questions"),
                    F.size(F.filter("w", lambda x: (F.length(x) > 1) & X.is_upper(x))).alias("caps_words"),
                    F.round(marks / F.greatest(F.lit(1), F.size("w")), 9).alias("exclamation_density"))


@query("sentence_and_word_length", "H10", f"""
WITH t AS (SELECT doc_id, {ws('text')} AS w, len(list_filter(string_split_regex(text, '[.!?]+'),
  lambda x: regexp_matches(x, '{S.replace('[', '[^', 1)}'))) AS s FROM documents)
SELECT doc_id, round(len(w) / greatest(1, s)::DOUBLE, 9) AS avg_sentence_length,
  round(length(array_to_string(w, '')) / greatest(1, len(w))::DOUBLE, 9) AS avg_word_length FROM t""")
def _(t: Tables):
    w = t.texts.select("doc_id", X.words(F.col("text")).alias("w"),
                       F.size(X.non_blank(X.sentence_pieces(F.col("text")))).alias("s"))
    n = F.size("w")
    return w.select("doc_id", F.round(n / F.greatest(F.lit(1), F.col("s")), 9).alias("avg_sentence_length"),
                    F.round(X.total_length(F.col("w")) / F.greatest(F.lit(1), n), 9).alias("avg_word_length"))


def features_sql(lists: G.WordLists) -> str:
    notspace = S.replace("[", "[^", 1)

    def counted(entries) -> str:
        plain = [e for e in entries if " " not in e]
        out = [sql_count_words("w", plain)] if plain else []
        return "(" + " + ".join(out + [sql_count_phrases("t", [p]) for p in entries if " " in p]) + ")"

    click = " + ".join(sql_count_words("w", g) if " " not in g[0] else sql_count_phrases("t", g) for g in lists.clickbait)
    per_word = {"clickbait_score": "cb", "emotional_intensity": "em", "exclamation_density": "ex", "caps_density": "cp",
                "question_density": "qu"}
    per_tok = {"intensifier_ratio": "it", "tentative_ratio": "te", "evidence_ratio": "ev", "professional_ratio": "pr",
               "balanced_ratio": "ba"}
    plain = {"text_length": "length(t)", "word_count": "n", "all_caps_words": "cp", "exclamation_count": "ex",
             "question_count": "qu", "clickbait_matches": "cb", "emotional_word_count": "em",
             "professional_word_count": "pr", "balanced_word_count": "ba", "data_references": "rf"}
    cols = [f"round({v} / greatest(1, n)::DOUBLE, 9) AS {k}" for k, v in per_word.items()]
    cols += [f"round({v} / greatest(1, len(k))::DOUBLE, 9) AS {k}" for k, v in per_tok.items()]
    cols += [f"{v}::DOUBLE AS {k}" for k, v in plain.items()]
    cols += [f"0.0::DOUBLE AS {k}" for k in L.FEATURE_NAMES[5:9]]
    cols += ["round(n / greatest(1, sn)::DOUBLE, 9) AS avg_sentence_length",
             "round(ch / greatest(1, n)::DOUBLE, 9) AS avg_word_length",
             "coalesce(round(again / d::DOUBLE, 9), 0) AS repetition_ratio",
             "coalesce(round(d / len(k)::DOUBLE, 9), 0) AS unique_word_ratio"]
    return f"""
WITH b AS (SELECT doc_id, {norm_sql('text')} AS t FROM documents),
s AS (SELECT doc_id, t, {ws('t')} AS ww, {tok('t')} AS w FROM b),
k AS (SELECT *, list_filter(w, lambda x: length(x) > 2 AND x NOT IN {sql_in(lists.stop_words)}) AS k FROM s),
r AS (SELECT doc_id, count(*) FILTER (c > 1) AS again, count(*) AS d FROM (
  SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(k) AS x FROM k) GROUP BY doc_id, x) GROUP BY doc_id),
f AS (SELECT k.doc_id, t, k, len(ww) AS n, length(array_to_string(ww, '')) AS ch, again, d,
  len(list_filter(string_split_regex(t, '[.!?]+'), lambda x: regexp_matches(x, '{notspace}'))) AS sn,
  {click} AS cb, {counted(lists.emotional)} AS em, {counted(lists.intensifiers)} AS it,
  {counted(lists.tentative)} AS te, {counted(lists.evidence)} AS ev, {counted(lists.professional)} AS pr,
  {counted(lists.balanced)} AS ba, {char_count('t', '!')} AS ex, {char_count('t', '?')} AS qu,
  len(list_filter(ww, lambda x: length(x) > 1 AND regexp_matches(x, '\\p{{Lu}}') AND NOT regexp_matches(x, '[\\p{{Ll}}\\p{{Lt}}]'))) AS cp,
  len(regexp_extract_all(t, '\\p{{Nd}}+%')) + len(regexp_extract_all(t, '\\p{{Nd}}{{4}}')) + len(regexp_extract_all(t, '\\$\\p{{Nd}}+'))
  + len(regexp_extract_all(t, '\\p{{Nd}}+\\.\\p{{Nd}}+'))
  + len(regexp_extract_all(t, '(?i)study|research|analysis|report|findings|data|statistics')) AS rf
  FROM k LEFT JOIN r USING (doc_id))
SELECT doc_id, {', '.join(cols)} FROM f"""


def rounded(df, keys=("doc_id",)):
    return df.select(*keys, *[F.round(n, 9).alias(n) for n in L.FEATURE_NAMES])


@query("linguistic_features", "H13 H8 H9 H10 H11 H12", features_sql(stand_in_lists()))
def _(t: Tables):
    return rounded(G.linguistic_features(t.texts.select("doc_id", "text"), "text", stand_in_lists()))


@query("lexicon_ratios", "H11 H12", f"""
SELECT doc_id, round(a / greatest(1, len(w))::DOUBLE, 9) AS ratio_a, round(b / greatest(1, n)::DOUBLE, 9) AS ratio_b
FROM (SELECT doc_id, w, n, {sql_count_words('w', WORDS_A)} AS a, {sql_count_words('w', WORDS_B)} AS b
  FROM (SELECT doc_id, {tok('text')} AS w, {ws_count('text')} AS n FROM documents))""")
def _(t: Tables):
    w = t.texts.select("doc_id", F.lower("text").alias("low"), X.word_tokens(F.col("text")).alias("w"),
                       X.whitespace_words(F.col("text")).alias("n"))
    return w.select(
        "doc_id",
        F.round(X.count_listed(F.col("w"), F.col("low"), WORDS_A) / F.greatest(F.lit(1), F.size("w")), 9).alias("ratio_a"),
        F.round(X.count_listed(F.col("w"), F.col("low"), WORDS_B) / F.greatest(F.lit(1), F.col("n")), 9).alias("ratio_b"))


def _inline_sql() -> str:
    present = lambda entries: "(" + " + ".join(f"contains(low, '{e}')::INTEGER" for e in entries) + ")"
    return f"""
WITH s AS (SELECT doc_id, text AS t, lower(text) AS low, {ws('text')} AS ww, {tok('text')} AS w FROM documents)
SELECT doc_id, round({present(L.INLINE_EMOTIONAL)} / greatest(1, len(ww))::DOUBLE, 9) AS emotional_intensity,
  round({present(L.INLINE_TENTATIVE)} / greatest(1, len(w))::DOUBLE, 9) AS tentative_ratio,
  round({present(L.INLINE_BALANCED)} / greatest(1, len(w))::DOUBLE, 9) AS balanced_ratio,
  {present(L.INLINE_PROFESSIONAL)}::DOUBLE AS professional_word_count,
  {sql_count_words('w', L.INLINE_DATA_WORDS)}::DOUBLE AS data_references,
  length(t)::DOUBLE AS text_length, len(ww)::DOUBLE AS word_count,
  round(len(list_distinct(w)) / greatest(1, len(w))::DOUBLE, 9) AS unique_word_ratio FROM s"""


@query("linguistic_features_inline", "H32", _inline_sql())
def _(t: Tables):
    out = rounded(G.linguistic_features_inline(t.texts.select("doc_id", "text"), "text"))
    return out.select("doc_id", "emotional_intensity", "tentative_ratio", "balanced_ratio", "professional_word_count",
                      "data_references", "text_length", "word_count", "unique_word_ratio")


@query("simple_style_features", "H31 B29", f"""
SELECT doc_id, round({ws_count('text')} / 1000.0::DOUBLE, 9) AS words_k,
  round({char_count('text', '!')} / greatest(length(text), 1)::DOUBLE, 9) AS exclamations_per_char,
  round({char_count('text', '?')} / greatest(length(text), 1)::DOUBLE, 9) AS questions_per_char,
  round(len(regexp_extract_all(text, '\\p{{Lu}}')) / greatest(length(text), 1)::DOUBLE, 9) AS capitals_per_char,
  0.5::DOUBLE AS constant FROM documents""")
def _(t: Tables):
    out = G.simple_style_features(t.texts, "text")
    return out.select("doc_id", *[F.round(c, 9).alias(c) for c in (
        "words_k", "exclamations_per_char", "questions_per_char", "capitals_per_char", "constant")])


# --- Language quality -------------------------------------------------------------------

LANGUAGE_SQL = f"""lang_base AS (
  SELECT id, title || ' ' || content AS t FROM articles),
lang_split AS (SELECT id, t, string_split_regex(t, '[.!?]+') AS p, {ws('t')} AS w FROM lang_base),
lang_parts AS (SELECT id,
  CASE WHEN len(p) < 2 THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    len(list_filter(p, lambda x: regexp_matches(x, '^{S}*\\p{{Lu}}'))) / len(p)::DOUBLE
    - CASE WHEN len(w) > 0 THEN least(0.3::DOUBLE, len(list_filter(w, lambda x: length(x) > 2 AND regexp_matches(x, '\\p{{Lu}}')
        AND NOT regexp_matches(x, '[\\p{{Ll}}\\p{{Lt}}]'))) / len(w)::DOUBLE * 2) ELSE 0.0::DOUBLE END)) END AS capitalization,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.7::DOUBLE - least(0.3::DOUBLE,
    {char_count('t', '!')} / greatest(length(t), 1)::DOUBLE * 100))) AS punctuation,
  CASE WHEN len(w) = 0 THEN 0.5::DOUBLE WHEN length(array_to_string(w, '')) / len(w)::DOUBLE BETWEEN 4 AND 7 THEN 0.8::DOUBLE
    WHEN length(array_to_string(w, '')) / len(w)::DOUBLE < 4 THEN 0.5::DOUBLE ELSE 0.6::DOUBLE END AS complexity,
  greatest(0.0::DOUBLE, 1 - ({char_count('t', '  ')} + len(regexp_extract_all(t, '{S}+[.,!?]')))
    / greatest(len(w), 1)::DOUBLE * 10) AS grammar FROM lang_split),
lang AS (SELECT *, capitalization * 0.25::DOUBLE + punctuation * 0.25::DOUBLE + complexity * 0.25::DOUBLE
  + grammar * 0.25::DOUBLE AS language_score FROM lang_parts)"""

_LANG_COLS = ["capitalization", "punctuation", "complexity", "grammar", "language_score"]


@query("language_scores", "H14 H15 H16 H17 H18", f"""
WITH {ARTICLES_SQL}, {LANGUAGE_SQL}
SELECT id, {', '.join(f'round({c}, 6) AS {c}' for c in _LANG_COLS)} FROM lang""")
def _(t: Tables):
    return G.language_scores(t.articles).select("id", *[F.round(c, 6).alias(c) for c in _LANG_COLS])


@query("language_chart", "H18 J18", f"""
WITH {ARTICLES_SQL}, {LANGUAGE_SQL}
{' UNION ALL '.join(f"SELECT id, '{c.capitalize()}' AS label, round({c} * 100, 1) AS value FROM lang" for c in _LANG_COLS[:4])}""")
def _(t: Tables):
    return G.language_chart(G.language_scores(t.articles), "id")


@query("language_score_simple", "H19", f"""
WITH t AS (SELECT doc_id, {ws_count('text')} AS n, len(list_filter(string_split(text, '.'),
    lambda x: regexp_matches(x, '{S.replace('[', '[^', 1)}'))) AS s, len(string_split(text, chr(10) || chr(10))) AS p FROM documents),
g AS (SELECT doc_id, n / greatest(s, 1)::DOUBLE AS m, n, p FROM t)
SELECT doc_id, round((CASE WHEN m BETWEEN 10 AND 30 THEN 0.85::DOUBLE WHEN (m >= 5 AND m < 10) OR (m > 30 AND m <= 50) THEN 0.70::DOUBLE ELSE 0.55::DOUBLE END
  + CASE WHEN n > 200 THEN 0.80::DOUBLE WHEN n > 100 THEN 0.70::DOUBLE ELSE 0.60::DOUBLE END
  + CASE WHEN p > 3 THEN 0.75::DOUBLE ELSE 0.65::DOUBLE END) / 3.0::DOUBLE, 6) AS language_simple FROM g""")
def _(t: Tables):
    return G.language_score_simple(t.texts, "text").select("doc_id", F.round("language_simple", 6).alias("language_simple"))


@query("tone_keywords", "H20", f"""
WITH t AS (SELECT doc_id, text, {tok('text')} AS w, {ws_count('text')} AS n FROM documents),
r AS (SELECT doc_id, n, text, least({sql_count_words('w', WORDS_A)} / greatest(1, n)::DOUBLE * 10, 0.5::DOUBLE) AS p,
  least({sql_count_words('w', WORDS_B)} / greatest(1, n)::DOUBLE * 10, 0.5::DOUBLE) AS g FROM t),
s AS (SELECT doc_id, n, text, p, g, p + g + greatest(1.0::DOUBLE - p - g, 0.0::DOUBLE) AS total FROM r),
v AS (SELECT doc_id, CASE WHEN n = 0 OR length(trim(text)) < 3 THEN 0.33::DOUBLE ELSE round(p / total, 2) END AS positive,
  CASE WHEN n = 0 OR length(trim(text)) < 3 THEN 0.33::DOUBLE ELSE round(g / total, 2) END AS negative FROM s)
SELECT doc_id, positive, negative, round(1.0::DOUBLE - positive - negative, 2) AS neutral FROM v""")
def _(t: Tables):
    return G.tone_keywords(t.texts, "text", WORDS_A, WORDS_B).select("doc_id", "positive", "negative", "neutral")


@query("truncate_at_word", "H27", """
SELECT doc_id, md5(CASE WHEN length(text) > 300 THEN CASE WHEN contains(substr(text, 1, 300), ' ')
  THEN regexp_extract(substr(text, 1, 300), '(?s)^(.*) ', 1) ELSE substr(text, 1, 300) END || '...' ELSE text END) AS cut_hash,
  length(text) > 300 AS was_cut FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", F.md5(X.truncate_at_word(F.col("text"), 300)).alias("cut_hash"),
                              (F.length("text") > 300).alias("was_cut"))


@query("first_sentences", "F6 E5", f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?]){S}+', '\\1' || chr(1), 'g'), chr(1)),
  lambda x: regexp_replace(x, '^{S}+|{S}+\\z', '', 'g')), lambda x: x <> '') AS p FROM documents),
u AS (SELECT doc_id, unnest(range(1, least(10, len(p)) + 1)) AS sentence_number, p FROM s)
SELECT doc_id, sentence_number::INTEGER AS sentence_number, md5(substr(p[sentence_number], 1, 100)) AS sentence_hash FROM u""")
def _(t: Tables):
    from pressgauge.operators.sentiment import split_sentences

    return split_sentences(t.texts, "doc_id", "text", 10, 100).select(
        "doc_id", "sentence_number", F.md5("sentence").alias("sentence_hash"))


@query("score_round", "H30", f"""
SELECT doc_id, round(n_chars / 7919.0::DOUBLE, 3) AS three_places,
  floor((n_chars % 1001) / 1000.0::DOUBLE * 100 + 0.5)::INTEGER AS percent FROM documents""")
def _(t: Tables):
    from pressgauge.functions.ladders import percent

    return t.documents.select("doc_id", F.round(F.col("n_chars") / 7919.0, 3).alias("three_places"),
                              percent(F.col("n_chars") % 1001 / 1000.0).alias("percent"))
