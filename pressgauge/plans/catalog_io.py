"""Queries that write the tables' rows with the library's sinks and read them back with its sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgauge.plans import training as P
from pressgauge.plans.catalog_store import _scratch
from pressgauge.plans.registry import ARTICLES_SQL, CORPUS_SQL, STORE_SQL, Tables, query
from pressgauge.sources import articles as A, training as S

_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def corpora(t: Tables) -> list[S.SourceSpec]:
    """Two corpora as CSV files: English in UTF-8 with a label column, French in Latin-1 with a fixed label; a third is missing."""
    folder = _scratch(t)
    rows = t.documents.withColumn("title", F.concat(F.lit("No. "), F.col("doc_id").cast("string")))
    rows = rows.join(t.labels.select("doc_id", (1 - F.col("quality")).alias("label")), "doc_id")
    rows.where("lang = 'en'").select("title", "text", "label").write.options(**_CSV).csv(f"{folder}/english")
    rows.where("lang = 'fr'").select("title", "text").write.options(**_CSV, encoding="ISO-8859-1").csv(f"{folder}/french")
    return [S.SourceSpec(f"{folder}/english", "english", None, "title_text_label"), S.SourceSpec(f"{folder}/french", "french", 1),
            S.SourceSpec(f"{folder}/none", "none", 0)]


_CORPORA = """c AS (SELECT doc_id, 'No. ' || doc_id AS title, text, 1 - quality AS label, CASE lang WHEN 'en' THEN 'english' ELSE 'french' END AS source
  FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr'))"""


@query("read_sources", "A1 A2", f"""
WITH {_CORPORA} SELECT title, md5(text) AS text_hash, source, CASE source WHEN 'english' THEN label::VARCHAR END AS label,
  CASE source WHEN 'french' THEN 1 END AS fixed_label FROM c""")
def _(t: Tables):
    out = S.read_sources(t.spark, corpora(t))
    return out.select("title", F.md5("text").alias("text_hash"), "source", "label", "fixed_label")


@query("validate_sources", "A3", f"""
WITH {_CORPORA} SELECT source, count(*) AS rows, count(*) FILTER (text = '') AS without_text, 0::BIGINT AS without_title,
  count(*) > count(*) FILTER (text = '') AS is_valid FROM c GROUP BY source""")
def _(t: Tables):
    return S.validate_sources(S.read_sources(t.spark, corpora(t)))


@query("load_articles", "A5", """
SELECT md5(text) AS content_hash, 'No. ' || doc_id AS title FROM documents""")
def _(t: Tables):
    path = f"{_scratch(t)}/scraped"
    row = {c: F.lit(None).cast("string") for c in A.SCRAPED.names}
    named = t.documents.select(*((F.concat(F.lit("No. "), F.col("doc_id").cast("string")) if c == "title" else F.col("text") if c == "content"
                                  else v).alias(c) for c, v in row.items()))
    named.write.options(**_CSV).csv(path)
    return A.load_articles(t.spark, path).select(F.md5("content").alias("content_hash"), "title")


@query("write_clean", "A6", f"""
WITH {CORPUS_SQL} SELECT 'parquet' AS format, md5(text_full) AS text_hash, label, source, text_length, word_count FROM corpus
UNION ALL SELECT 'csv', md5(text_full), label, source, text_length, word_count FROM corpus""")
def _(t: Tables):
    folder = _scratch(t)
    A.write_clean(t.corpus, f"{folder}/parquet")
    A.write_clean(t.corpus, f"{folder}/csv", "csv")
    read = {"parquet": t.spark.read.parquet(f"{folder}/parquet"),
            "csv": t.spark.read.options(**_CSV, multiLine=True).csv(f"{folder}/csv")}
    shown = [df.select(F.lit(name).alias("format"), F.md5("text_full").alias("text_hash"), F.col("label").cast("int").alias("label"), "source",
                       F.col("text_length").cast("long").alias("text_length"), F.col("word_count").cast("long").alias("word_count"))
             for name, df in read.items()]
    return shown[0].unionByName(shown[1])


@query("append_articles", "A9 A20", f"""
WITH {ARTICLES_SQL} SELECT id, 'www.' || source || '.com' AS domain, md5(content) AS content_hash FROM articles""")
def _(t: Tables):
    """Three appends by domain, then a compaction; the store reads as one."""
    path = f"{_scratch(t)}/by_domain"
    rows = t.articles.select("id", F.concat(F.lit("www."), "source", F.lit(".com")).alias("domain"), "content")
    for part in range(3):
        A.append_articles(rows.where(F.col("id") % 3 == part), path)
    A.compact_articles(t.spark, path)
    return t.spark.read.parquet(path).select("id", "domain", F.md5("content").alias("content_hash"))


@query("training_files", "A7 A8 A19 K12", """
WITH c AS (SELECT * FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr') AND length(text) > 0)
SELECT output, true AS present, true AS is_complete, n AS row_count FROM (SELECT unnest(['cleaned', 'features']) AS output, (SELECT count(*) FROM c) AS n)
UNION ALL SELECT 'statistics/source_distribution', true, true, (SELECT count(DISTINCT lang) FROM c)
UNION ALL SELECT 'model', false, false, NULL""")
def _(t: Tables):
    """Raw files to cleaned rows, statistics and features, and what of it is there; no model was asked for."""
    folder = f"{_scratch(t)}/training"
    P.training_pipeline(t.spark, corpora(t), folder, skip_training=True)
    return A.output_inventory(t.spark, folder, ["cleaned", "features", "statistics/source_distribution", "model"])


@query("export_csv_file", "A18", f"""
WITH {STORE_SQL} SELECT title AS "Title", source AS "Source", url AS "URL",
  floor(overall_score * 100 + 0.5)::INTEGER AS "Overall Score", floor(credibility_score * 100 + 0.5)::INTEGER AS "Credibility",
  floor(language_score * 100 + 0.5)::INTEGER AS "Language", floor(cross_check_score * 100 + 0.5)::INTEGER AS "Cross-Check",
  substr(analyzed_at, 1, 10) AS "Date" FROM store""")
def _(t: Tables):
    path = f"{_scratch(t)}/export"
    A.export_articles_csv(t.store, path)
    back = t.spark.read.options(**_CSV, multiLine=True).csv(path)
    numbers = ("Overall Score", "Credibility", "Language", "Cross-Check")
    return back.select(*(F.col(c).cast("int").alias(c) if c in numbers else F.coalesce(c, F.lit("")).alias(c) for c in back.columns))


