"""Registry of runnable queries over the fixture tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressgauge.session import spread


@dataclass
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[["Tables"], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query; ``covers`` lists the inventory rows it exercises."""
    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, tuple(covers.split()), fn, sql)
        return fn
    return wrap


class Tables:
    """The fixture tables of one folder, and the article views derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("documents", "labels", "pages", "embeddings", "benchmark"):
            return self.read(name)
        raise AttributeError(name)

    @property
    def texts(self) -> DataFrame:
        """Documents with enough splits for CPU-bound text work."""
        return spread(self.documents)

    @property
    def html_pages(self) -> DataFrame:
        """Pages with enough splits for parsing."""
        return spread(self.pages)

    @property
    def articles(self) -> DataFrame:
        """``id, title, content, source, lang, n_chars, url`` from documents."""
        return article_view(self.texts)

    @property
    def requests(self) -> DataFrame:
        """Benchmark items as articles."""
        return self.benchmark.select(
            F.col("item_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("content"), F.concat(F.lit("ref"), (F.col("item_id") % 7).cast("string")).alias("source"),
            F.concat(F.lit("https://www.src"), (F.col("item_id") % 20).cast("string"), F.lit(".com/ref/"),
                     F.col("item_id").cast("string")).alias("url"))

    @property
    def corpus(self) -> DataFrame:
        """Labelled documents in the clean layout, keyed; ``label`` 1 is fake."""
        docs = self.texts.withColumn("title", F.substring_index("text", "\n", 1))
        labelled = docs.join(self.labels.select("doc_id", (1 - F.col("quality")).alias("label")), "doc_id")
        from pressgauge.operators.cleaning import clean_and_enrich

        return clean_and_enrich(labelled, F.col("source"), F.col("label"), keep=["doc_id"])

    @property
    def store(self) -> DataFrame:
        """Analysed articles: documents with scores derived from their own columns."""
        return self.articles.select(
            "id", "title", "content", "source", "url", *STORE_SCORES(),
            F.when(F.col("lang") == "en", "scraped_news").when(F.col("lang") == "fr", "user_article")
            .otherwise("opinion").alias("article_type"),
            F.concat(F.lit("2024-0"), (F.col("n_chars") % 9 + 1).cast("string"), F.lit("-15")).alias("analyzed_at"))


def STORE_SCORES() -> list[Column]:
    pick = lambda m, s: (F.col("n_chars") * s % m / F.lit(float(m - 1)))
    return [F.round(pick(101, 7), 3).alias("credibility_score"), F.round(pick(97, 5), 3).alias("overall_score"),
            F.round(pick(89, 3), 3).alias("language_score"), F.round(pick(83, 11), 3).alias("cross_check_score")]


def article_view(docs: DataFrame) -> DataFrame:
    url = F.concat(
        F.lit("https://"), F.when(F.col("lang") == "en", "www.").otherwise(F.concat("lang", F.lit("."))),
        F.col("source"), F.lit(".com/"),
        F.when(F.col("n_chars") % 3 == 0, "news/2024/05/17/").when(F.col("n_chars") % 3 == 1, "article/").otherwise("b/"),
        F.col("doc_id").cast("string"))
    return docs.select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"),
                       F.col("text").alias("content"), "source", "lang", "n_chars", url.alias("url"))


# --- SQL fragments ---------------------------------------------------------------

W = r"[\p{L}\p{N}_]"
S = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NS = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"

ARTICLES_SQL = """articles AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS content, source, lang, n_chars,
    'https://' || CASE WHEN lang = 'en' THEN 'www.' ELSE lang || '.' END || source || '.com/' ||
    CASE n_chars % 3 WHEN 0 THEN 'news/2024/05/17/' WHEN 1 THEN 'article/' ELSE 'b/' END || doc_id AS url
  FROM documents)"""

REQUESTS_SQL = """requests AS (
  SELECT item_id AS id, split_part(text, chr(10), 1) AS title, text AS content, 'ref' || (item_id % 7) AS source,
    'https://www.src' || (item_id % 20) || '.com/ref/' || item_id AS url
  FROM benchmark)"""

CORPUS_SQL = """corpus AS (
  SELECT doc_id, text_full, label, source, length(text_full) AS text_length,
    len(string_split(text_full, ' ')) AS word_count
  FROM (SELECT d.doc_id, split_part(d.text, chr(10), 1) || chr(10) || chr(10) || d.text AS text_full,
          1 - l.quality AS label, d.source
        FROM documents d JOIN labels l USING (doc_id)))"""

STORE_SQL = ARTICLES_SQL + """, store AS (
  SELECT id, title, content, source, url,
    round((n_chars * 7 % 101) / 100.0::DOUBLE, 3) AS credibility_score,
    round((n_chars * 5 % 97) / 96.0::DOUBLE, 3) AS overall_score,
    round((n_chars * 3 % 89) / 88.0::DOUBLE, 3) AS language_score,
    round((n_chars * 11 % 83) / 82.0::DOUBLE, 3) AS cross_check_score,
    CASE lang WHEN 'en' THEN 'scraped_news' WHEN 'fr' THEN 'user_article' ELSE 'opinion' END AS article_type,
    '2024-0' || (n_chars % 9 + 1) || '-15' AS analyzed_at
  FROM articles)"""


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def tok(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{W}+')"


def ws(text: str) -> str:
    return f"regexp_extract_all({text}, '{NS}+')"


def ws_count(text: str) -> str:
    return f"len({ws(text)})"


def char_count(text: str, needle: str) -> str:
    n = needle.replace("'", "''")
    return f"((length({text}) - length(replace({text}, '{n}', ''))) // {len(needle)})"


def sql_count_words(tokens: str, entries) -> str:
    """Whole-word matches over a list of plain words, repeats counted."""
    return "(" + " + ".join(f"len(list_filter({tokens}, lambda x: x = '{e}'))" for e in entries) + ")"


def sql_count_phrases(text: str, phrases) -> str:
    """Matches of an alternation of phrases. Non-word characters are doubled so that
    two matches may share a neighbour."""
    doubled = f"regexp_replace(lower({text}), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"
    alt = "|".join(p.replace(" ", "  ") for p in phrases)
    return f"len(regexp_extract_all({doubled}, '(?:^|[^\\p{{L}}\\p{{N}}_])(?:{alt})(?:$|[^\\p{{L}}\\p{{N}}_])'))"


def domain_sql(url: str) -> str:
    return (f"lower(replace(regexp_extract({url}, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*://)?([^/?#]*)', 1), 'www.', ''))")


def host_sql(url: str) -> str:
    return f"regexp_extract({url}, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*://)?([^/?#]*)', 1)"


def path_sql(url: str) -> str:
    return f"regexp_extract({url}, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*://)?[^/?#]*([^?#]*)', 1)"


def clean_url_sql(url: str) -> str:
    return f"rtrim(regexp_replace({url}, '[?#].*$', ''), '/')"


def base_sql(domain: str) -> str:
    return f"array_to_string(list_slice(string_split({domain}, '.'), -2, -1), '.')"


def contains_any_sql(text: str, needles) -> str:
    return "(" + " OR ".join(f"contains({text}, '{n}')" for n in needles) + ")"
