"""The operators as registered queries: (spark, folder) -> DataFrame, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query under ``name``."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op10_token_output")
def token_output(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents, written as shards and read back."""
    from pressgauge.llm.rans import decode_documents, write_token_ids

    return decode_documents(write_token_ids(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json")))


@register("op9_simhash")
def simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    from pressgauge.llm.simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@register("op4_packing")
def packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed along the curve into sequences of 4096 ids."""
    from pressgauge.llm.packing import pack

    return pack(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


@register("op2_toxicity")
def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    from pressgauge.llm.toxicity import judge

    return judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op7_decontamination")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and its edit distance."""
    from pressgauge.llm.decontam import contaminated

    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register("op1_secrets")
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document."""
    from pressgauge.llm.secret_scan import findings

    return findings(table(spark, folder, "documents"))


def _url_sql() -> str:
    from pressgauge.llm.urlmodel import oracle_sql

    return oracle_sql()


@register("op8_url_filter", _url_sql())
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's URL."""
    from pressgauge.llm.urlmodel import judge

    return judge(table(spark, folder, "pages"))


TOP_SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
          FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""


@register("op5_exact_search", TOP_SQL)
def exact_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best matches of every hundredth vector."""
    from pressgauge.llm.vafile import top_k

    return top_k(table(spark, folder, "embeddings"))


@register("op6_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    from pressgauge.llm.langid import identify

    return identify(table(spark, folder, "documents"))


CHAT_SQL = """
WITH rolled AS (SELECT conv_id, row_number() OVER w AS n, lead(turn) OVER w IS NULL AS whole,
                       string_agg(coalesce(role, chr(29)) || chr(31) || coalesce(text, chr(29)), chr(30)) OVER w AS said,
                       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '') OVER w AS rendered
                FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
                WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ends AS (SELECT said, min(conv_id) AS conv_id, any_value(n) AS n_turns, any_value(rendered) AS rendered FROM rolled WHERE whole GROUP BY said)
SELECT conv_id, n_turns, rendered FROM ends WHERE said NOT IN (SELECT said FROM rolled WHERE NOT whole)
"""


@register("op3_chat_format", CHAT_SQL)
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Maximal conversations, rendered."""
    from pressgauge.llm.snapshots import render

    return render(table(spark, folder, "conversations"))


def _merkle_sql() -> str:
    from pressgauge.llm.merkle import SQL as sql

    return sql


@register("op11_merkle_manifest", _merkle_sql())
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, subroot, root and climbed proof of every document."""
    from pressgauge.llm.merkle import manifest

    return manifest(table(spark, folder, "documents"))


def _phrase_sql() -> str:
    from pressgauge.llm.collocations import SQL as sql

    return sql


@register("op13_collocations", _phrase_sql())
def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The best phrases of every language."""
    from pressgauge.llm.collocations import collocations

    return collocations(table(spark, folder, "documents"))


@register("op12_quality")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    from pressgauge.llm.quality import judge

    return judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
