"""Cleaning of labelled corpora and of ingested articles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pressgauge.functions import text as X, urls as U


def fill_missing(df: DataFrame) -> DataFrame:
    """Null title or text becomes empty; a corpus without titles gets empty ones."""
    if "title" not in df.columns:
        df = df.withColumn("title", F.lit(""))
    return df.fillna("", subset=["title", "text"])


def normalize_label(label: Column) -> Column:
    """``true`` marks real news (0) and ``false`` fake news (1); anything else is null."""
    value = F.lower(F.trim(label.cast("string")))
    return F.when(value.isin("true", "1", "1.0"), 0).when(value.isin("false", "0", "0.0"), 1)


def text_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "text_length": F.length("text_full"),
        "word_count": X.single_space_words(F.col("text_full")),
    })


def drop_invalid(df: DataFrame) -> DataFrame:
    return df.filter(
        F.col("text_full").isNotNull() & ~F.col("text_full").isin("", "\n\n") & F.col("label").isNotNull())


def clean_and_enrich(df: DataFrame, source: str | Column, label: int | Column | None = None,
                     use_title: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """One corpus in the five-column clean layout.

    ``label`` is a fixed value, an already numeric column, or None to read
    the corpus's own true/false column. ``keep`` carries key columns through.
    """
    df = fill_missing(df)
    title = F.col("title") if use_title else F.lit("")
    if label is None:
        label_col = normalize_label(F.col("label"))
    else:
        label_col = label if isinstance(label, Column) else F.lit(label)
    source_col = source if isinstance(source, Column) else F.lit(source)
    out = df.select(
        *keep,
        X.text_full(title, F.col("text")).alias("text_full"),
        label_col.cast("int").alias("label"),
        source_col.alias("source"),
    )
    out = drop_invalid(out)
    return text_metrics(out).select(*keep, "text_full", "label", "source", "text_length", "word_count")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all corpora; an empty list is an error."""
    if not frames:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b), frames)


def attach_labels(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Labelled documents only. The join is on a unique key, so it cannot skew."""
    return docs.join(labels, key)


def combine_articles(existing: DataFrame | None, new: DataFrame | None) -> DataFrame:
    """Existing and new articles; either may be missing. ``batch`` is 0 or 1."""
    parts = [df.withColumn("batch", F.lit(i)) for i, df in enumerate((existing, new)) if df is not None]
    if not parts:
        raise ValueError("neither existing nor new articles given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def clean_articles(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Keys, trimmed texts and domain of scraped articles; rows untouched otherwise."""
    return df.select(
        U.article_id(F.col("source_url")).alias("id"),
        F.trim("title").alias("title"),
        F.trim("content").alias("content"),
        U.clean_url(F.col("source_url")).alias("source_url"),
        "published_at",
        U.domain_raw(F.col("source_url")).alias("domain"),
        *keep,
    )


def valid_articles(df: DataFrame, min_len: int = 50) -> DataFrame:
    return df.filter(F.col("title").isNotNull() & F.col("content").isNotNull()
                     & (F.length("content") > min_len))


def dedup_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Keep the first row per key by ``order``.

    Written as an aggregate, not a window: each input partition keeps one row
    per key before the shuffle, so a key that holds a third of all rows sends
    one row per partition instead of all of them to one task.
    """
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(key).agg(best.alias("_row")).select(key, "_row.*").select(*df.columns)


def dedup_by_url(df: DataFrame) -> DataFrame:
    """First article per cleaned URL: earlier batch, then date, then text."""
    return dedup_first(df, "source_url", ["batch", "published_at", "title", "content"])


def dedup_report(df: DataFrame, key: str = "source_url") -> DataFrame:
    """Rows before and after URL deduplication, in one pass.

    The key counts are pre-aggregated, which spreads a hot key's rows.
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("rows_removed"),
    )


def filter_credible(df: DataFrame, domains: Sequence[str]) -> DataFrame:
    return df.filter(U.credible_by_substring(F.col("domain"), domains))


def needs_embedding(df: DataFrame, min_len: int = 100) -> DataFrame:
    return df.filter((F.col("article_type") == "scraped_news")
                     & (F.col("embedding").isNull() | (F.size("embedding") == 0))
                     & (F.length("content") >= min_len))


def candidate_filter(df: DataFrame, exclude_url: str = "", min_len: int = 100) -> DataFrame:
    """Stored articles an article may be compared with."""
    out = df.filter((F.col("article_type") == "scraped_news")
                    & F.coalesce(F.col("source_url") != "", F.lit(False))
                    & (F.length(F.trim("content")) >= min_len))
    return out.filter(~F.col("source_url").contains(exclude_url)) if exclude_url else out


def unseen(batch: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``seen``.

    The large seen side is first cut to the batch's keys by a semi join, in
    which the small batch can be the broadcast side; an anti join alone could
    only build on the seen side and would shuffle or broadcast all of it.
    """
    hits = seen.select(key).join(batch.select(key).distinct(), key, "left_semi")
    return batch.join(hits, key, "left_anti")


def exclude_seen(df: DataFrame, seen: DataFrame, key: str = "source_url") -> DataFrame:
    """Rows whose cleaned URL is not among the seen ones."""
    keyed = lambda d: d.withColumn("_seen", U.clean_url(F.col(key)))
    return unseen(keyed(df), keyed(seen), "_seen").drop("_seen").select(*df.columns)


def credible_first(df: DataFrame, reliable: str = "is_reliable", title: str = "title",
                   key: str = "id") -> DataFrame:
    """Reliable sources first, longer titles first within them."""
    return df.orderBy(F.col(reliable).desc(), F.length(title).desc(), F.col(key))
