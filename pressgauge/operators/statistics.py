"""Corpus and store statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pressgauge.functions import text as X
from pressgauge.operators.ranking import positions
from pressgauge.operators.lexicon import word_mask
from pressgauge.session import cut_lineage, small_side


def label_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("count")).orderBy("label")


def source_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "source")


def label_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source", "label").agg(F.count(F.lit(1)).alias("count")).orderBy("source", "label")


def _text_aggregates() -> list[Column]:
    out = []
    for column, short in (("text_length", "text_length"), ("word_count", "word_count")):
        out += [F.avg(column).alias(f"avg_{short}"), F.min(column).alias(f"min_{short}"),
                F.max(column).alias(f"max_{short}"), F.stddev_samp(column).alias(f"stddev_{short}")]
    return out


def text_statistics(df: DataFrame) -> DataFrame:
    return df.agg(*_text_aggregates())


def data_summary(df: DataFrame) -> DataFrame:
    """Total, per-label and per-source counts with shares, and text statistics, in one pass."""
    grouped = cut_lineage(df.groupingSets([["source"], ["label"], []], "source", "label").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), *_text_aggregates()))
    section = F.when(F.col("gid") == 1, "source").when(F.col("gid") == 2, "label").otherwise("total")
    # One number: the share base.
    whole = grouped.where("gid = 3").first()
    total = F.lit(whole["n"] if whole else None).cast("long")
    return grouped.select(
        section.alias("section"),
        F.when(F.col("gid") == 1, F.col("source")).when(F.col("gid") == 2, F.col("label").cast("string"))
        .otherwise("all").alias("item"),
        F.col("n").alias("count"),
        (F.col("n") / total * 100).alias("percent"),
        F.col("avg_text_length"), F.col("avg_word_count"),
    )


def perform_aggregations(df: DataFrame) -> dict[str, DataFrame]:
    """The four statistics tables of a cleaned corpus."""
    return {
        "label_distribution": label_distribution(df),
        "source_distribution": source_distribution(df),
        "text_statistics": text_statistics(df),
        "label_by_source": label_by_source(df),
    }


def ranked_sources(df: DataFrame) -> DataFrame:
    """Sources by count with their share of all rows. Any number of sources is sorted and numbered by partition."""
    counts = cut_lineage(df.groupBy("source").agg(F.count(F.lit(1)).alias("count")))
    total = counts.agg(F.sum("count")).first()[0]
    shares = counts.withColumn("percent", F.col("count") / F.lit(total).cast("long") * 100)
    ranked = positions(shares.orderBy(F.desc("count"), "source"))
    return ranked.withColumn("position", F.col("position").cast("int"))


def profile_source(df: DataFrame, label: str | None = None) -> DataFrame:
    """One row per column: type, rows, nulls, smallest sample value, distinct labels."""
    names = df.columns
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(names):
        aggregates += [F.count_if(F.col(name).isNull()).alias(f"n{i}"),
                       F.min(F.col(name).cast("string")).alias(f"s{i}")]
    if label:
        aggregates.append(F.count_distinct(F.col(label)).alias("labels"))
    one = df.agg(*aggregates)
    types = dict(df.dtypes)
    rows = [F.struct(F.lit(name).alias("column_name"), F.lit(types[name]).alias("data_type"),
                     F.col("rows").alias("row_count"), F.col(f"n{i}").alias("null_count"),
                     F.col(f"s{i}").alias("sample_value"),
                     (F.col("labels") if label == name else F.lit(None).cast("long")).alias("distinct_labels"))
            for i, name in enumerate(names)]
    return one.select(F.inline_outer(F.array(*rows)))


def store_stats(df: DataFrame) -> DataFrame:
    """Stored articles by credibility band."""
    c = F.col("credibility_score")
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(c >= 0.7).alias("high"),
                  F.count_if((c >= 0.4) & (c < 0.7)).alias("medium"), F.count_if(c < 0.4).alias("low"))


def store_stats_overall(df: DataFrame) -> DataFrame:
    """Stored articles by overall score; the rest is medium."""
    o = F.col("overall_score")
    total, high, low = F.count(F.lit(1)), F.count_if(o >= 0.70), F.count_if(o < 0.50)
    return df.agg(total.alias("total"), high.alias("high"), low.alias("low"),
                  (total - high - low).alias("medium"))


def type_counts(df: DataFrame) -> DataFrame:
    """Articles and non-empty contents per article type."""
    return df.groupBy("article_type").agg(
        F.count(F.lit(1)).alias("articles"),
        F.count_if(F.coalesce(F.col("content") != "", F.lit(False))).alias("with_content"))


def phrase_counts(df: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """Substring occurrences of every phrase per label, with the label's document count."""
    lowered = F.lower(F.col("text_full"))
    sums = [F.sum(X.count_char(lowered, p)).alias(f"p{i}") for i, p in enumerate(phrases)]
    per_label = df.groupBy("label").agg(F.count(F.lit(1)).alias("documents"), *sums)
    rows = [F.struct(F.lit(p).alias("phrase"), F.col(f"p{i}").alias("occurrences"))
            for i, p in enumerate(phrases)]
    return per_label.select("label", "documents", F.inline_outer(F.array(*rows)))


def phrase_lift(df: DataFrame, phrases: Sequence[str], top: int | None = None) -> DataFrame:
    """How much more often a phrase occurs per fake than per real document.

    A phrase without real occurrences has infinite lift; one without any is left out. ``top`` limits the report.
    """
    per = phrase_counts(df, phrases).groupBy("phrase").agg(
        F.max(F.when(F.col("label") == 1, F.col("occurrences") / F.col("documents"))).alias("fake_rate"),
        F.max(F.when(F.col("label") == 0, F.col("occurrences") / F.col("documents"))).alias("real_rate"))
    lift = F.when(F.col("real_rate") > 0, F.col("fake_rate") / F.col("real_rate")).when(
        F.col("fake_rate") > 0, F.lit(float("inf")))
    ranked = per.withColumn("lift", lift).filter(F.col("lift").isNotNull()).orderBy(F.desc("lift"), "phrase")
    return ranked if top is None else ranked.limit(top)


def with_word_frequency(df: DataFrame, text: str, credible: Sequence[str], suspicious: Sequence[str]) -> DataFrame:
    """Add word totals and the counts of listed words.

    Works inside the row: nothing is exploded or shuffled. Listed phrases that
    no single token can equal are counted in ``listed_phrases``.
    """
    single = lambda words: [w for w in words if w.replace("_", "a").isalnum()]
    phrases = [w for w in [*credible, *suspicious] if not single([w])]

    def counts(hits: Column) -> Column:
        return F.map_from_entries(F.transform(
            F.array_sort(F.array_distinct(hits)),
            lambda w: F.struct(w, F.size(F.filter(hits, lambda x: x == w)))))

    tokens = F.col("_tokens")
    listed = lambda words: F.filter(tokens, lambda w: w.isin(*words))
    return df.withColumn("_tokens", X.word_tokens(F.col(text))).withColumns({
        "total_words": F.size(tokens),
        "unique_words": F.size(F.array_distinct(tokens)),
        "_credible": listed(single(credible)),
        "_suspicious": listed(single(suspicious)),
        "listed_phrases": X.count_words(F.col(text), phrases) if phrases else F.lit(0),
    }).withColumns({
        "credible_words": counts(F.col("_credible")), "suspicious_words": counts(F.col("_suspicious")),
    }).drop("_tokens", "_credible", "_suspicious")


def word_frequency(df: DataFrame, key: str, text: str, credible: Sequence[str],
                   suspicious: Sequence[str]) -> DataFrame:
    """Per document: word totals and listed-word counts only."""
    out = with_word_frequency(df.select(key, text), text, credible, suspicious)
    return out.select(key, "total_words", "unique_words", "credible_words", "suspicious_words", "listed_phrases")


def lexicon_matches(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Occurrences of lexicon words per document and category.

    A mask of the lexicon's words leaves few other tokens to explode. All tokens of one document sit in one partition, so
    the partial aggregate already folds them before the shuffle.
    """
    lex = small_side(lexicon)
    tokens = df.select(key, F.explode_outer(F.filter(X.word_tokens(F.col(text)), word_mask(lex, "word"))).alias("word"))
    return tokens.where("word IS NOT NULL").join(lex, "word").groupBy(key, "category").agg(F.count(F.lit(1)).alias("hits"))
