"""Composite score, per-article analysis row and chart tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressgauge.functions import ladders, urls as U

# Equal weights of the four components (fixed values).
WEIGHTS = {"language": 0.25, "credibility": 0.25, "crosscheck": 0.25, "sensationalism": 0.25}


def overall_score(language: Column, credibility: Column, crosscheck: Column, sensationalism: Column,
                  invert: bool = True) -> Column:
    """Weighted sum; sensational text lowers the score unless ``invert`` is off."""
    quality = 1.0 - sensationalism if invert else sensationalism
    return (language * WEIGHTS["language"] + credibility * WEIGHTS["credibility"]
            + crosscheck * WEIGHTS["crosscheck"] + quality * WEIGHTS["sensationalism"])


def unit(score: Column, digits: int = 3) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), digits)


def chart_rows(df: DataFrame, key: str, chart: str, values: dict[str, Column]) -> DataFrame:
    """Long rows ``key, chart, label, value`` from named columns."""
    rows = [F.struct(F.lit(label).alias("label"), value.cast("double").alias("value"))
            for label, value in values.items()]
    return df.select(key, F.lit(chart).alias("chart"), F.inline_outer(F.array(*rows)))


def score_columns(df: DataFrame) -> DataFrame:
    """Rounded scores, overall score, verdict and bands from the unrounded parts.

    Expects ``language_score, credibility, cross_check_score, sensationalism``.
    The parts are rounded to three places first, as they are stored.
    """
    parts = df.withColumns({
        "language_score": unit(F.col("language_score")), "credibility_score": unit(F.col("credibility")),
        "cross_check_score": unit(F.col("cross_check_score"))})
    overall = overall_score(F.col("language_score"), F.col("credibility_score"), F.col("cross_check_score"),
                            F.col("sensationalism"))
    return parts.withColumn("overall_score", F.round(overall, 3)).withColumns({
        "verdict": ladders.verdict(F.col("overall_score")),
        "sensationalism_level": ladders.interpret_sensationalism(F.col("sensationalism"))["level"],
        "band": ladders.credibility_band(F.col("credibility_score"))})


def article_key(url: Column) -> Column:
    return U.request_id(url)
