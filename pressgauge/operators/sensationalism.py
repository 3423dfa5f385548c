"""Sensationalism scores: z-scores over features, a keyword heuristic, a trained model."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from pressgauge.functions import ladders, lexicons as L, text as X


def feature_statistics(features: DataFrame) -> DataFrame:
    """One row: arrays of mean and population deviation in feature order."""
    return features.agg(
        F.array(*[F.avg(n) for n in L.FEATURE_NAMES]).alias("means"),
        F.array(*[F.stddev_pop(n) for n in L.FEATURE_NAMES]).alias("stds"))


def sensationalism_zscore(features: DataFrame, stats: DataFrame, by_name: bool = False,
                          steepness: float = 0.5) -> DataFrame:
    """``combined_z``, ``calmness``, ``sensationalism`` and the five largest contributions.

    Calm text scores high in z-space, so ``calmness`` is the sigmoid and
    ``sensationalism`` its complement. The statistics are one row of 56
    numbers; they are read once and enter the plan as literals, so scoring is
    a projection over the features with no join.
    """
    row = stats.first()
    negated = set(L.ZSCORE_NEGATED_BY_NAME if by_name else L.ZSCORE_NEGATED)

    def z(i: int, name: str) -> Column:
        mean, std = row.means[i], row.stds[i]
        if not std:
            return F.lit(0.0)
        raw = (F.col(name) - F.lit(float(mean))) / F.lit(float(std))
        return F.greatest(F.lit(-3.0), F.least(F.lit(3.0), -raw if i in negated else raw))

    parts = {n: F.lit(L.ZSCORE_WEIGHTS[n]) * z(i, n) for i, n in enumerate(L.FEATURE_NAMES) if n in L.ZSCORE_WEIGHTS}
    total = sum(L.ZSCORE_WEIGHTS.values())
    combined = F.lit(0.0)
    for part in parts.values():
        combined = combined + part
    contributions = F.array(*[F.struct(F.abs(F.round(v, 9)).alias("size"), F.lit(n).alias("feature"),
                                       v.alias("contribution")) for n, v in parts.items()])
    top = F.slice(F.array_sort(contributions, lambda a, b: F.when(
        a["size"] > b["size"], -1).when(a["size"] < b["size"], 1).when(
        a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0)), 1, 5)
    kept = [c for c in features.columns if c not in L.FEATURE_NAMES]
    calm = 1.0 / (1.0 + F.exp(-F.lit(steepness) * F.col("combined_z")))
    return features.select(*kept, (combined / F.lit(total)).alias("combined_z"),
                           F.transform(top, lambda s: s.dropFields("size")).alias("top_contributors")).select(
        *kept, "combined_z", calm.alias("calmness"), (1.0 - calm).alias("sensationalism"), "top_contributors")


def sensationalism_heuristic(df: DataFrame, title: str = "title", content: str = "content", base: float = 0.35,
                             words: Sequence[str] = tuple(L.SUSPICIOUS_WORDS)) -> DataFrame:
    """Keyword, punctuation, title, emotion, clickbait and hyperbole terms, each with its cap."""
    t, head = F.coalesce(F.col(content), F.lit("")), F.coalesce(F.col(title), F.lit(""))
    # The first three emotion patterns are lists of words: words are counted on the tokens, as keywords are.
    emotive = [p[3:-1].split("|") for p in L.HEURISTIC_EMOTION if re.fullmatch(r"\(\?:[\w|]+\)", p)]
    staged = df.withColumns({
        "_low": F.lower(t), "_all": X.word_tokens(t), "_hlow": F.lower(head), "_head": X.word_tokens(head),
        "_n": F.greatest(X.whitespace_words(t), F.lit(1))}).withColumn("_all", X.listed_tokens(F.col("_all"), words, *emotive))
    low, every, head_low, n = F.col("_low"), F.col("_all"), F.col("_hlow"), F.col("_n")
    cap = lambda c, top: F.least(c, F.lit(top))

    keyword_hits = X.count_listed(every, low, words)
    marks, asks = X.count_char(t, "!"), X.count_char(t, "?")
    caps_ratio = X.count_upper_letters(t) / F.greatest(F.length(t), F.lit(1))
    title_hits = X._total([(F.array_contains("_head", w) if re.fullmatch(r"\w+", w) else head_low.contains(w) & head_low.rlike(
        X.whole([w]))).cast("int") for w in words])
    title_caps = X.count_upper_letters(head) / F.greatest(F.length(head), F.lit(1))
    title_part = F.when(F.length(head) > 0, cap(title_hits * 0.1, 0.2) + cap(X.count_char(head, "!") * 0.08, 0.15)
                        + cap(X.count_char(head, "?") * 0.04, 0.08) + cap(title_caps * 2, 0.15)).otherwise(F.lit(0.0))
    emotion = F.lit(0.0)
    for entries in emotive:
        emotion = emotion + cap(X.count_listed(every, low, list(dict.fromkeys(entries))) / n * 20, 0.15)
    for pattern in L.HEURISTIC_EMOTION[len(emotive):]:
        urged = low.rlike("must|have to|need to|should")
        emotion = emotion + cap(F.when(urged, X.count_matches(low, X.whole([pattern], quoted=False))).otherwise(0) / n * 20, 0.15)
    clickbait = X._total([low.rlike(p).cast("int") for p in L.HEURISTIC_CLICKBAIT]) * 0.2
    hyperbole = cap(X._total([X.count_char(low, w) for w in L.HEURISTIC_INTENSIFIERS]) / n * 15, 0.2)
    out = staged.withColumns({
        "suspicious_keywords": keyword_hits, "exclamations": marks, "questions": asks, "caps_ratio": caps_ratio,
        "emotional_language": emotion, "clickbait_patterns": clickbait, "title_part": title_part,
        "hyperbole": hyperbole})
    score = (base + cap(F.col("suspicious_keywords") / n * 30, 0.3) + cap(F.col("exclamations") / n * 12, 0.2)
             + cap(F.col("questions") / n * 6, 0.15) + cap(F.col("caps_ratio") * 2.5, 0.2)
             + F.col("title_part") * 0.4 + cap(F.col("emotional_language"), 0.15)
             + cap(F.col("clickbait_patterns"), 0.25) + cap(F.col("hyperbole"), 0.15))
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    return out.withColumn("sensationalism", F.round(bounded, 6)).drop("_low", "_all", "_hlow", "_head", "_n", "title_part",
                                                                      "hyperbole")


def sensationalism_model(df: DataFrame, model=None) -> DataFrame:
    """Logistic of the classifier's margin; 0.5 and unavailable without a model."""
    if model is None:
        return df.withColumns({"sensationalism": F.lit(0.5), "analysis_available": F.lit(False)})
    scored = model.transform(df)
    margin = vector_to_array("rawPrediction")[1]
    return scored.withColumns({"sensationalism": 1.0 / (1.0 + F.exp(-margin)), "analysis_available": F.lit(True)})


def sensationalism_chain(df: DataFrame, stats: DataFrame | None = None, model=None, title: str = "title",
                         content: str = "content", lists=None, words: Sequence[str] = tuple(L.SUSPICIOUS_WORDS),
                         model_words: int = 20, zscore_words: int = 5) -> DataFrame:
    """``sensationalism`` and ``sensationalism_method``, row by row: the trained model, else z-scores, else the heuristic.

    The model scores texts of at least ``model_words`` words, z-scores over ``stats`` (``feature_statistics`` of a
    reference corpus) those of at least ``zscore_words``; a method that is not given, or that has no finite result for a
    row, leaves the row to the next. The 28 features are computed once and serve both. All is one projection.
    """
    from pressgauge.operators.linguistic import linguistic_features

    kept = df.columns
    staged = sensationalism_heuristic(df, title, content, words=words).withColumnRenamed("sensationalism", "_heuristic")
    keep = [*kept, *(c for c in staged.columns if c not in kept)]
    available = F.lit(False), F.lit(False)
    by_model, by_z = F.lit(None).cast("double"), F.lit(None).cast("double")
    extra = ["combined_z", "top_contributors"]
    if stats is None and model is None:
        staged = staged.withColumns({"combined_z": by_z, "top_contributors": F.lit(None).cast("array<struct<feature:string,contribution:double>>")})
    else:
        staged = linguistic_features(staged, content, lists)
        if model is not None:
            text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(content, F.lit("")))
            ready = staged.withColumn("text_full", text) if "text_full" not in staged.columns else staged
            margin = vector_to_array("rawPrediction")[1]
            staged = model.transform(ready).withColumn("_model", 1.0 / (1.0 + F.exp(-margin))).select(*keep, *L.FEATURE_NAMES, "_model")
            keep, by_model = [*keep, "_model"], F.col("_model")
            available = F.lit(True), available[1]
        if stats is not None:
            staged = sensationalism_zscore(staged, stats).withColumnRenamed("sensationalism", "_z").select(*keep, "_z", *extra)
            by_z, available = F.col("_z"), (available[0], F.lit(True))
        else:
            staged = staged.select(*keep).withColumns({"combined_z": by_z, "top_contributors": F.lit(None).cast("array<struct<feature:string,contribution:double>>")})
    n = X.whitespace_words(F.coalesce(F.col(content), F.lit("")))
    good = lambda c: c.isNotNull() & ~F.isnan(c)
    method = (F.when(available[0] & (n >= model_words) & good(by_model), "model")
              .when(available[1] & (n >= zscore_words) & good(by_z), "z_score").otherwise("heuristic"))
    out = staged.withColumn("sensationalism_method", method)
    chosen = (F.when(F.col("sensationalism_method") == "model", by_model)
              .when(F.col("sensationalism_method") == "z_score", by_z).otherwise(F.col("_heuristic")))
    return out.withColumn("sensationalism", chosen).drop("_heuristic", "_model", "_z")


def predict_batch(df: DataFrame, model=None) -> DataFrame:
    """Score and interpretation of many texts."""
    out = sensationalism_model(df, model)
    return out.withColumn("interpretation", ladders.interpret_sensationalism(F.col("sensationalism")))
