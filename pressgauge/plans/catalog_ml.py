"""Queries over training, evaluation and experiments."""

from __future__ import annotations

import uuid
from functools import partial, reduce

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from pressgauge.functions import lexicons as L
from pressgauge.operators import experiments as E, linguistic as G, ml as M, sensationalism as Z
from pressgauge.plans.catalog_corpus import stand_in_lists
from pressgauge.plans.catalog_store import _scratch
from pressgauge.plans.registry import CORPUS_SQL, Tables, query
from pressgauge.session import cut_lineage

def features(t: Tables):
    """Labelled corpus with the 28 features; the clean columns' own counts are left out."""
    return G.linguistic_features(t.corpus.drop("text_length", "word_count"), "text_full", stand_in_lists())


def trained(t: Tables) -> M.Trained:
    return M.train(features(t), M.feature_pipeline(M.linear_svc()))


@query("tfidf_hashed", "I4", f"""
WITH {CORPUS_SQL}, w AS (SELECT doc_id, string_split_regex(lower(text_full), '[\t-\r ]') AS raw FROM corpus),
t AS (SELECT doc_id, CASE WHEN len(trimmed) = 0 THEN [''] ELSE trimmed END AS words
  FROM (SELECT doc_id, list_slice(raw, 1, coalesce(list_max(list_transform(range(1, len(raw) + 1), lambda i: CASE WHEN raw[i] <> '' THEN i END)), 0)) AS trimmed FROM w))
SELECT doc_id, len(words)::INTEGER AS words, true AS no_more_kept, true AS counted, true AS weighed FROM t""")
def _(t: Tables):
    df = t.corpus
    out = Pipeline(stages=M.tfidf_stages()).fit(df).transform(df)
    raw, weights = vector_to_array("raw_features"), vector_to_array("tfidf_features")
    # The hash is Spark's own: a twin can state that every kept word is counted, and that weights stand where counts do.
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    stray = F.exists(F.zip_with(raw, weights, lambda c, w: (c == 0) & (w != 0)), lambda x: x)
    return out.select("doc_id", F.size("words").alias("words"), (F.size("filtered_words") <= F.size("words")).alias("no_more_kept"),
                      (total == F.size("filtered_words")).alias("counted"), (~stray).alias("weighed"))


@query("tfidf_vocabulary_vectors", "I5")
def _(t: Tables):
    df = t.corpus.select("doc_id", "text_full")
    out = M.fit_vocabulary(df).transform(df)
    # Only what a sparse vector holds is looked at, not its 50,000 places.
    v = F.unwrap_udt("tfidf_features")["values"]
    return out.select("doc_id", F.size(F.filter(v, lambda x: x != 0)).alias("terms"),
                      F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), 6).alias("length"))


@query("scale_features", "K1", "SELECT " + ", ".join(
    [f"0.0::DOUBLE AS mean_{n}" for n in L.FEATURE_NAMES] + [f"true AS std_{n}" for n in L.FEATURE_NAMES]))
def _(t: Tables):
    df = features(t)
    out = Pipeline(stages=M.scale_stages()).fit(df).transform(df)
    v = vector_to_array("linguistic_features_scaled")
    one = lambda i: F.get(v, F.lit(i))
    # Deviation 1, or 0 where the feature is the same in all rows.
    spread = lambda i, n: F.abs(F.stddev_samp(one(i)) - F.when(F.max(n) > F.min(n), 1.0).otherwise(0.0)) < 1e-6
    return out.agg(*[(F.round(F.avg(one(i)), 6) + 0.0).alias(f"mean_{n}") for i, n in enumerate(L.FEATURE_NAMES)],
                   *[spread(i, n).alias(f"std_{n}") for i, n in enumerate(L.FEATURE_NAMES)])


@query("combine_features", "K2 D7", f"""
WITH {CORPUS_SQL} SELECT count(*) AS rows, {5000 + len(L.FEATURE_NAMES)} AS vector_size FROM corpus""")
def _(t: Tables):
    return M.feature_summary(M.split_and_prepared(features(t)))


@query("train_svc", "K3 K6 D8")
def _(t: Tables):
    m = trained(t)
    return M.evaluate(m.model.transform(m.test))


@query("train_others", "K5 K6")
def _(t: Tables):
    data = M.split_and_prepared(features(t))

    def run(name, make):
        model = M.fitted(make(), data.filter(~F.col("is_test")))
        return M.evaluate(model.transform(data.filter("is_test"))).withColumn("model_name", F.lit(name))

    made = (("logistic", M.logistic), ("forest", M.forest), ("naive_bayes", M.gaussian_bayes))
    return reduce(DataFrame.unionByName, M.in_parallel([partial(run, *m) for m in made]))


@query("confusion_and_metrics", "D8 K7", f"""
WITH {CORPUS_SQL}, p AS (SELECT label, CASE WHEN text_length % 5 = 0 THEN 1 - label ELSE label END AS prediction FROM corpus),
c AS (SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM p)
SELECT tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, round(tp / (tp + fp)::DOUBLE, 6) AS "precision",
  round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1_score FROM c""")
def _(t: Tables):
    p = t.corpus.select("label", F.when(F.col("text_length") % 5 == 0, 1 - F.col("label")).otherwise(
        F.col("label")).cast("double").alias("prediction"))
    out = M.binary_metrics(M.confusion_counts(p))
    return out.select("tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")])


@query("cross_validate", "K8 E3")
def _(t: Tables):
    return M.cross_validate(features(t), E.experiment_svc)


@query("compare_models", "K9 F5")
def _(t: Tables):
    return E.compare_models(features(t))


@query("ablation", "K10 F5")
def _(t: Tables):
    return E.ablation(features(t))


@query("ablation_deltas", "K10", f"""
WITH {CORPUS_SQL}, r AS (SELECT source AS experiment_name, round(avg(label), 9) + 0.5::DOUBLE AS f1_score FROM corpus GROUP BY source),
b AS (SELECT f1_score AS base FROM r WHERE experiment_name = 'src0')
SELECT experiment_name, round(f1_score, 6) AS f1_score, round(f1_score - base, 6) AS delta_f1,
  round((f1_score - base) / base * 100, 6) AS delta_f1_pct FROM r, b""")
def _(t: Tables):
    runs = t.corpus.groupBy(F.col("source").alias("experiment_name")).agg((F.round(F.avg("label"), 9) + 0.5).alias("f1_score"))
    out = E.ablation_deltas(runs, "src0")
    return out.select("experiment_name", *[F.round(c, 6).alias(c) for c in ("f1_score", "delta_f1", "delta_f1_pct")])


@query("training_report", "K11")
def _(t: Tables):
    data = cut_lineage(features(t))
    m = M.train(data, M.feature_pipeline(M.linear_svc()))
    cv = M.cross_validate(data, E.experiment_svc)
    report = E.training_report(M.evaluate(m.model.transform(m.test)), M.evaluate(m.model.transform(m.train)), cv,
                               t.corpus.count(), int(m.model.stages[-1].coefficients.size), 0.0, F.lit("2024-06-01"))
    return report.select("finished_at", "dataset.samples", "features.count", "test.f1_score",
                         F.col("train.accuracy").alias("train_accuracy"), F.col("cross_validation.mean").alias("cv_mean"))


@query("latest_runs", "K11", f"""
WITH {CORPUS_SQL} SELECT source, max(doc_id) AS doc_id, arg_max(text_length, doc_id) AS text_length FROM corpus GROUP BY source""")
def _(t: Tables):
    return E.latest_runs(t.corpus.select("source", "doc_id", "text_length"), "source", "doc_id").select(
        "source", "doc_id", F.col("text_length").cast("long").alias("text_length"))


@query("save_and_load_pipeline", "A16 A17")
def _(t: Tables):
    m = trained(t)
    path = f"{_scratch(t)}/model-{uuid.uuid4().hex}"
    M.save_pipeline(m.model, path)
    again = M.load_pipeline(path)
    same = again.transform(m.test).select("doc_id", F.col("prediction").alias("p2")).join(
        m.model.transform(m.test).select("doc_id", F.col("prediction").alias("p1")), "doc_id")
    agree = same.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("p1") == F.col("p2")).alias("equal_predictions"))
    info = M.model_info(t.spark, again)
    row = info.first()
    return agree.select("*", F.lit(row.stages).alias("stages"), F.lit(row.classifier).alias("classifier"),
                        F.lit(row.coefficients).alias("coefficients"))


@query("predict_batch", "J11 J17 B24")
def _(t: Tables):
    m = trained(t)
    out = Z.predict_batch(features(t), m.model)
    return out.select("doc_id", F.round("sensationalism", 4).alias("sensationalism"), "analysis_available",
                      F.col("interpretation.level").alias("level"))
