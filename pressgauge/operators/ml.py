"""Training, evaluation and comparison of classifiers with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (LinearSVC, LinearSVCModel, LogisticRegression, NaiveBayes,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer,
                                StandardScaler, StopWordsRemover, Tokenizer, VectorAssembler)
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgauge.functions import lexicons as L
from pressgauge.operators.ranking import class_weights, kfold, stratified_split
from pressgauge.operators.tfidf import term_counts
from pressgauge.session import checkpointed, small_side

SEED = 42
ROWS_A_TASK = 20_000      # rows of a partition that classifiers pass over
LEAST_ROWS = 1_000        # fewer rows are not worth a task of their own
FLAT_TASKS = 5            # gradients of more tasks are summed up in one stage more, for every pass of a linear classifier


def tfidf_stages(text: str = "text_full", num_features: int = 50000, output: str = "tfidf_features") -> list:
    """Tokenizer, stop words, hashed counts, idf."""
    return [Tokenizer(inputCol=text, outputCol="words"),
            StopWordsRemover(inputCol="words", outputCol="filtered_words"),
            HashingTF(inputCol="filtered_words", outputCol="raw_features", numFeatures=num_features),
            IDF(inputCol="raw_features", outputCol=output)]


def vocabulary_stages(text: str = "text_full", max_features: int = 50000, min_df: float = 2, max_df: float = 0.95,
                      output: str = "tfidf_features") -> list:
    """Vocabulary tf-idf over words and word pairs, L2-normalised."""
    return [RegexTokenizer(inputCol=text, outputCol="words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
            NGram(n=2, inputCol="words", outputCol="pairs"),
            SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"),
            CountVectorizer(inputCol="grams", outputCol="raw_features", vocabSize=max_features, minDF=min_df,
                            maxDF=max_df),
            IDF(inputCol="raw_features", outputCol="idf_features"),
            Normalizer(inputCol="idf_features", outputCol=output)]


def fit_vocabulary(df: DataFrame, text: str = "text_full", max_features: int = 50000, min_df: float = 2, max_df: float = 0.95,
                   output: str = "tfidf_features") -> PipelineModel:
    """``vocabulary_stages`` fitted: the same vectors, with terms of equal count in the order of the terms.

    ``CountVectorizer`` brings the counts of all terms together in as many tasks as the texts have splits. Here they are a
    grouping, in as many tasks as the session's shuffles have; what is kept, with its document frequencies, reaches the driver.
    """
    first = PipelineModel(vocabulary_stages(text)[:3])
    terms = first.transform(df.select(text)).select(F.monotonically_increasing_id().alias("id"), F.col("grams").alias("terms"))
    n = df.count()
    share = lambda x: x if x >= 1 else x * n
    counts = term_counts(terms).groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    kept = counts.where(F.col("df").between(share(min_df), share(max_df))).orderBy(F.desc("cf"), "term").limit(max_features).collect()
    idf = Vectors.dense(np.log((n + 1.0) / (np.array([r.df for r in kept], float) + 1.0)))
    return PipelineModel([*first.stages, CountVectorizerModel.from_vocabulary([r.term for r in kept], "grams", "raw_features"),
                          ElementwiseProduct(scalingVec=idf, inputCol="raw_features", outputCol="idf_features"),
                          Normalizer(inputCol="idf_features", outputCol=output)])


def scale_stages(columns: Sequence[str] = tuple(L.FEATURE_NAMES)) -> list:
    """Assemble the named features and standardise them with mean and deviation."""
    return [VectorAssembler(inputCols=list(columns), outputCol="linguistic_features_vector"),
            StandardScaler(inputCol="linguistic_features_vector", outputCol="linguistic_features_scaled",
                           withMean=True, withStd=True)]


def combine_stage(tfidf: bool = True, scaled: bool = True) -> VectorAssembler:
    """[tf-idf ‖ scaled features]"""
    parts = (["tfidf_features"] if tfidf else []) + (["linguistic_features_scaled"] if scaled else [])
    if not parts:
        raise ValueError("no features selected")
    return VectorAssembler(inputCols=parts, outputCol="features")


def with_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced class weights as a column; the weight table has one row per class."""
    return df.join(small_side(class_weights(df, label).select(label, "weight")), label)


def feature_pipeline(classifier, tfidf: bool = True, columns: Sequence[str] = tuple(L.FEATURE_NAMES),
                     num_features: int = 50000) -> Pipeline:
    """All stages from text to prediction, so the saved model scores raw rows."""
    stages = (tfidf_stages(num_features=num_features) if tfidf else []) + (scale_stages(columns) if columns else [])
    return Pipeline(stages=[*stages, combine_stage(tfidf, bool(columns)), classifier])


def linear_svc(max_iter: int = 100, reg: float = 0.1, weighted: bool = False, tol: float = 1e-4) -> LinearSVC:
    """``tol`` is the relative improvement at which iterations end before ``max_iter``; each takes several passes, because
    the hinge loss has no slope at its edge for the line search to follow."""
    extra = {"weightCol": "weight"} if weighted else {}
    return LinearSVC(maxIter=max_iter, regParam=reg, tol=tol, featuresCol="features", labelCol="label", **extra)


def logistic(max_iter: int = 1000, tol: float = 1e-4) -> LogisticRegression:
    return LogisticRegression(maxIter=max_iter, tol=tol, labelCol="label", weightCol="weight", regParam=1e-4)


def forest(trees: int = 100, depth: int = 20) -> RandomForestClassifier:
    """Spark grows trees to depth 30 at most. A row's node in every tree is kept, so that a level does not walk all trees
    down again; the trees are the same."""
    return RandomForestClassifier(numTrees=trees, maxDepth=min(depth, 30), labelCol="label", weightCol="weight",
                                  seed=SEED, cacheNodeIds=True)


def gaussian_bayes() -> NaiveBayes:
    return NaiveBayes(modelType="gaussian", labelCol="label")


@dataclass
class Trained:
    model: PipelineModel
    train: DataFrame
    test: DataFrame


def bare(df: DataFrame) -> DataFrame:
    """``df`` with vectors that do not name their components.

    An assembler lists all 50,000 in the column's metadata, and every task of every pass over the rows is sent that list.
    """
    return df.select(*(F.col(f.name).alias(f.name, metadata={"comment": "vector"}) if isinstance(f.dataType, VectorUDT) else F.col(f.name)
                       for f in df.schema.fields))


def sized(df: DataFrame, side_by_side: int = 1, most: int | None = FLAT_TASKS) -> DataFrame:
    """``df`` written, in partitions of at most about ``ROWS_A_TASK`` rows.

    A classifier passes over its rows some thousand times, and a pass costs a task for each partition: few rows belong
    into few partitions, but not into fewer than let ``side_by_side`` fits use all cores, up to ``most`` (None: no limit).
    Partitions are only merged, so no row is shuffled.
    """
    held = checkpointed(bare(df))
    rows, cores = held.count(), df.sparkSession.sparkContext.defaultParallelism
    useful = min(-(-cores // side_by_side), -(-rows // LEAST_ROWS), most or cores)
    return held.coalesce(max(1, -(-rows // ROWS_A_TASK), useful))


def fitted(classifier, rows: DataFrame):
    """``classifier`` fitted on rows that may lie in more tasks than a linear one needs: for that they are merged."""
    if isinstance(classifier, (LinearSVC, LogisticRegression)):
        rows = rows.coalesce(max(FLAT_TASKS, -(-rows.count() // ROWS_A_TASK)))
    return classifier.fit(rows)


def storage_bytes(spark: SparkSession) -> int:
    """Memory in which the executors can hold rows."""
    sc = spark.sparkContext._jsc.sc()
    status, own = sc.getExecutorMemoryStatus(), sc.env().blockManager().blockManagerId().hostPort()
    each, found = status.iterator(), {}
    while each.hasNext():
        entry = each.next()
        found[entry._1()] = int(entry._2()._1())
    # The driver holds rows only where it is the one executor.
    return sum(size for name, size in found.items() if name != own) or sum(found.values())


def fits_at_once(rows: DataFrame, vector: str = "features", binned: bool = False, most: int = 5) -> int:
    """How many fits on ``rows`` run side by side: each holds its own copy of the vectors for all its passes, and the copies
    may take half of the executors' memory. ``binned`` adds the number that a forest keeps for every place of a vector."""
    v = F.unwrap_udt(vector)
    held = F.size(v["values"]) * 12 + (F.coalesce(v["size"], F.size(v["values"])) * 4 if binned else F.lit(0))
    taken = rows.agg(F.sum(held.cast("long")).alias("n")).first().n or 0
    return max(1, min(most, storage_bytes(rows.sparkSession) // (2 * max(1, taken))))


def in_parallel(jobs: Sequence[Callable], threads: int = 5) -> list:
    """Results of independent fits, in order. Each waits for many small jobs, so several share the cluster."""
    from pyspark import inheritable_thread_target

    with ThreadPool(min(threads, max(1, len(jobs)))) as pool:
        return pool.map(lambda job: job(), [inheritable_thread_target(j) for j in jobs])


def train(df: DataFrame, pipeline: Pipeline, key: str = "doc_id", test: float = 0.2, fit_on: str = "train") -> Trained:
    """Fit on the training part of a stratified split.

    Vectors are made once, by the stages before the classifier, and written; the classifier reads them. ``fit_on="all"``
    fits every stage, scaler and idf included, on all rows.
    """
    split = checkpointed(stratified_split(df, "label", key, test, SEED))
    fit_rows, test_rows = split.filter(~F.col("is_test")), split.filter("is_test")
    own = split if fit_on == "all" else fit_rows
    *stages, classifier = pipeline.getStages()
    # Texts are taken apart once: what needs no fitting comes first and is written without them.
    plain, learned = unlearned(stages)
    columns = [key, "label", *(["weight"] if "weight" in df.columns else [])]
    made = PipelineModel(plain).transform(own)
    if plain:
        made = checkpointed(made.select(*columns, *(c for c in read_by(learned, made.columns) if c not in columns)))
    features = Pipeline(stages=learned).fit(made)
    last = classifier.fit(sized(features.transform(made).select(*columns, "features")))
    return Trained(PipelineModel([*plain, *features.stages, last]), fit_rows, test_rows)


def unlearned(stages: Sequence) -> tuple[list, list]:
    """The leading stages that need no fitting, and the rest."""
    at = next((i for i, s in enumerate(stages) if isinstance(s, Estimator)), len(stages))
    return list(stages[:at]), list(stages[at:])


def read_by(stages: Sequence, columns: Sequence[str]) -> list[str]:
    """The given columns that a stage reads; all, if a stage does not name its inputs."""
    if not all(s.hasParam("inputCol") or s.hasParam("inputCols") for s in stages) or any(isinstance(s, SQLTransformer) for s in stages):
        return list(columns)
    named = {n for s in stages for p in ("inputCol", "inputCols") if s.hasParam(p) and s.isDefined(p)
             for n in ([s.getOrDefault(p)] if p == "inputCol" else s.getOrDefault(p))}
    return [c for c in columns if c in named]


def confusion_counts(predictions: DataFrame) -> DataFrame:
    """tn, fp, fn, tp from (label, prediction) counts, as one row."""
    one = lambda l, p: F.count_if((F.col("label") == l) & (F.col("prediction") == p))  # noqa: E731, E741
    return predictions.agg(one(0, 0).alias("tn"), one(0, 1).alias("fp"), one(1, 0).alias("fn"), one(1, 1).alias("tp"))


def binary_metrics(confusion: DataFrame) -> DataFrame:
    """Accuracy and positive-class precision, recall and F1 from confusion counts; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return confusion.withColumns({
        "accuracy": safe(tp + tn, tp + tn + fp + fn), "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn),
        "f1_score": safe(2 * tp, 2 * tp + fp + fn)})


def weighted_metrics(metrics: DataFrame) -> DataFrame:
    """Class-weighted precision, recall and F1 from confusion counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n = tp + tn + fp + fn
    both = lambda pos, neg: safe(pos * (tp + fn) + neg * (tn + fp), n)
    return metrics.withColumns({
        "weighted_precision": both(safe(tp, tp + fp), safe(tn, tn + fn)),
        "weighted_recall": both(safe(tp, tp + fn), safe(tn, tn + fp)),
        "weighted_f1": both(safe(2 * tp, 2 * tp + fp + fn), safe(2 * tn, 2 * tn + fp + fn))})


def evaluate(predictions: DataFrame) -> DataFrame:
    """ROC-AUC, weighted and positive-class precision, recall, F1 and the confusion counts as one row.

    Two passes over the predictions: one sorts scores for the area, one counts.
    """
    scored = predictions.select("label", "prediction", "rawPrediction").persist()
    auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction",
                                        metricName="areaUnderROC").evaluate(scored)
    row = weighted_metrics(binary_metrics(confusion_counts(scored)))
    names = ["weighted_precision", "weighted_recall", "weighted_f1", "accuracy", "precision", "recall", "f1_score"]
    values = row.select(*names, "tn", "fp", "fn", "tp").first()
    scored.unpersist()
    return predictions.sparkSession.createDataFrame(
        [(float(auc), *values)], "roc_auc double, " + ", ".join(f"{n} double" for n in names)
        + ", tn long, fp long, fn long, tp long")


@dataclass
class FoldStatistics:
    """What the stages learn, for every fold alone: all of it can be added up over folds.

    ``frequency``: rows that hold a term, by fold; ``rows``; ``labels``: rows by label; ``moments``: rows, means and summed
    squared deviations of the scaled columns.
    """

    rows: dict[int, int]
    frequency: dict[int, np.ndarray]
    labels: dict[int, dict[float, int]]
    moments: dict[int, tuple[int, np.ndarray, np.ndarray]]

    def idf(self, fold: int) -> np.ndarray:
        """Inverse document frequencies of all rows outside the fold: the total minus the fold."""
        n = sum(self.rows.values()) - self.rows[fold]
        df = sum(self.frequency.values()) - self.frequency[fold]
        return np.log((n + 1.0) / (df + 1.0))

    def scale(self, fold: int) -> tuple[np.ndarray, np.ndarray]:
        """Means and sample deviations of all rows outside the fold, from the other folds' moments."""
        n, mean, squares = 0, 0.0, 0.0
        for other, (m, x, s) in self.moments.items():
            if other != fold and m:
                apart = x - mean
                squares = squares + s + apart ** 2 * n * m / (n + m)
                mean = mean + apart * m / (n + m)
                n += m
        return mean, np.sqrt(squares / max(1, n - 1))

    def weights(self, fold: int) -> dict[float, float]:
        """Balanced class weights of all rows outside the fold."""
        counts: dict[float, int] = {}
        for other, of in self.labels.items():
            if other != fold:
                for label, n in of.items():
                    counts[label] = counts.get(label, 0) + n
        return {label: sum(counts.values()) / (len(counts) * n) for label, n in counts.items()}


def fold_rows(df: DataFrame, k: int, columns: Sequence[str], num_features: int, key: str = "doc_id") -> DataFrame:
    """``key, label, fold, raw_features`` and the columns: hashed counts depend on no other row and are made once."""
    counts = Pipeline(stages=tfidf_stages(num_features=num_features)[:-1]).fit(df)
    folded = kfold(df.drop("weight"), k, "label", key, SEED)
    return sized(counts.transform(folded).select(key, "label", "fold", "raw_features", *columns))


def fold_statistics(rows: DataFrame, columns: Sequence[str]) -> FoldStatistics:
    """One pass for the document frequencies, one for counts and moments; a fold sends its sums only."""
    figures = [f for c in columns for f in (F.avg(c).alias(f"m_{c}"), F.coalesce(F.var_pop(c), F.lit(0.0)).alias(f"v_{c}"))]
    table = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *figures).collect()
    labels: dict[int, dict[float, int]] = {r.fold: {} for r in table}
    for r in rows.groupBy("fold", "label").count().collect():
        labels[r.fold][r.label] = r["count"]
    moments = {r.fold: (r.n, np.array([r[f"m_{c}"] for c in columns], float), r.n * np.array([r[f"v_{c}"] for c in columns], float))
               for r in table}
    frequency = {r.fold: np.array(IDF(inputCol="raw_features").fit(rows.filter(F.col("fold") == r.fold)).docFreq, float) for r in table}
    return FoldStatistics({r.fold: r.n for r in table}, frequency, labels, moments)


def fold_vectors(rows: DataFrame, statistics: FoldStatistics, fold: int, columns: Sequence[str], key: str = "doc_id") -> DataFrame:
    """``key, label, weight, features, is_test``: vectors by statistics of the rows outside the fold, which is the test."""
    mean, spread = statistics.scale(fold)
    weights = statistics.weights(fold)
    scaled = [F.when(F.lit(bool(s > 0)), (F.col(c) - float(m)) / float(s or 1)).otherwise(0.0).alias(c)
              for c, m, s in zip(columns, mean, spread)]
    weight = F.element_at(F.create_map(*(F.lit(v) for pair in weights.items() for v in (float(pair[0]), float(pair[1])))),
                          F.col("label").cast("double"))
    base = rows.select(key, "label", "raw_features", F.coalesce(weight, F.lit(1.0)).alias("weight"),
                       (F.col("fold") == fold).alias("is_test"), *scaled)
    product = ElementwiseProduct(scalingVec=Vectors.dense(statistics.idf(fold)), inputCol="raw_features", outputCol="tfidf_features")
    joined = VectorAssembler(inputCols=["tfidf_features", *columns], outputCol="features").transform(product.transform(base))
    return joined.select(key, "label", "weight", "features", "is_test")


def cross_validate(df: DataFrame, classifier: Callable, k: int = 5, metric: str = "f1", key: str = "doc_id",
                   columns: Sequence[str] = tuple(L.FEATURE_NAMES), num_features: int = 50000) -> DataFrame:
    """Mean, deviation, minimum and maximum of a metric over stratified folds.

    tf-idf, scaling and class weights of each training part are those of the total minus the fold, so texts are hashed
    once and not once per fold; the vectors equal those of stages fitted anew. ``classifier`` makes an estimator. Folds
    are fitted side by side as far as their rows fit into memory.
    """
    rows = fold_rows(df, k, columns, num_features, key)
    statistics = fold_statistics(rows, columns)

    def score(fold: int) -> tuple[int, float]:
        data = sized(fold_vectors(rows, statistics, fold, columns, key), k)
        predictions = classifier().fit(data.filter(~F.col("is_test"))).transform(data.filter("is_test"))
        if metric == "auc":
            return fold, float(BinaryClassificationEvaluator(labelCol="label").evaluate(predictions))
        return fold, float(binary_metrics(confusion_counts(predictions)).first().f1_score)

    scores = in_parallel([partial(score, fold) for fold in sorted(statistics.rows)], fits_at_once(rows, "raw_features"))
    table = df.sparkSession.createDataFrame(scores, "fold int, score double")
    return table.agg(F.lit(metric).alias("metric"), F.count(F.lit(1)).alias("folds"), F.avg("score").alias("mean"),
                     F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"))


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_info(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Stages, and coefficient count and intercept of a linear classifier."""
    last = model.stages[-1]
    linear = isinstance(last, LinearSVCModel)
    return spark.createDataFrame(
        [(len(model.stages), type(last).__name__, int(last.coefficients.size) if linear else None,
          float(last.intercept) if linear else None)],
        "stages int, classifier string, coefficients int, intercept double")


def feature_summary(df: DataFrame, vector: str = "features") -> DataFrame:
    """Rows and vector size."""
    from pyspark.ml.functions import vector_to_array

    return df.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(vector_to_array(vector))).alias("vector_size"))


def split_and_prepared(df: DataFrame, tfidf: bool = True, columns: Sequence[str] = tuple(L.FEATURE_NAMES),
                       num_features: int = 5000, key: str = "doc_id", test: float = 0.2) -> DataFrame:
    """For experiments, which hash terms to 5,000 features: ``key, label, weight, features, is_test``.

    Vectors of all rows by stages and class weights that only the training part has fitted. Rows are split first and
    written once; the test part has a weight too, that of its class.
    """
    split = checkpointed(stratified_split(df, "label", key, test, SEED))
    train_rows = split.filter(~F.col("is_test"))
    weights = class_weights(train_rows).select("label", "weight")
    stages = (tfidf_stages(num_features=num_features) if tfidf else []) + (scale_stages(columns) if columns else [])
    learnt = Pipeline(stages=[*stages, combine_stage(tfidf, bool(columns))]).fit(train_rows)
    out = learnt.transform(split).join(small_side(weights), "label", "left")
    return sized(out.select(key, "label", F.coalesce("weight", F.lit(1.0)).alias("weight"), "features", "is_test"), most=None)
