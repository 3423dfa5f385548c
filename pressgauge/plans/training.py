"""Training from raw CSV corpora to stored tables and a saved model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgauge.operators import cleaning as N, linguistic as G, ml as M, statistics as ST
from pressgauge.sources import articles as A
from pressgauge.sources.training import SourceSpec, read_sources


def clean_corpora(raw: DataFrame) -> DataFrame:
    """Clean layout of ``read_sources`` rows; the fixed label wins over the file's own."""
    label = F.coalesce(F.col("fixed_label"), N.normalize_label(F.col("label")))
    return N.clean_and_enrich(raw, F.col("source"), label)


def training_pipeline(spark: SparkSession, specs: Sequence[SourceSpec], out: str, skip_training: bool = False,
                      num_features: int = 50000) -> dict[str, DataFrame]:
    """Read, clean, summarise, add features, store, train, evaluate and save.

    The feature table is written once and read back: training passes over it
    many times, and a written table survives lost executors.
    """
    clean = clean_corpora(read_sources(spark, specs))
    A.write_clean(clean, f"{out}/cleaned")
    clean = spark.read.parquet(f"{out}/cleaned")
    statistics = ST.perform_aggregations(clean)
    A.write_statistics(statistics, f"{out}/statistics")
    keyed = clean.withColumn("doc_id", F.xxhash64("source", "text_full"))
    A.write_features(G.linguistic_features(keyed.withColumnRenamed("text_length", "chars").withColumnRenamed(
        "word_count", "pieces"), "text_full"), f"{out}/features")
    features = spark.read.parquet(f"{out}/features")
    result = {"cleaned": clean, "features": features, **statistics}
    if skip_training:
        return result
    trained = M.train(features, M.feature_pipeline(M.linear_svc(), num_features=num_features))
    M.save_pipeline(trained.model, f"{out}/model")
    metrics = M.evaluate(trained.model.transform(trained.test))
    metrics.write.mode("overwrite").parquet(f"{out}/metrics")
    M.model_info(spark, trained.model).write.mode("overwrite").json(f"{out}/model_info")
    result["metrics"] = spark.read.parquet(f"{out}/metrics")
    return result
