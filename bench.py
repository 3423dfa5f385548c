"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pressgauge.plans.catalog import REGISTRY, Tables
from pressgauge.session import build_session

HEADLINE = [
    "clean_and_enrich", "data_summary", "phrase_lift", "word_frequency", "linguistic_features", "language_scores",
    "sensationalism_heuristic", "sensationalism_zscore", "credibility", "sentiment_scores", "stratified_split",
    "ingest_batch", "upsert_articles", "discover_links", "extract_articles", "embed_documents", "top_similar",
    "jaccard_map", "tfidf_vocab", "tfidf_cosine", "crosscheck", "related_articles", "analyze_articles", "train_svc",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus,
                                                         "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, folder)
    tables.documents.count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
