"""Incremental news ingestion: batch, stream and summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pressgauge.functions import text as X, urls as U
from pressgauge.operators import cleaning as N
from pressgauge.operators.embedding import embed_documents
from pressgauge.schema import SCRAPED
from pressgauge.session import cut_lineage
from pressgauge.sources.training import _exists

# Characters of an id that name its folder among the seen ids: 16 folders; stores of billions of ids take 2 or 3. It is
# fixed for a store's life.
PREFIX = 1


def ingest_batch(existing: DataFrame | None, new: DataFrame | None, ingested_at: Column) -> DataFrame:
    """Union → clean → valid → first per URL → stored layout. Existing articles win over new ones."""
    both = N.combine_articles(existing, new)
    cleaned = N.valid_articles(N.clean_articles(both, keep=["batch"]))
    first = N.dedup_by_url(cleaned)
    return first.drop("batch").withColumns({
        "domain": U.domain_of(F.col("source_url")),
        "ingested_at": ingested_at,
        "article_type": F.lit("scraped_news"),
        "word_count": X.whitespace_words(F.col("content")),
    })


def ingest_summary(scraped: DataFrame, stored: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """Scraped, stored and rejected rows of a run, and the store's size."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")
    rows = count(scraped, "scraped").unionByName(count(stored, "stored"))
    if total is not None:
        rows = rows.unionByName(count(total, "total"))
    one = rows.agg(*[F.coalesce(F.max(F.when(F.col("item") == n, F.col("n"))), F.lit(0)).alias(n)
                     for n in ("scraped", "stored", "total")])
    return one.withColumn("failed", F.col("scraped") - F.col("stored"))


def store_batch(batch: DataFrame, batch_id: int, store: str, ingested_at: Column | None = None, prefix: int = PREFIX) -> None:
    """Write the unseen articles of one micro-batch.

    ``<store>/seen`` holds ids only, in folders by the first ``prefix`` characters of the id (a digest, so folders are even).
    A batch reads the folders that its own ids fall into, and there the files' Bloom filters leave out what has none of
    them, so its work follows its ids and not the store's size. Both writes replace the batch's own folders: a
    micro-batch that is run again after a lost executor or a restart leaves the same store.
    """
    spark = batch.sparkSession
    stamp = ingested_at if ingested_at is not None else F.current_timestamp()
    articles, seen, runs = f"{store}/articles", f"{store}/seen", f"{store}/runs"
    fresh = cut_lineage(ingest_batch(None, batch, stamp))
    if _exists(spark, f"{seen}/prefix=*"):
        # At most 16 to the power of ``prefix`` short strings.
        mine = [r.p for r in fresh.select(F.substring("id", 1, prefix).alias("p")).distinct().collect()]
        fresh = N.unseen(fresh, seen_ids(spark, store, mine).filter(F.col("ingest_batch") < batch_id), "id")
    part = F.lit(batch_id).cast("long")
    target = f"{articles}/ingest_batch={batch_id}"
    fresh.write.mode("overwrite").parquet(target)
    # The written articles are the batch's record: ids and counts are read back from them, not recomputed.
    written = spark.read.parquet(target)
    keys = written.select("id", F.substring("id", 1, prefix).alias("prefix"), part.alias("ingest_batch"))
    (keys.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#id", "true")
     .partitionBy("prefix", "ingest_batch").parquet(seen))
    ingest_summary(batch, written).withColumn("batch_id", part).write.mode("overwrite").parquet(
        f"{runs}/ingest_batch={batch_id}")


def seen_ids(spark: SparkSession, store: str, prefixes: Sequence[str]) -> DataFrame:
    """``id, ingest_batch`` of the stored ids with one of the prefixes; the files of other folders are not read."""
    schema = "id string, prefix string, ingest_batch long"
    ids = spark.read.option("basePath", f"{store}/seen").schema(schema).parquet(f"{store}/seen")
    return ids.where(F.col("prefix").isin(list(prefixes))).select("id", "ingest_batch")


def ingest_stream(spark: SparkSession, source: str, store: str, checkpoint: str, fmt: str = "json",
                  ingested_at: Column | None = None, max_files: int | None = None, prefix: int = PREFIX) -> StreamingQuery:
    """Ingest the files that arrived since the last run; every URL is stored once, ever."""
    reader = spark.readStream.schema(SCRAPED)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    arriving = reader.format(fmt).load(source)
    return (arriving.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda df, batch_id: store_batch(df, batch_id, store, ingested_at, prefix)).start())


def read_store(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.option("basePath", f"{store}/articles").option("mergeSchema", "true").parquet(
        f"{store}/articles")


def ingest_pipeline(existing: DataFrame | None, new: DataFrame, ingested_at: Column, factory=None) -> DataFrame:
    """Ingested articles with their embeddings; texts too short to embed keep a null."""
    stored = ingest_batch(existing, new, ingested_at)
    vectors = embed_documents(stored, "id", "content", factory)
    return stored.join(vectors, "id", "left")
