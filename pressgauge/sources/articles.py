"""Reading and writing of articles, statistics and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pressgauge.operators.store import export_rows
from pressgauge.schema import SCRAPED
from pressgauge.sources.training import _exists

CLEAN_COLUMNS = ["text_full", "label", "source", "text_length", "word_count"]


def load_articles(spark: SparkSession, path: str) -> DataFrame:
    """Scraped articles from CSV; a missing file gives an empty typed table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], SCRAPED)
    options = {"header": True, "multiLine": True, "escape": '"'}
    header = spark.read.options(**options).csv(path).columns
    for name in SCRAPED.names:
        if name not in header:
            raise ValueError(f"required column {name} is missing")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(schema).options(**options).csv(path).select(*SCRAPED.names)


def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite with Parquet, or with CSV of the five clean columns."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif fmt == "csv":
        df.select(*CLEAN_COLUMNS).write.mode("overwrite").options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        raise ValueError(f"unsupported format {fmt}")


def write_statistics(tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_articles(df: DataFrame, path: str, partition_by: str | None = "domain") -> None:
    """Append, partitioned by domain when there is one.

    The rebalance hint clusters rows by domain and lets adaptive execution
    split a large domain over as many tasks as its size asks for.
    """
    if partition_by and partition_by in df.columns:
        balanced = df.hint("rebalance", F.col(partition_by))
        balanced.write.mode("append").partitionBy(partition_by).parquet(path)
        return
    df.write.mode("append").parquet(path)


def compact_articles(spark: SparkSession, path: str, partition_by: str = "domain", file_bytes: int = 128 << 20) -> int:
    """Rewrite the folders of domains whose files are many and small, and return how many.

    Sizes come from the files' own metadata, a row per file. A folder is rewritten when its files would fit in less than
    half as many of ``file_bytes``; each is dealt to tasks by size, others keep their files. Names stay what the appends
    wrote, so a compaction that is run again finds nothing to do.
    """
    files = spark.read.parquet(path).select(partition_by, F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("size"))
    sizes = files.groupBy(partition_by, "f").agg(F.max("size").alias("size")).groupBy(partition_by).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    small = sizes.where(F.col("files") > 2 * F.ceil(F.col("bytes") / file_bytes)).select(partition_by)
    done = small.count()
    if done:
        rows = spark.read.parquet(path).join(small, partition_by, "left_semi").hint("rebalance", F.col(partition_by))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)
    return done


def export_articles_csv(store: DataFrame, path: str) -> None:
    export_rows(store).write.mode("overwrite").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def output_inventory(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Which expected outputs exist, are complete and readable, with their row counts."""
    rows = []
    for name in names:
        path = f"{folder}/{name}"
        exists = _exists(spark, path)
        complete = _exists(spark, f"{path}/_SUCCESS")
        count = spark.read.parquet(path).count() if complete and _exists(spark, f"{path}/*.parquet") else None
        rows.append((name, exists, complete, count))
    return spark.createDataFrame(rows, "output string, present boolean, is_complete boolean, row_count long")
