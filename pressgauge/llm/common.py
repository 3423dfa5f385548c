"""Helpers shared by the operators: written intermediate tables, Arrow stages, bounded samples."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from pressgauge.session import shared_folder

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: later stages start from files, not from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_stage(df: DataFrame, task: Callable[..., Iterator[pa.RecordBatch]], schema: str | StructType, *args) -> DataFrame:
    """``mapInArrow`` with a top-level function ``task(batches, *args)``.

    The function is named, not shipped: a worker imports its module, so that caches kept there (vocabularies, distinct
    words) serve all tasks of the worker.
    """
    module, name, root = task.__module__, task.__name__, ROOT

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        yield from getattr(importlib.import_module(module), name)(batches, *args)

    return df.mapInArrow(run, schema)


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_col.cast("string")) % folds


def bounded_sample(df: DataFrame, class_col: str, key: Column, per_class: int) -> DataFrame:
    """At most about ``per_class`` rows of each class, chosen by a hash of ``key``.

    Classes are counted over all rows with map-side combining; then a row stays if its hash lies below the share its
    class needs. No row is moved. Only classes of more than ``per_class`` rows need a share, so the shares that reach the
    plan are few however many values the class column has. A final limit of twice the expected size bounds the sample
    where hashes tie.
    """
    counts = df.groupBy(class_col).count()
    classes = counts.count()
    large = counts.where(F.col("count") > per_class).where(F.col(class_col).isNotNull()).collect()
    share = F.lit(1.0)
    if large:
        rates = F.create_map(*(F.lit(v) for row in large for v in (row[class_col], per_class / row["count"])))
        share = F.coalesce(F.try_element_at(rates, F.col(class_col)), F.lit(1.0))
    unit = (F.xxhash64(key, F.lit("sample")).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30))
    return df.where(unit < share).limit(2 * per_class * classes)
