"""Labelled training corpora in CSV files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Column layouts of the corpora (fixed values).
LAYOUTS = {
    "title_text": ["title", "text"],
    "text": ["text"],
    "title_text_label": ["title", "text", "label"],
}


@dataclass(frozen=True)
class SourceSpec:
    """A CSV corpus: ``label`` 0 or 1, or None when the file has a label column."""

    path: str
    source: str
    label: int | None
    layout: str = "title_text"
    encoding: str = "auto"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target) is not None and len(
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)) > 0


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless any line of the file is not valid UTF-8. Spark's CSV reader itself never complains."""
    lines = spark.read.text(path)
    return "ISO-8859-1" if lines.filter(~F.is_valid_utf8("value")).limit(1).count() else "UTF-8"


def read_csv(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """One corpus by header name; extra columns are ignored, text may span lines."""
    encoding = detect_encoding(spark, spec.path) if spec.encoding == "auto" else spec.encoding
    options = {"header": True, "multiLine": True, "escape": '"', "encoding": encoding}
    header = spark.read.options(**options).option("inferSchema", False).csv(spec.path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(schema).options(**options).csv(spec.path)


def read_sources(spark: SparkSession, specs: Sequence[SourceSpec]) -> DataFrame:
    """``title, text, label, source`` of all present files; missing files are skipped.

    ``label`` is text: the file's own value, or the fixed label of the spec
    in ``fixed_label``.
    """
    frames = []
    for spec in specs:
        if not _exists(spark, spec.path):
            continue
        df = read_csv(spark, spec)
        missing = [c for c in ("text",) if c not in df.columns]
        if missing:
            raise ValueError(f"{spec.source}: required column {missing[0]} is missing")
        column = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")  # noqa: B023, E731
        frames.append(df.select(column("title").alias("title"), F.col("text"), column("label").alias("label"),
                                F.lit(spec.source).alias("source"),
                                F.lit(spec.label).cast("int").alias("fixed_label")))
    if not frames:
        raise ValueError("no source file found")
    return reduce(lambda a, b: a.unionByName(b), frames)


def validate_sources(df: DataFrame) -> DataFrame:
    """Per source: rows, rows without text, rows without a usable label, and whether it passes."""
    if "text" not in df.columns:
        raise ValueError("column text is missing")
    title = F.col("title") if "title" in df.columns else F.lit(None)
    return df.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("without_text"),
        F.count_if(title.isNull()).alias("without_title"),
    ).withColumn("is_valid", F.col("rows") > F.col("without_text"))
