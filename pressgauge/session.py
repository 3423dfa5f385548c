"""Session helpers: sizing, checkpoint folder and parallelism of small inputs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pressgauge", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with adaptive execution; the cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints and intermediate tables.

    A session on one machine that names none, as in tests, gets one of its own. A cluster must name it: its executors do
    not see the driver's folders.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN[sc.applicationId]


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later stages start from files, not from lost
    executors, and the optimizer knows their bytes. (An eager checkpoint would run the last stage twice.)"""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` materialised partition by partition in the shared folder.

    Files of a table are read in the order of their sizes; here partitions keep theirs, so that sums of floating-point
    numbers that models are fitted on come out the same.
    """
    sc = df.sparkSession.sparkContext
    # The driver may have set the folder through either route.
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def small_side(df: DataFrame) -> DataFrame:
    """``df`` written, for the side of a join that is usually small: dictionaries, vocabularies, counts.

    Whether it is broadcast is left to the optimizer, which compares the bytes written with
    ``spark.sql.autoBroadcastJoinThreshold``; beyond that both sides are shuffled and skewed partitions split.
    """
    return cut_lineage(df)


def spread(df: DataFrame) -> DataFrame:
    """Rebalance an input that has fewer splits than the session has cores.

    Text expressions are CPU bound, so one large row group would keep one core
    busy. An input that already has enough splits is returned untouched, which
    is the case for any table of real size: no shuffle is added there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
