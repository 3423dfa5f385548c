"""Exact ranks inside large groups, stratified splits and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressgauge.session import cut_lineage, small_side

# Hash prefix length in hex digits: 4096 buckets per group.
_PREFIX = 3


def _order(key: str, seed: int | str) -> Column:
    """Hashed key, then the key itself."""
    return F.struct(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))).alias("h"), F.col(key).alias("k"))


def hash_rank(df: DataFrame, group: str, key: str, seed: int | str) -> DataFrame:
    """``group, key, order, hash_rank, group_size``: 1-based rank by hashed key within a group.

    A window over the group itself would sort a whole class in one task. The
    hash is uniform, so its prefix cuts a group of any size into equal buckets:
    rows are ranked within a bucket and the bucket's offset is added. The
    bucket table has at most 4096 rows per group value.
    """
    hashed = df.select(group, key, _order(key, seed).alias("order")).withColumn(
        "_b", F.substring("order.h", 1, _PREFIX))
    counts = hashed.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    by_group = Window.partitionBy(group)
    offsets = counts.select(
        F.col(group).alias("_g"), F.col("_b").alias("_gb"),
        (F.sum("_n").over(by_group.orderBy("_b")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(by_group).alias("group_size"))
    within = Window.partitionBy(group, "_b").orderBy("order")
    ranked = hashed.withColumn("_r", F.row_number().over(within))
    joined = ranked.join(small_side(offsets), (F.col(group) == F.col("_g")) & (F.col("_b") == F.col("_gb")))
    return joined.select(group, key, "order", (F.col("_before") + F.col("_r")).alias("hash_rank"), "group_size")


def stratified_split(df: DataFrame, label: str = "label", key: str = "doc_id", test: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Mark ``is_test`` for the first ``test`` share of every class in hashed order.

    Only keys are ranked. The last test key of each class, one row per class,
    is then compared with every row in place, so wide rows are not shuffled.
    The mark depends on key and seed only, not on partitioning.
    """
    ranked = hash_rank(df, label, key, seed)
    percent_rank = (F.col("hash_rank") - 1) / F.greatest(F.lit(1), F.col("group_size") - 1)
    cut = ranked.filter(percent_rank < test).groupBy(label).agg(F.max("order").alias("_cut"))
    marked = df.join(small_side(cut), label, "left")
    return marked.withColumn("is_test", F.coalesce(_order(key, seed) <= F.col("_cut"), F.lit(False))).select(
        *df.columns, "is_test")


def kfold(df: DataFrame, k: int, label: str = "label", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Stratified fold number 1..k, as ``ntile`` would give it; wide rows stay in place."""
    ranked = hash_rank(df, label, key, seed)
    small = F.floor(F.col("group_size") / k)
    extra = F.col("group_size") % k
    in_large = F.col("hash_rank") <= extra * (small + 1)
    tile = F.when(in_large, F.floor((F.col("hash_rank") - 1) / (small + 1))).otherwise(
        extra + F.floor((F.col("hash_rank") - 1 - extra * (small + 1)) / F.greatest(F.lit(1), small)))
    ends = ranked.groupBy(label, tile.alias("_tile")).agg(F.max("order").alias("_end"))
    cuts = ends.groupBy(label).agg(F.collect_list("_end").alias("_ends"))
    marked = df.join(small_side(cuts), label, "left").withColumn("_o", _order(key, seed))
    fold = F.size(F.filter("_ends", lambda end: end < F.col("_o"))) + 1
    return marked.select(*df.columns, fold.cast("int").alias("fold"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per class: rows / (classes × class rows)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))
    return counts.withColumn(
        "weight", F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n")))


def top_k(df: DataFrame, group: str | list[str], order: list[Column], k: int) -> DataFrame:
    """k best rows per group with ``rank``.

    The rank filter sits directly on the window, so each partition keeps only
    its own k best per group before the shuffle.
    """
    keys = [group] if isinstance(group, str) else group
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def positions(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Number the rows of a sorted table from 1, without bringing them into one task.

    The sorted partitions are written; each is numbered on its own, from the rows of the partitions before it. Only one
    count per partition meets in a task, and that table is broadcast.
    """
    held = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = F.broadcast(counts.select("_part", before.alias("_before")))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("_part", part).join(spans, "_part").select(*ordered.columns, (F.col("_before") + within + 1).alias(name))
