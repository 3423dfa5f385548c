"""Chat formatting after a cumulative-snapshot collapse.

Logs often hold a conversation again after every turn. Rolling hashes of all turn prefixes tell which conversations are
a prefix of a longer one: a conversation's whole hash is looked up, in an anti-join, among the distinct proper-prefix
hashes of all. What is left, one of each set of equal conversations (the smallest id), is rendered for training.

The hash of a prefix is the exclusive or of its turns' hashes, each mixed with its position, twice with different
constants (128 bits), so one window over narrow rows gives all prefixes. Prefixes and whole hashes are made distinct
with map-side combining before they meet: a first turn or a conversation that very many share is one row there.

Defined cases: turns are ordered by number, null first, ties by hash; exact repeated rows of a conversation count once;
a null text or role differs from an empty one in the hashes and is rendered as empty; rows of null id form one
conversation; an empty table gives no row; other columns are ignored. A conversation is one output row, so its turns
must fit a task, as the text of a very long document must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressgauge.llm.common import written

START, END = "<|im_start|>", "<|im_end|>"


def _hash(seed: int) -> Column:
    parts = [x for c in ("role", "text") for x in (F.coalesce(c, F.lit("")), F.col(c).isNull())]
    return F.xxhash64(*parts, F.lit(seed))


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, n, a, b, whole``: a row for every prefix of every conversation, with its hashes."""
    narrow = turns.select("conv_id", "turn", _hash(1).alias("ha"), _hash(2).alias("hb")).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "ha", "hb")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = narrow.withColumn("n", F.row_number().over(order))
    return placed.select("conv_id", "n", F.bit_xor(F.xxhash64("n", "ha")).over(until).alias("a"),
                         F.bit_xor(F.xxhash64("n", "hb", F.lit(7))).over(until).alias("b"),
                         F.lead("n").over(order).isNull().alias("whole"))


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of the conversations that no longer one starts with, one of each set of equals."""
    rows = written(prefixes(turns), "prefixes")
    ends = rows.where("whole").groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.first("n").alias("n_turns"))
    inner = rows.where("not whole").select("a", "b").distinct()
    return ends.join(inner, ["a", "b"], "left_anti").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"))


def render(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """``conv_id, n_turns, rendered`` of the maximal conversations."""
    turns = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                         F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    kept = maximal(turns).withColumnRenamed("conv_id", "kept")
    full = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("kept"))).withColumns({"ha": _hash(1), "hb": _hash(2)})
    told = F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    return full.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_set(F.struct("turn", "ha", "hb", told.alias("said"))))
                                                  .alias("said")).select("conv_id", "n_turns",
                                                                         F.array_join("said.said", "").alias("rendered"))
