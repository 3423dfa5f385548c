"""Connected components of an undirected link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressgauge.llm.common import written


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node, component`` for every node that has a link; the component is its smallest node.

    Each half step finds the least neighbour of every node with map-side combining and hangs the neighbours there; a
    hub's many links meet one row of the other side, so adaptive execution can split them. Every round is written to
    the shared folder. The number of rounds grows with the logarithm of the longest chain.
    """
    links = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo")
    links = written(links.distinct(), "links")
    state = _state(links)
    for _ in range(rounds):
        if not state[0]:
            break
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
                 .where("hi <> lo").distinct())
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(floor, "hi")
        small = (small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .unionByName(small.select("hi", F.col("m").alias("lo")))).where("hi <> lo").distinct()
        links = written(small, "links")
        now = _state(links)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
