"""Exact best matches of sparse vectors by a distributed inverted index with max-score pruning.

The index keeps, for every term, its postings in blocks of about ``BLOCK`` entries, each with the largest weight in it,
so a term that every text has is many rows and no long one. All weights are positive, so

* a score over some of a request's terms is a lower bound: the k-th best score over the request's rarest terms
  (``SEED`` postings of each request) is a floor that its k-th result cannot fall below;
* a term adds at most the request's weight times the term's largest weight. The terms whose bounds together stay under
  the floor cannot lift a text over it alone, so candidates come from the other, essential terms only, and among their
  blocks only from those whose own largest weight can still reach the floor;
* a candidate whose score over the essential terms and the bounds of the rest stays under the floor, or then under the
  k-th best score over the essential terms, goes; the others get the missing products from the texts' weights, by text and term.

Every step is a join or a grouping by (term, block), (request, text) or (text, term). Nothing passes through the driver
but the number of postings, and more requests mean more rows in the same joins, not further passes over the corpus.

Where one side has few weights (``HELD``), pruning costs more than it saves: over a large corpus of short vocabulary most
pairs stay near the floor, and they would be shuffled with every term that is still to be added. There the few weights
meet the other side's texts where these lie (``held_matches``), and only the best matches of a task are shuffled.

Where all pairs are asked for (``every_pair``) nothing is ranked or left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressgauge.operators.ranking import top_k
from pressgauge.session import cut_lineage, small_side

BLOCK = 1_024          # postings of a block, about
SEED = 8_192           # postings that give a request its floor
HOT = 4_096            # at most so many terms hold more than one HOT-th of all postings each
SLACK = 1e-7           # of bounds, for rounding
HELD = 250_000         # weights of a side that every task may hold: about 20 MB
PAIRS = 1 << 19        # scored pairs of a task, about
CELL = 1_024           # requests and texts that meet under one number, where all pairs are asked for and neither side is held


@dataclass
class Index:
    """``postings`` (``id, idx, weight``), ``blocks`` (``idx, block, top, entries``) and ``terms`` (``idx, df, top, blocks``)."""

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame


def build_index(postings: DataFrame) -> Index:
    """Index of ``id, idx, weight`` rows with positive weights; a column ``site`` is kept with every entry."""
    carried = [c for c in ("site",) if c in postings.columns]
    postings = cut_lineage(postings.select("id", "idx", "weight", *carried))
    terms = cut_lineage(postings.groupBy("idx").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("top"))
                        .withColumn("blocks", F.ceil(F.col("df") / BLOCK).cast("long")))
    total = terms.agg(F.sum("df")).first()[0] or 0
    # At most HOT terms: a proven bound. A term of the others holds too little to fill a task.
    hot = terms.where(F.col("df") * HOT > total).select("idx", "blocks")
    often = postings.join(F.broadcast(hot), "idx")
    rest = postings.join(F.broadcast(hot.select("idx")), "idx", "left_anti").join(terms.select("idx", "blocks"), "idx")
    placed = often.unionByName(rest).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    blocks = placed.groupBy("idx", "block").agg(F.max("weight").alias("top"),
                                                F.collect_list(F.struct("id", "weight", *carried)).alias("entries"))
    return Index(postings, cut_lineage(blocks), terms)


def _hits(index: Index, wanted: DataFrame, last: Column, allowed) -> DataFrame:
    """``query_id, id, s``: the summed products of the wanted terms (``query_id, idx, qw, least``) with the entries of
    their first blocks; blocks whose largest weight stays under ``least`` are left out."""
    asked = wanted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last - 1)))
    met = asked.join(index.blocks, ["idx", "block"]).where(F.col("qw") * F.col("top") >= F.col("least"))
    each = met.select("query_id", "qw", *(["q_site"] if allowed is not None else []), F.explode("entries").alias("e"))
    if allowed is not None:
        each = each.where(allowed(F.col("q_site"), F.col("e.site")))
    return each.groupBy("query_id", F.col("e.id").alias("id")).agg(F.sum(F.col("qw") * F.col("e.weight")).alias("s"))


def best_matches(index: Index, requests: DataFrame, k: int, allowed=None, digits: int = 9) -> DataFrame:
    """``query_id, cand_id, similarity, rank`` of the k best texts that share a term with the request.

    ``requests``: ``query_id, idx, weight``, and ``site`` where ``allowed`` (a condition on the request's and the text's
    site) is given. Scores are rounded to ``digits`` before ranking; ties go to the smaller id.
    """
    carried = [F.col("site").alias("q_site")] if allowed is not None else []
    own = requests.select("query_id", "idx", F.col("weight").alias("qw"), *carried)
    terms = cut_lineage(own.join(index.terms, "idx").withColumn("bound", F.col("qw") * F.col("top")).drop("top"))

    # The floor: scores over the rarest terms, up to SEED postings.
    rarest = Window.partitionBy("query_id").orderBy("df", "idx")
    first = terms.withColumn("before", F.sum("df").over(rarest) - F.col("df")).where(F.col("before") < SEED)
    some = F.least("blocks", F.ceil((SEED - F.col("before")) / BLOCK).cast("long"))
    begun = top_k(_hits(index, first.withColumn("least", F.lit(0.0)), some, allowed), "query_id", [F.desc("s"), F.asc("id")], k)
    floors = begun.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("s") - SLACK).alias("floor"))

    # Essential terms: those after the bounds of the smaller ones have reached the floor.
    weakest, every = Window.partitionBy("query_id").orderBy("bound", "idx"), Window.partitionBy("query_id")
    planned = terms.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    planned = planned.withColumns({"sum": F.sum("bound").over(weakest), "all": F.sum("bound").over(every)})
    planned = planned.withColumn("essential", (F.col("floor") <= 0) | (F.col("sum") >= F.col("floor")))
    planned = planned.withColumn("rest", F.coalesce(F.max(F.when(~F.col("essential"), F.col("sum"))).over(every), F.lit(0.0)))
    planned = cut_lineage(planned)
    strong = planned.where("essential").withColumn("least", F.col("floor") - F.col("all") + F.col("bound"))
    scored = _hits(index, strong, F.col("blocks"), allowed)
    # Written, so that the optimizer knows how small it is and leaves the scores where they are.
    limits = small_side(planned.select("query_id", "floor", "rest").distinct())
    near = scored.join(limits, "query_id").where(F.col("s") + F.col("rest") >= F.col("floor")).select("query_id", "id", "s", "rest")
    near = cut_lineage(near)
    # The k-th best score over the essential terms is a higher floor: what stays under it with all the rest goes as well.
    lower = top_k(near, "query_id", [F.desc("s"), F.asc("id")], k).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) == k, F.min("s") - SLACK).alias("higher"))
    near = near.join(small_side(lower), "query_id", "left").where("higher IS NULL OR s + rest >= higher").drop("higher")
    near = cut_lineage(near)

    # What the other terms add to the survivors.
    weak = planned.where(~F.col("essential")).select("query_id", "idx", "qw")
    added = (near.where("rest > 0").select("query_id", "id").join(weak, "query_id")
             .join(index.postings.select("id", "idx", "weight"), ["id", "idx"])
             .select("query_id", "id", (F.col("qw") * F.col("weight")).alias("s")))
    whole = near.select("query_id", "id", "s").unionByName(added).groupBy("query_id", "id").agg(F.sum("s").alias("s"))
    return top_k(whole.select("query_id", F.col("id").alias("cand_id"), F.round("s", digits).alias("similarity")), "query_id",
                 [F.desc("similarity"), F.asc("cand_id")], k)


def matches(postings: DataFrame, requests: DataFrame, k: int, sites: tuple[DataFrame, DataFrame] | None = None, allowed=None,
            digits: int = 9) -> DataFrame:
    """``query_id, cand_id, similarity, rank`` of the k best texts that share a term with the request, by the index or,
    where a side has at most ``HELD`` weights, with that side held.

    ``postings`` (``id, idx, weight``) and ``requests`` (``query_id, idx, weight``) are written tables; ``sites`` are the
    texts' (``id, site``) and the requests' (``query_id, site``), for ``allowed``.
    """
    size = lambda df, key: df.agg(F.count(F.lit(1)).alias("weights"), F.approx_count_distinct(key).alias("texts")).first()
    asked, stored = size(requests, "query_id"), size(postings, "id")
    if min(asked.weights, stored.weights) > HELD:
        if allowed is not None:
            postings, requests = postings.join(sites[0], "id"), requests.join(sites[1], "query_id")
        return best_matches(build_index(postings), requests, k, allowed, digits)
    parts = max(postings.sparkSession.sparkContext.defaultParallelism, math.ceil(asked.texts * stored.texts / PAIRS))
    return held_matches(postings, requests, k, "requests" if asked.weights <= stored.weights else "corpus", parts, sites, allowed, digits)


def held_matches(postings: DataFrame, requests: DataFrame, k: int | None, hold: str, parts: int,
                 sites: tuple[DataFrame, DataFrame] | None = None, allowed=None, digits: int = 9) -> DataFrame:
    """The same, every pair scored. The side that ``hold`` names has at most ``HELD`` weights and is broadcast; the other is
    dealt by text over ``parts`` tasks, so a pair's products meet in one of them and a task sends on k texts a request.
    Without k all of them are returned, without a rank."""
    asked = requests.select("query_id", "idx", F.col("weight").alias("qw"))
    held, key, stream, by = (asked, "query_id", postings, "id") if hold == "requests" else (postings, "id", asked, "query_id")
    stream, also = stream.repartition(parts, by), []
    if allowed is not None:
        of_texts, of_requests = sites[0].select("id", "site"), sites[1].select("query_id", F.col("site").alias("q_site"))
        here, there = (of_requests, of_texts) if hold == "requests" else (of_texts, of_requests)
        stream, also = stream.join(there.repartition(parts, by), by), [c for c in there.columns if c != by]
    pairs = stream.join(F.broadcast(held), "idx").groupBy(by, key, *also).agg(F.sum(F.col("qw") * F.col("weight")).alias("s"))
    if allowed is not None:
        # Only texts with a weight count, so this is no larger than the held weights.
        pairs = pairs.join(F.broadcast(here.join(held.select(key).distinct(), key)), key).where(allowed(F.col("q_site"), F.col("site")))
    return _ranked(pairs, k, digits)


def _ranked(pairs: DataFrame, k: int | None, digits: int) -> DataFrame:
    """Scores ``s`` of ``query_id, id`` rounded; the k best with their rank, or all."""
    scored = pairs.select("query_id", F.col("id").alias("cand_id"), F.round("s", digits).alias("similarity"))
    return scored if k is None else top_k(scored, "query_id", [F.desc("similarity"), F.asc("cand_id")], k)


def every_pair(postings: DataFrame, requests: DataFrame, stored: DataFrame | None = None, asked: DataFrame | None = None,
               sites: tuple[DataFrame, DataFrame] | None = None, allowed=None, digits: int = 9) -> DataFrame:
    """``query_id, cand_id, similarity`` of all pairs that share a term; with ``stored`` (``id``) and ``asked`` (``query_id``)
    of all their pairs, 0 where none is shared.

    For that both sides get weights of 0 under numbers that stand for no term: every text meets every request under one of
    them, in the same join and grouping as the terms, and no product changes. As many pairs come out as there are; tasks hold
    about ``PAIRS`` of them. Where no side is held, numbers are cells of ``CELL`` requests by ``CELL`` texts, so none is hot.
    """
    size = lambda *parts: sum(df.count() for df in parts if df is not None)
    weights, texts = (size(requests, asked), size(postings, stored)), (size(asked), size(stored))
    held = min(weights) <= HELD
    if stored is not None:
        rows, columns = (1, 1) if held else (max(1, math.ceil(n / CELL)) for n in texts)
        cell = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
        each = lambda n, number: F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), number)).alias("idx")
        none = F.lit(0.0).alias("weight")
        requests = requests.select("query_id", "idx", "weight").unionByName(
            asked.select("query_id", each(columns, lambda j: cell("query_id", rows) * columns + j), none))
        postings = postings.select("id", "idx", "weight").unionByName(
            stored.select("id", each(rows, lambda i: i * columns + cell("id", columns)), none))
    if held:
        few = "requests" if weights[0] <= weights[1] else "corpus"
        parts = max(postings.sparkSession.sparkContext.defaultParallelism, math.ceil(texts[0] * texts[1] / PAIRS))
        return held_matches(postings, requests, None, few, parts, sites, allowed, digits)
    met = postings.join(requests.select("query_id", "idx", F.col("weight").alias("qw")), "idx")
    pairs = met.groupBy("query_id", "id").agg(F.sum(F.col("qw") * F.col("weight")).alias("s"))
    if allowed is not None:
        pairs = pairs.join(sites[0], "id").join(sites[1].withColumnRenamed("site", "q_site"), "query_id").where(
            allowed(F.col("q_site"), F.col("site")))
    return _ranked(pairs, None, digits)


def filled(found: DataFrame, requests: DataFrame, corpus: DataFrame, k: int, allowed=None) -> DataFrame:
    """``found`` with texts that share no term, similarity 0 and smallest ids first, where a request has fewer than k.

    ``requests`` and ``corpus``: ``id``, and ``site`` with ``allowed``. Such texts come from the smallest ids of the
    corpus. 2k ids are enough, of which fewer than k can be taken; with ``allowed`` the number grows until every request
    has its k or the corpus is at its end.
    """
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = requests.select(F.col("id").alias("query_id"), *(["site"] if allowed is not None else [])).join(counts, "query_id", "left")
    short = cut_lineage(short.withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < k))
    missing = short.count()
    if not missing:
        return found
    names = ["id"] + (["site"] if allowed is not None else [])
    size = 2 * k
    while True:
        pool = [tuple(r) for r in corpus.select(*names).orderBy("id").limit(size).collect()]
        if not pool:
            return found
        ids = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(row, names))) for row in pool))
        offered = short.withColumn("c", F.explode(ids))
        if allowed is not None:
            offered = offered.where(allowed(F.col("site"), F.col("c.site")))
        offered = offered.select("query_id", "n", F.col("c.id").alias("cand_id")).join(found, ["query_id", "cand_id"], "left_anti")
        added = top_k(offered, "query_id", [F.asc("cand_id")], k).where(F.col("rank") + F.col("n") <= k)
        if allowed is None or len(pool) < size or added.groupBy("query_id", "n").count().where(F.col("count") + F.col("n") >= k).count() == missing:
            break
        size *= 4
    added = added.select("query_id", "cand_id", F.lit(0.0).alias("similarity"), (F.col("rank") + F.col("n")).cast("int").alias("rank"))
    return found.unionByName(added)
