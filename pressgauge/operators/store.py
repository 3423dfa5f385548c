"""Reading from, matching against and merging into an article store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressgauge.functions import ladders, urls as U
from pressgauge.operators.cleaning import dedup_first, unseen
from pressgauge.session import cut_lineage

# Characters of the substrings by which containment is joined.
GRAM = 8
# Keys of a store's buckets that one pass of a merge holds in every task, 8 bytes each.
MERGE_KEYS = 1_000_000


def scan_store(spark: SparkSession, path: str) -> DataFrame:
    """Every stored article, older files widened to the newest layout."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write_buckets(df: DataFrame, path: str, mode: str) -> None:
    """Write rows into their buckets' folders; tasks hold the buckets' files open side by side, so no row is sorted."""
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, "4096")
    try:
        df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    finally:
        conf.set(name, before)


def write_store(df: DataFrame, path: str, key: str = "id", buckets: int = 64) -> None:
    """Store articles in folders by hash of the key. ``buckets`` is fixed for the store's life: choose it so that a bucket
    of the largest store is what a few tasks rewrite; all rows of a key share one."""
    _write_buckets(df.withColumn("bucket", _bucket(key, buckets)), path, "overwrite")


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def merge_store(spark: SparkSession, path: str, batch: DataFrame, key: str = "id", order: Sequence[str] = ("ingested_at",),
                buckets: int = 64, insert_only: bool = False, merge_keys: int = MERGE_KEYS) -> int:
    """Merge a batch into a store of ``write_store`` and return the number of buckets that were rewritten.

    The latest row of a key wins, by ``order``, the batch's at a tie; with ``insert_only`` stored keys stay and the first
    row of the batch by ``order`` is added. Who wins is settled on keys and order columns alone. Then only buckets that a
    winner of the batch falls into are rewritten, by dynamic partition overwrite; other files are not touched. The stored
    rows of such buckets pass through one filter, against hashes of the keys to leave out: at most ``merge_keys`` of them
    are held by a task, more take further passes over other buckets. Neither stored nor new texts are sorted, and the
    stored ones are not shuffled.

    A repeated merge of the same batch leaves the same rows.
    """
    # The batch is read several times: once for its keys, once for each pass.
    held = cut_lineage(batch.withColumn("bucket", _bucket(key, buckets)).withColumn("_at", F.monotonically_increasing_id()))
    rank = F.struct(*order, "_at")
    pick = F.min(rank) if insert_only else F.max(rank)
    new = held.where(F.col(key).isNotNull()).groupBy("bucket", key).agg(pick.alias("_new"))
    stored = read_buckets(spark, path)
    touched = held.select("bucket").distinct()
    known = stored.join(F.broadcast(touched), "bucket", "left_semi").groupBy("bucket", key).agg(
        F.max(F.struct(*order)).alias("_old"))
    both = new.join(known, ["bucket", key], "left")
    wins = F.col("_old").isNull() if insert_only else F.col("_old").isNull() | (F.struct(*(F.col(f"_new.{c}") for c in order)) >= F.col("_old"))
    winners = cut_lineage(both.where(wins).select("bucket", key, F.col("_new._at").alias("_at"), F.col("_old").isNotNull().alias("replaces")))
    sizes = {r.bucket: r.n for r in winners.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    columns = [c for c in stored.columns if c != "bucket"]
    group, size, done = [], 0, 0
    for n, bucket in enumerate(sorted(sizes), 1):
        group.append(bucket)
        size += sizes[bucket]
        if size < merge_keys and n < len(sizes):
            continue
        mine = winners.where(F.col("bucket").isin(group))
        # At most merge_keys and one bucket's keys.
        out = F.broadcast(mine.where("replaces").select(key, "bucket"))
        old = stored.where(F.col("bucket").isin(group)).join(out, ["bucket", key], "left_anti")
        fresh = held.where(F.col("bucket").isin(group)).join(F.broadcast(mine.select("_at")), "_at", "left_semi").drop("_at")
        _write_buckets(old.unionByName(fresh, allowMissingColumns=True).select(*columns, "bucket"), path, "overwrite")
        done += len(group)
        group, size = [], 0
    return done


def upsert_articles(existing: DataFrame, batch: DataFrame, key: str = "id",
                    order: Sequence[str] = ("ingested_at",)) -> DataFrame:
    """Union in which the latest row per key wins, as an aggregate (no window over hot keys)."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(
        batch.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "_new"]
    rest = [c for c in columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order, "_new"))
    return both.groupBy(key).agg(newest.alias("_row")).select(key, "_row.*").select(*columns)


def insert_if_absent(existing: DataFrame, batch: DataFrame, key: str = "url",
                     order: Sequence[str] = ("id",)) -> DataFrame:
    """Existing rows plus the first row of the batch per new key."""
    fresh = dedup_first(unseen(batch, existing, key), key, order)
    return existing.unionByName(fresh, allowMissingColumns=True)


def lookup_by_url(store: DataFrame, requests: DataFrame, key: str = "url") -> DataFrame:
    """Stored rows of the requested URLs. The optimizer broadcasts a small request side."""
    return store.join(requests.select(key).distinct(), key, "left_semi")


def lookup_by_url_loose(store: DataFrame, requests: DataFrame, url: str = "source_url",
                        min_len: int = 100) -> DataFrame:
    """One stored article per requested URL: equal, or contained either way, when normalised.

    Equal URLs and the best row of each are settled first, so only distinct strings are compared. Containment is found by
    ``contained``; what is left per request is the smallest (not equal, length, URL, id).
    """
    wanted = requests.select(U.normalized_url(F.col("url")).alias("u")).where("u IS NOT NULL").distinct()
    usable = store.filter(F.length("content") > min_len).where(F.col(url).isNotNull())
    row = F.struct(F.length(url).alias("length"), F.col(url).alias("url"), F.col("id"))
    held = usable.groupBy(U.normalized_url(F.col(url)).alias("u")).agg(F.min(row).alias("best"))
    wanted, held = cut_lineage(wanted), cut_lineage(held)
    strings = held.select("u")
    inner = contained(wanted, strings).select(F.col("needle").alias("request"), F.col("hay").alias("u"))
    outer = contained(strings, wanted).select(F.col("hay").alias("request"), F.col("needle").alias("u"))
    pairs = inner.unionByName(outer).join(held, "u")
    best = pairs.groupBy("request").agg(F.min(F.struct((F.col("request") != F.col("u")).alias("other"), "best")).alias("m"))
    found = best.select("request", F.col("m.best.id").alias("id"), F.col("m.best.url").alias(url))
    rest = [c for c in store.columns if c not in ("id", url)]
    whole = found.join(usable, ["id", url])
    # Rows that repeat id and URL are the same article.
    return whole.groupBy("request", "id", url).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_row")).select(
        "request", "id", url, "_row.*").select("request", *store.columns) if rest else whole.select("request", *store.columns).distinct()


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters; none of a shorter text."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(size))))).otherwise(
        F.array().cast("array<string>"))


def contained(needles: DataFrame, hays: DataFrame, size: int = GRAM) -> DataFrame:
    """``needle, hay``: every pair of distinct strings ``u`` of which the second contains the first.

    A needle's key is its rarest substring of ``size`` characters, by the number of hays that have it (a shorter needle is
    its own key): whatever contains the needle has that substring too. A needle with a substring that no hay has is
    dropped before the join. Hays are exploded into hashes of their substrings, so the join moves two numbers a row;
    the strings meet only where a key is shared, and ``contains`` decides.
    """
    needles = cut_lineage(needles.select("u").distinct().withColumn("n_id", F.monotonically_increasing_id()))
    hays = cut_lineage(hays.select("u").distinct().withColumn("h_id", F.monotonically_increasing_id()))
    # At most ``size`` numbers: the lengths of needles that are too short for a whole substring.
    short = [r.n for r in needles.select(F.length("u").alias("n")).where(F.col("n") < size).distinct().collect()]
    every = F.concat(*(_grams(F.col("u"), n) for n in [*sorted(n for n in short if n), size]))
    if 0 in short:
        every = F.concat(every, F.array(F.lit("")))
    hashed = lambda df, grams, key: df.select(key, F.explode(grams).alias("g")).select(key, F.xxhash64("g").alias("g"))
    in_hays = hashed(hays, every, "h_id")
    counts = in_hays.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    own = F.when(F.length("u") >= size, _grams(F.col("u"), size)).otherwise(F.array("u"))
    keys = hashed(needles, own, "n_id").join(counts, "g", "left")
    rarest = keys.groupBy("n_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("k")).where("k.df > 0")
    shared = rarest.select("n_id", F.col("k.g").alias("g")).join(in_hays, "g").select("n_id", "h_id")
    met = shared.join(needles.withColumnRenamed("u", "needle"), "n_id").join(hays.withColumnRenamed("u", "hay"), "h_id")
    return met.where(F.col("hay").contains(F.col("needle"))).select("needle", "hay")


def comparison_set(store: DataFrame, exclude_id) -> DataFrame:
    return store.filter(F.col("id") != exclude_id)


def article_count(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("articles"))


def split_cached(requests: DataFrame, cache: DataFrame, url: str = "url") -> DataFrame:
    """Requests with their cached analysis where there is one, and ``is_cached``."""
    keyed = requests.withColumn("id", U.request_id(F.col(url)))
    kept = cache.withColumn("_hit", F.lit(True))
    return keyed.join(kept.drop(url), "id", "left").withColumn(
        "is_cached", F.coalesce("_hit", F.lit(False))).drop("_hit")


def browse(store: DataFrame, min_score: float = 0.0, sort_by: str = "analyzed_at") -> DataFrame:
    """Store listing: score filter, newest or highest first, short titles."""
    title = F.when(F.length("title") > 60, F.concat(F.substring("title", 1, 60), F.lit("..."))).otherwise(
        F.col("title"))
    return store.filter(F.col("overall_score") >= min_score).orderBy(F.desc(sort_by), "id").select(
        "id", title.alias("title"), F.coalesce("source", F.lit("N/A")).alias("source"),
        ladders.percent(F.col("overall_score")).alias("score"),
        ladders.percent(F.col("credibility_score")).alias("credibility"),
        F.coalesce(F.substring(F.col("analyzed_at").cast("string"), 1, 10), F.lit("N/A")).alias("date"), "url")


def export_rows(store: DataFrame) -> DataFrame:
    """Rows of the CSV export: scores as whole percents."""
    return store.select(
        F.col("title").alias("Title"), F.coalesce("source", F.lit("N/A")).alias("Source"),
        F.col("url").alias("URL"),
        *[ladders.percent(F.col(c)).alias(n) for c, n in (
            ("overall_score", "Overall Score"), ("credibility_score", "Credibility"),
            ("language_score", "Language"), ("cross_check_score", "Cross-Check"))],
        F.coalesce(F.substring(F.col("analyzed_at").cast("string"), 1, 10), F.lit("N/A")).alias("Date"))
