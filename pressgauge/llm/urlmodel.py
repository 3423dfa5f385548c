"""URL filter: suffix rules first, a character language-model ratio for the rest.

Two smoothed variable-order Markov models, of the URLs that rules allow and of those that rules block, give each
character its probability after up to ``ORDER`` characters. Each order is interpolated with the next shorter one by the
number of distinct followers (Witten-Bell); a context that was never seen leaves all weight to the shorter one. A URL's
score is the difference of its log-likelihoods by length. The threshold is calibrated on rule-judged URLs of a fold that
the models have not counted: the value that parts allowed from blocked best, both classes weighing the same.

Only DataFrame functions are used. Counts are taken over distinct URLs with their multiplicity, with map-side combining.
Scores are looked up per gram: grams that hold more than one ``HOT``-th of all positions, at most ``HOT`` of them, by
broadcast; all others by a shuffle in which no key can be hot.

Defined cases: a null URL, or one without "://", has an empty host and path; a null or empty URL has score 0; repeated
pages are judged each; rules of equal length: block wins; without URLs of both classes the threshold is 0 and both
models fall back to the shorter orders, at last to equal scores; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressgauge.llm.common import written

# The rules, as (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/"))
ORDER = 4
HOT = 4096
PAD = " " * ORDER
STEPS = 100           # bins of the calibration in one nat per character
REACH = 10            # nats per character from which scores share the outermost bins
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        cut = text.index("/")
        fits = ((host == text[:cut]) | host.endswith("." + text[:cut])) & path.startswith(text[cut:])
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def positions(urls: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``gram``: a row for each character of ``url``, with the ORDER characters before it."""
    padded = F.concat(F.lit(PAD), F.col("url"))
    grams = F.transform(F.sequence(F.lit(1), F.length("url")), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))
    return urls.where("url <> ''").select(*keep, F.explode(grams).alias("gram"))


def gram_scores(urls: DataFrame) -> DataFrame:
    """``gram, seen, ratio``: log-likelihood difference of every gram of ``urls`` (url, n, yes, no)."""
    counts = written(positions(urls, "n", "yes", "no").groupBy("gram").agg(
        F.sum("n").alias("seen"), F.sum("yes").alias("yes"), F.sum("no").alias("no")), "grams")
    lower = None
    for k in range(ORDER + 1):
        if k == ORDER:
            level = counts
        else:
            level = counts.groupBy(F.substring("gram", ORDER - k + 1, k + 1).alias("gram")).agg(
                F.sum("seen").alias("seen"), F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        level = level.withColumn("context", F.substring("gram", 1, k))
        after = level.groupBy("context").agg(*(x for c in ("yes", "no") for x in (
            F.sum(c).alias(f"{c}_all"), F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds"))))
        level = level.join(after, "context")
        if lower is None:
            level = level.withColumns({"p_yes": F.lit(1 / 256), "p_no": F.lit(1 / 256)})
        else:
            level = level.withColumn("rest", F.substring("gram", 2, k)).join(
                lower.select(F.col("gram").alias("rest"), "p_yes", "p_no"), "rest")
        for c in ("yes", "no"):
            whole = F.col(f"{c}_all") + F.col(f"{c}_kinds")
            level = level.withColumn(f"p_{c}", F.when(whole > 0, (
                F.col(c) + F.col(f"{c}_kinds") * F.col(f"p_{c}")) / F.when(whole > 0, whole)).otherwise(F.col(f"p_{c}")))
        lower = written(level.select("gram", "seen", "p_yes", "p_no"), "grams")
    return lower.select("gram", "seen", F.log(F.col("p_yes") / F.col("p_no")).alias("ratio"))


def url_scores(urls: DataFrame, grams: DataFrame) -> DataFrame:
    """``url, score`` of every row of ``urls``; both models' difference per character."""
    total = grams.agg(F.sum("seen")).first()[0] or 0
    each = positions(urls, "url")
    hot = F.col("seen") * HOT > F.lit(total)
    # Fewer than HOT grams can each hold more than one HOT-th of the positions: a proven bound.
    near = each.join(F.broadcast(grams.where(hot).select("gram", "ratio")), "gram", "left")
    far = near.where("ratio is null").drop("ratio").join(grams.where(~hot).select("gram", "ratio"), "gram")
    parts = [x.groupBy("url").agg(F.sum("ratio").alias("ratio")) for x in (near.where("ratio is not null"), far)]
    sums = reduce(DataFrame.unionByName, parts).groupBy("url").agg(F.sum("ratio").alias("ratio"))
    return sums.select("url", F.round(F.col("ratio") / F.length("url"), 9).alias("score"))


def threshold_of(held: DataFrame) -> float:
    """The score that parts ``verdict`` allow from block best, from a histogram of bounded size; 0 without both."""
    bin_no = F.greatest(F.least(F.floor(F.col("score") * STEPS), F.lit(REACH * STEPS)), F.lit(-REACH * STEPS))
    bins = held.groupBy(bin_no.alias("bin")).agg(F.sum((F.col("verdict") == "allow").cast("long")).alias("yes"),
                                                 F.sum((F.col("verdict") == "block").cast("long")).alias("no"))
    down, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    yes, no = F.sum("yes").over(every), F.sum("no").over(every)
    gain = (yes - F.coalesce(F.sum("yes").over(down), F.lit(0))) / yes + F.coalesce(F.sum("no").over(down), F.lit(0)) / no
    best = (bins.select("bin", F.round(F.when((yes > 0) & (no > 0), gain), 9).alias("gain")).where("gain is not null")
            .orderBy(F.desc("gain"), F.abs("bin"), "bin").first())
    return best["bin"] / STEPS if best else 0.0


def judge(pages: DataFrame, rules=RULES, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page."""
    host, path = host_and_path(F.col("url"))
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    narrow = narrow.withColumns({"rule": rule, "says": says})
    fold = F.substring(F.md5(F.col("url").cast("binary")), 1, 1).isin("0", "1", "2")
    distinct = written(narrow.where("url is not null").groupBy("url", "says").agg(F.count("*").alias("n"))
                       .withColumn("held", fold), "urls")
    counted = distinct.select("url", "n", F.when((F.col("says") == "allow") & ~F.col("held"), F.col("n")).otherwise(0).alias("yes"),
                              F.when((F.col("says") == "block") & ~F.col("held"), F.col("n")).otherwise(0).alias("no"))
    grams = gram_scores(counted)
    wanted = distinct.where("says is null or held")
    scores = written(url_scores(wanted, grams).join(wanted.select("url", "says"), "url"), "url-scores")
    threshold = threshold_of(scores.where("says is not null").select("score", F.col("says").alias("verdict")))
    mine = F.when(F.coalesce(F.col("score"), F.lit(0.0)) >= threshold, "allow").otherwise("block")
    open_pages = narrow.where("says is null").join(scores.where("says is null").select("url", "score"), "url", "left")
    columns = ["page_id", "host", "path", "rule"]
    return (narrow.where("says is not null").select(*columns, F.col("says").alias("verdict"))
            .unionByName(open_pages.select(*columns, mine.alias("verdict"))))


def oracle_sql() -> str:
    """The same in DuckDB SQL over ``pages``, order by order."""
    rule, says = "NULL", "NULL"
    for verdict, text in sorted(RULES, key=lambda r: (len(r[1]), r[0] == "block")):
        cut = text.index("/")
        fits = f"(host = '{text[:cut]}' OR ends_with(host, '.{text[:cut]}')) AND starts_with(path, '{text[cut:]}')"
        rule, says = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{verdict}' ELSE {says} END"
    parts = [f"""
WITH cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS tail
             FROM pages),
split AS (SELECT page_id, url, translate(regexp_extract(coalesce(tail, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(coalesce(tail, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (SELECT *, {rule} AS rule, {says} AS says FROM split),
urls AS (SELECT url, says, count(*) AS n, substring(md5(url), 1, 1) IN ('0', '1', '2') AS held
         FROM judged WHERE url IS NOT NULL GROUP BY url, says),
counted AS (SELECT url, n, CASE WHEN says = 'allow' AND NOT held THEN n ELSE 0 END AS yes,
                   CASE WHEN says = 'block' AND NOT held THEN n ELSE 0 END AS no FROM urls),
each AS (SELECT url, n, yes, no, unnest(list_transform(range(1, length(url) + 1),
                lambda i: substring('{PAD}' || url, i, {ORDER + 1}))) AS gram FROM counted),
d{ORDER} AS (SELECT gram, sum(yes) AS yes, sum(no) AS no FROM each GROUP BY gram)"""]
    for k in range(ORDER):
        parts.append(f"""
d{k} AS (SELECT substring(gram, {ORDER - k + 1}, {k + 1}) AS gram, sum(yes) AS yes, sum(no) AS no FROM d{ORDER} GROUP BY 1)""")
    for k in range(ORDER + 1):
        base = ", 1 / 256.0::DOUBLE AS q_yes, 1 / 256.0::DOUBLE AS q_no" if k == 0 else ", l.p_yes AS q_yes, l.p_no AS q_no"
        join = "" if k == 0 else f" JOIN s{k - 1} l ON l.gram = substring(d.gram, 2, {k})"
        smooth = ", ".join(f"CASE WHEN a_{c} + t_{c} > 0 THEN ({c} + t_{c} * q_{c}) / (a_{c} + t_{c})::DOUBLE ELSE q_{c} END AS p_{c}"
                           for c in ("yes", "no"))
        parts.append(f"""
c{k} AS (SELECT substring(gram, 1, {k}) AS context, sum(yes) AS a_yes, sum(no) AS a_no, count(*) FILTER (yes > 0) AS t_yes,
                count(*) FILTER (no > 0) AS t_no FROM d{k} GROUP BY 1),
s{k} AS (SELECT gram, {smooth} FROM (SELECT d.gram, d.yes::DOUBLE AS yes, d.no::DOUBLE AS no, a_yes, a_no, t_yes, t_no{base}
         FROM d{k} d JOIN c{k} c ON c.context = substring(d.gram, 1, {k}){join}))""")
    parts.append(f"""
scores AS (SELECT u.url, any_value(u.says) AS says, any_value(u.held) AS held, round(sum(ln(p_yes / p_no)) / length(u.url), 9) AS score
           FROM urls u JOIN each e ON e.url = u.url JOIN s{ORDER} s ON s.gram = e.gram GROUP BY u.url),
bins AS (SELECT greatest(least(floor(score * {STEPS}), {REACH * STEPS}), {-REACH * STEPS}) AS bin,
                count(*) FILTER (says = 'allow') AS yes, count(*) FILTER (says = 'block') AS no
         FROM scores WHERE held AND says IS NOT NULL GROUP BY 1),
gains AS (SELECT bin, sum(yes) OVER () AS ally, sum(no) OVER () AS alln,
                 coalesce(sum(yes) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y,
                 coalesce(sum(no) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z FROM bins),
best AS (SELECT coalesce((SELECT bin / {STEPS} FROM gains WHERE ally > 0 AND alln > 0
                          ORDER BY round((ally - y) / ally::DOUBLE + z / alln::DOUBLE, 9) DESC, abs(bin), bin LIMIT 1), 0) AS t)
SELECT page_id, host, path, rule, coalesce(j.says, CASE WHEN coalesce(s.score, 0) >= (SELECT t FROM best) THEN 'allow' ELSE 'block' END) AS verdict
FROM judged j LEFT JOIN scores s ON s.url = j.url""")
    return ",".join(parts)
