"""Valence sentiment with a lexicon table, and sentence-level flow."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressgauge.functions import lexicons as L, text as X
from pressgauge.operators.lexicon import word_mask
from pressgauge.session import small_side

# Longest phrase boosters, looked up on the two or three words before.
_PHRASE_BOOSTERS = [p for p in L.BOOSTERS_DOWN if " " in p]
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _tokens(text: Column) -> Column:
    """Words without surrounding punctuation; what is left of up to two characters is kept whole."""
    def bare(word: Column) -> Column:
        inner = F.btrim(word, F.lit(_PUNCTUATION))
        return F.when(F.length(inner) <= 2, word).otherwise(inner)

    return F.transform(X.words(text), bare)


def _booster(word: Column) -> Column:
    low = F.lower(word)
    return (F.when(low.isin(*L.BOOSTERS_UP), F.lit(L.BOOST))
            .when(low.isin(*L.BOOSTERS_DOWN), F.lit(-L.BOOST)).otherwise(F.lit(0.0)))


def _negates(word: Column) -> Column:
    return F.coalesce(F.lower(word).isin(*L.NEGATIONS) | F.lower(word).contains("n't"), F.lit(False))


def _charged_tokens(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Lexicon tokens of every document, with neighbours, and one summary row (``i`` = -1) per document.

    ``w, low`` is the token, ``p1 p2 p3`` the words before and ``n1 n2`` the words after it, ``lv`` its valence, ``k_*``
    whether a neighbour is in the lexicon. A mask of the lexicon's words leaves few other tokens to explode, one join
    decides, and neighbours that are in the lexicon are lexicon tokens of the same document at the place before or behind.
    """
    lex = lexicon.groupBy(F.lower("word").alias("lw")).agg(F.max(F.col("valence").cast("double")).alias("lv"))
    lex = small_side(lex.where("lw IS NOT NULL AND lv IS NOT NULL"))
    listed = word_mask(lex, "lw")

    staged = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn(
        "_w", _tokens(F.col("_t"))).withColumn("_l", F.transform("_w", F.lower))
    w, low, n = F.col("_w"), F.col("_l"), F.size("_w")
    caps = F.size(F.filter(w, X.is_upper))
    asks = X.count_char(F.col("_t"), "?")
    emphasis = F.least(X.count_char(F.col("_t"), "!"), F.lit(4)) * 0.292 + (
        F.when(asks <= 1, F.lit(0.0)).when(asks <= 3, asks * 0.18).otherwise(F.lit(0.96)))
    neighbours = {"p1": -1, "p2": -2, "p3": -3, "n1": 1, "n2": 2}

    def at(words: Column, i: Column, shift: int) -> Column:
        return F.when(i + shift >= 0, F.get(words, i + shift))

    def row(i: Column) -> Column:
        return F.struct(i.alias("i"), F.get(w, i).alias("w"), F.get(low, i).alias("low"),
                        *[at(w, i, s).alias(c) for c, s in neighbours.items()])

    places = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: listed(F.get(low, i)) & (i < n))
    text_null = F.lit(None).cast("string")
    summary = F.array(F.struct(F.lit(-1).alias("i"), text_null.alias("w"), text_null.alias("low"),
                               *[text_null.alias(c) for c in neighbours]))
    # Document figures and the token rows are settled before the explode, so
    # that a token row carries a few small columns and not the text.
    per_doc = staged.select(
        key, n.alias("n"), (F.array_position(low, "but") - 1).cast("int").alias("but"),
        ((caps > 0) & (caps < n)).alias("cap_diff"), emphasis.alias("emphasis"),
        F.concat(summary, F.transform(places, row)).alias("_x"))
    exploded = per_doc.select(key, "n", "but", "cap_diff", "emphasis", F.explode_outer("_x").alias("x")).select(
        key, "n", "but", "cap_diff", "emphasis", "x.*")
    # Summary rows have no word: each gets a key of its own that no word has, or they would all meet in one task.
    met = exploded.withColumn("_j", F.coalesce("low", F.concat(F.lit(" "), F.xxhash64(key).cast("string"))))
    hit = met.join(lex, met["_j"] == lex["lw"], "left").drop("_j", "lw").where((F.col("i") == -1) | F.col("lv").isNotNull())
    order = Window.partitionBy(key).orderBy("i")
    near = {f"b{d}": F.lag("i", d).over(order) for d in (1, 2, 3)} | {"a1": F.lead("i").over(order)}
    hit = hit.withColumns(near)

    def found(shift: int, columns: tuple[str, ...]) -> Column:
        there = reduce(or_, [F.coalesce(F.col(c) == F.col("i") + shift, F.lit(False)) for c in columns])
        return F.when(there & (F.col("i") + shift >= 0), True)

    return hit.withColumns({"k_p1": found(-1, ("b1",)), "k_p2": found(-2, ("b1", "b2")), "k_p3": found(-3, ("b1", "b2", "b3")),
                            "k_n1": found(1, ("a1",))}).drop(*near)


def sentiment_scores(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """``compound``, ``pos``, ``neg``, ``neu`` per document.

    ``lexicon`` is a dictionary table ``(word, valence)`` of any size. Every lexicon token carries its neighbours along;
    lexicon tokens alone are shuffled, by document, once for the neighbours' flags and the sums.

    The contrast rule for "but" weighs words by position in the text.
    """
    hit = _charged_tokens(df, key, text, lexicon)
    word, lower = F.col("w"), F.col("low")
    p = [F.lower(F.col(c)) for c in ("p1", "p2", "p3")]
    is_no = lambda c: F.coalesce(c == "no", F.lit(False))
    valence = F.when((lower == "no") & F.col("k_n1").isNotNull(), F.lit(0.0)).otherwise(F.col("lv"))
    valence = F.when(
        is_no(p[0]) | is_no(p[1]) | (is_no(p[2]) & F.coalesce(p[0].isin("or", "nor"), F.lit(False))),
        F.col("lv") * L.NEGATION_SCALE).otherwise(valence)
    hit = hit.withColumn("v", valence)
    hit = hit.withColumn("v", F.when(
        X.is_upper(word) & F.col("cap_diff"),
        F.when(F.col("v") > 0, F.col("v") + L.CAPS_BOOST).otherwise(F.col("v") - L.CAPS_BOOST)).otherwise(F.col("v")))

    for distance, name in enumerate(("p1", "p2", "p3")):
        prev = F.col(name)
        usable = prev.isNotNull() & F.col(f"k_{name}").isNull()
        push = _booster(prev)
        signed = F.when(F.col("v") < 0, -push).otherwise(push)
        shouted = F.when((push != 0) & X.is_upper(prev) & F.col("cap_diff"), F.when(
            F.col("v") > 0, signed + L.CAPS_BOOST).otherwise(signed - L.CAPS_BOOST)).otherwise(signed)
        damp = (1.0, 0.95, 0.9)[distance]
        hit = hit.withColumn("v", F.when(usable, F.col("v") + shouted * damp).otherwise(F.col("v")))
        hit = hit.withColumn("v", F.when(usable, _negation(F.col("v"), p, distance)).otherwise(F.col("v")))
        if distance == 2:
            hit = hit.withColumn("v", F.when(usable, _phrases(F.col("v"), lower, p)).otherwise(F.col("v")))
    least = (p[0] == "least") & F.col("k_p1").isNull() & ~F.coalesce(p[1].isin("at", "very"), F.lit(False))
    hit = hit.withColumn("v", F.when(F.coalesce(least, F.lit(False)), F.col("v") * L.NEGATION_SCALE).otherwise(F.col("v")))
    # Boosters and "kind of" never carry valence of their own.
    silent = lower.isin(*L.BOOSTERS_UP, *L.BOOSTERS_DOWN) | (
        (lower == "kind") & F.coalesce(F.lower("n1") == "of", F.lit(False)))
    contrast = F.when(F.col("but") >= 0, F.when(F.col("i") < F.col("but"), 0.5).when(
        F.col("i") > F.col("but"), 1.5).otherwise(1.0)).otherwise(1.0)
    hit = hit.withColumn("v", F.when(F.col("i") == -1, F.lit(0.0)).when(silent, F.lit(0.0)).otherwise(
        F.col("v") * contrast))

    v = F.col("v")
    per = hit.groupBy(key).agg(
        F.max("n").alias("n"), F.max("emphasis").alias("e"), F.sum("v").alias("s"),
        F.sum(F.when(v > 0, v + 1).otherwise(0.0)).alias("up"),
        F.sum(F.when(v < 0, 1 - v).otherwise(0.0)).alias("down"),
        F.count_if((v != 0)).alias("charged"))
    e = F.col("e")
    s = F.when(F.col("s") > 0, F.col("s") + e).when(F.col("s") < 0, F.col("s") - e).otherwise(F.col("s"))
    up = F.when(F.col("up") > F.col("down"), F.col("up") + e).otherwise(F.col("up"))
    down = F.when(F.col("up") < F.col("down"), F.col("down") + e).otherwise(F.col("down"))
    neutral = F.col("n") - F.col("charged")
    total = up + down + neutral
    share = lambda c: F.round(F.when(total > 0, c / total).otherwise(F.lit(0.0)), 3)
    return per.select(
        key,
        F.round(s / F.sqrt(s * s + L.COMPOUND_ALPHA), 4).alias("compound"),
        share(up).alias("pos"), share(down).alias("neg"), share(neutral.cast("double")).alias("neu"))


def _negation(v: Column, p: list[Column], distance: int) -> Column:
    so = lambda c: F.coalesce(c.isin("so", "this"), F.lit(False))
    doubt = lambda c: F.coalesce(c == "doubt", F.lit(False))
    here = p[distance]
    flipped = F.when(_negates(here), v * L.NEGATION_SCALE).otherwise(v)
    if distance == 0:
        return flipped
    if distance == 1:
        return (F.when((here == "never") & so(p[0]), v * 1.25)
                .when((here == "without") & doubt(p[0]), v).otherwise(flipped))
    return (F.when(((here == "never") & so(p[1])) | so(p[0]), v * 1.25)
            .when((here == "without") & (doubt(p[1]) | doubt(p[0])), v).otherwise(flipped))


def _phrases(v: Column, low: Column, p: list[Column]) -> Column:
    """Fixed-valence phrases ending at or following the word, then phrase boosters before it."""
    gram = lambda *parts: F.concat_ws(" ", *parts)
    n1, n2 = F.lower("n1"), F.lower("n2")
    before = [gram(p[0], low), gram(p[1], p[0], low), gram(p[1], p[0]), gram(p[2], p[1], p[0]), gram(p[2], p[1])]
    after = [F.when(n2.isNotNull(), gram(low, n1, n2)), F.when(n1.isNotNull(), gram(low, n1))]
    special = F.create_map(*[F.lit(x) for pair in L.SPECIAL_PHRASES.items() for x in pair])
    out = F.coalesce(*[F.try_element_at(special, seq) for seq in (*after, *before)], v)
    for seq in (before[3], before[4], before[2]):
        out = F.when(seq.isin(*_PHRASE_BOOSTERS), out - L.BOOST).otherwise(out)
    return out


def sentiment_features(scores: DataFrame) -> DataFrame:
    """Polarity, intensity and balance from the scores."""
    gap = F.abs(F.col("pos") - F.col("neg"))
    return scores.withColumns({"sentiment_polarity": F.col("compound"), "sentiment_intensity": gap,
                               "sentiment_balance": 1.0 - gap})


def subjectivity(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Mean subjectivity of the lexicon words in a document; 0 where there are none."""
    lex = small_side(lexicon.where("word IS NOT NULL").select("word", "subjectivity"))
    listed = word_mask(lex, "word")
    tokens = df.select(key, F.explode_outer(F.filter(X.word_tokens(F.col(text)), listed)).alias("word"))
    # Documents without such a word get a key of their own.
    tokens = tokens.withColumn("word", F.coalesce("word", F.concat(F.lit(" "), F.xxhash64(key).cast("string"))))
    return tokens.join(lex, "word", "left").groupBy(key).agg(
        F.coalesce(F.avg("subjectivity"), F.lit(0.0)).alias("sentiment_subjectivity"))


def split_sentences(df: DataFrame, key: str, text: str, limit: int | None = None,
                    cut: int | None = None) -> DataFrame:
    """One row per sentence with its 1-based number."""
    parts = X.sentences(F.col(text))
    if limit is not None:
        parts = F.slice(parts, 1, limit)
    rows = df.select(key, F.posexplode_outer(parts).alias("pos", "sentence")).filter(F.col("pos").isNotNull())
    sentence = F.substring("sentence", 1, cut) if cut else F.col("sentence")
    return rows.select(key, (F.col("pos") + 1).alias("sentence_number"), sentence.alias("sentence"))


def sentiment_flow(df: DataFrame, key: str, text: str, lexicon: DataFrame, limit: int | None = None,
                   cut: int | None = None) -> DataFrame:
    """Sentiment of every sentence, in order."""
    rows = split_sentences(df, key, text, limit).withColumn(
        "_sid", F.struct(F.col(key), F.col("sentence_number")))
    scores = sentiment_scores(rows, "_sid", "sentence", lexicon)
    shown = F.substring("sentence", 1, cut) if cut else F.col("sentence")
    return rows.join(scores, "_sid").select(
        key, "sentence_number", shown.alias("sentence"), "compound", "pos", "neg", "neu")


def sentence_summary(flow: DataFrame, key: str) -> DataFrame:
    return flow.groupBy(key).agg(F.count(F.lit(1)).alias("total_sentences"),
                                 F.avg("compound").alias("avg_sentiment"))
