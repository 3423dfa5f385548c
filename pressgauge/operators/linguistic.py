"""The 28 linguistic features and the language-quality scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, functions as F

from pressgauge.functions import lexicons as L, text as X


@dataclass
class WordLists:
    """Lists the features count; any of them can be replaced."""

    clickbait: Sequence[Sequence[str]] = field(default_factory=lambda: L.CLICKBAIT)
    emotional: Sequence[str] = field(default_factory=lambda: L.EMOTIONAL)
    intensifiers: Sequence[str] = field(default_factory=lambda: L.INTENSIFIERS)
    tentative: Sequence[str] = field(default_factory=lambda: L.TENTATIVE)
    evidence: Sequence[str] = field(default_factory=lambda: L.EVIDENCE)
    professional: Sequence[str] = field(default_factory=lambda: L.PROFESSIONAL)
    balanced: Sequence[str] = field(default_factory=lambda: L.BALANCED)
    stop_words: Sequence[str] | None = None

    def stops(self) -> list[str]:
        return list(self.stop_words) if self.stop_words is not None else english_stop_words()


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def linguistic_features(df: DataFrame, text: str, lists: WordLists | None = None, raw: bool = False,
                        sentiment: Sequence[str] | None = None) -> DataFrame:
    """Append the 28 named double columns, in their fixed order.

    ``raw`` skips the normalisation, so that percent signs, money amounts and
    apostrophes can match. ``sentiment`` names existing polarity, subjectivity,
    intensity and balance columns; without them these features are 0.

    Three projections: normalise, split, count. Each expensive array is a named
    column that later expressions refer to, so it is computed once per row.
    """
    lists = lists or WordLists()
    body = F.coalesce(F.col(text), F.lit("")) if raw else X.normalize_text(F.col(text))
    stops = lists.stops()
    kept = [c for c in df.columns if c not in L.FEATURE_NAMES]
    base = df.withColumn("_t", body).withColumns({
        "_low": F.lower("_t"),
        "_words": X.words(F.col("_t")) if raw else X.blank_words(F.col("_t")),
        "_all": X.word_tokens(F.col("_t")),
    }).withColumns({
        "_tok": F.filter("_all", lambda w: (F.length(w) > 2) & ~w.isin(*stops)),
        # One pass finds the tokens that any list holds; the lists are counted on these few.
        "_listed": X.listed_tokens(F.col("_all"), *lists.clickbait, lists.emotional, lists.intensifiers, lists.tentative,
                                   lists.evidence, lists.professional, lists.balanced),
    })

    t, low, words, every, tokens = (F.col(c) for c in ("_t", "_low", "_words", "_listed", "_tok"))
    counted = base.withColumns({
        "_clickbait": X.count_alternations(every, low, lists.clickbait),
        "_emotional": X.count_listed(every, low, lists.emotional),
        "_intensifier": X.count_listed(every, low, lists.intensifiers),
        "_tentative": X.count_listed(every, low, lists.tentative),
        "_evidence": X.count_listed(every, low, lists.evidence),
        "_professional": X.count_listed(every, low, lists.professional),
        "_balanced": X.count_listed(every, low, lists.balanced),
        "_exclamations": X.count_char(t, "!"),
        "_questions": X.count_char(t, "?"),
        "_caps": F.size(F.filter(words, lambda w: (F.length(w) > 1) & X.is_upper(w))),
        "_sentences": F.size(X.non_blank(X.sentence_pieces(t))),
        "_refs": X.count_data_references(t),
        "_n": F.size(words),
        "_k": F.size(tokens),
        "_chars": X.total_length(words),
        "_repeat": X.repetition_ratio(tokens),
        "_unique": X.unique_ratio(tokens),
    })
    per_word = F.greatest(F.lit(1), F.col("_n"))
    per_token = F.greatest(F.lit(1), F.col("_k"))
    mood = [F.col(c) for c in sentiment] if sentiment else [F.lit(0.0)] * 4
    values = [
        F.col("_clickbait") / per_word, F.col("_emotional") / per_word, F.col("_exclamations") / per_word,
        F.col("_caps") / per_word, F.col("_questions") / per_word,
        *mood,
        F.col("_intensifier") / per_token, F.col("_tentative") / per_token, F.col("_evidence") / per_token,
        F.col("_professional") / per_token, F.col("_balanced") / per_token,
        F.col("_n") / F.greatest(F.lit(1), F.col("_sentences")), F.col("_chars") / per_word,
        F.length(t), F.col("_n"),
        F.col("_repeat"), F.col("_unique"),
        F.col("_caps"), F.col("_exclamations"), F.col("_questions"), F.col("_clickbait"), F.col("_emotional"),
        F.col("_professional"), F.col("_balanced"), F.col("_refs"),
    ]
    named = [v.cast("double").alias(n) for v, n in zip(values, L.FEATURE_NAMES)]
    return counted.select(*kept, *named)


def with_sentiment(features: DataFrame, mood: DataFrame, key: str, sentiment: Sequence[str]) -> DataFrame:
    """``features``, made without sentiment, with the polarity, subjectivity, intensity and balance columns of ``mood`` in
    their four places; rows without a score go. The same as ``sentiment`` columns given before, but no text is shuffled."""
    names = L.FEATURE_NAMES[5:9]
    four = mood.select(F.col(key), *[F.col(c).cast("double").alias(n) for c, n in zip(sentiment, names)])
    return features.drop(*names).join(four, key).select(*[c for c in features.columns if c not in L.FEATURE_NAMES], *L.FEATURE_NAMES)


def linguistic_features_inline(df: DataFrame, text: str, sentiment: Sequence[str] | None = None) -> DataFrame:
    """The shorter variant: no normalisation, all tokens, and list words counted by presence."""
    kept = [c for c in df.columns if c not in L.FEATURE_NAMES]
    base = df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumns({
        "_low": F.lower("_t"), "_words": X.words(F.col("_t")), "_all": X.word_tokens(F.col("_t"))})
    t, low, words, every = (F.col(c) for c in ("_t", "_low", "_words", "_all"))

    def present(entries: Sequence[str]) -> Column:
        return X._total([low.contains(e).cast("int") for e in entries])

    counted = base.withColumns({
        "_clickbait": X.count_alternations(every, low, L.INLINE_CLICKBAIT),
        "_emotional": present(L.INLINE_EMOTIONAL),
        "_intensifier": present(L.INLINE_INTENSIFIERS),
        "_tentative": present(L.INLINE_TENTATIVE),
        "_evidence": present(L.INLINE_EVIDENCE),
        "_professional": present(L.INLINE_PROFESSIONAL),
        "_balanced": present(L.INLINE_BALANCED),
        "_exclamations": X.count_char(t, "!"),
        "_questions": X.count_char(t, "?"),
        "_caps": F.size(F.filter(words, lambda w: (F.length(w) > 1) & X.is_upper(w))),
        "_sentences": F.size(X.non_blank(X.sentence_pieces(t))),
        "_refs": X.count_listed(every, low, L.INLINE_DATA_WORDS),
        "_n": F.size(words),
        "_k": F.size(every),
        "_chars": X.total_length(words),
        "_repeat": X.repetition_ratio(every),
        "_unique": X.unique_ratio(every),
    })
    per_word = F.greatest(F.lit(1), F.col("_n"))
    per_token = F.greatest(F.lit(1), F.col("_k"))
    mood = [F.col(c) for c in sentiment] if sentiment else [F.lit(0.0)] * 4
    values = [
        *[F.col(c) / per_word for c in ("_clickbait", "_emotional", "_exclamations", "_caps", "_questions")],
        *mood,
        *[F.col(c) / per_token for c in ("_intensifier", "_tentative", "_evidence", "_professional", "_balanced")],
        F.col("_n") / F.greatest(F.lit(1), F.col("_sentences")), F.col("_chars") / per_word,
        F.length(t), F.col("_n"), F.col("_repeat"), F.col("_unique"),
        *[F.col(c) for c in ("_caps", "_exclamations", "_questions", "_clickbait", "_emotional",
                             "_professional", "_balanced", "_refs")],
    ]
    return counted.select(*kept, *[v.cast("double").alias(n) for v, n in zip(values, L.FEATURE_NAMES)])


def simple_style_features(df: DataFrame, text: str) -> DataFrame:
    """Five-number fallback vector."""
    t = F.col(text)
    chars = F.greatest(F.length(t), F.lit(1))
    return df.withColumns({
        "words_k": X.whitespace_words(t) / 1000.0,
        "exclamations_per_char": X.count_char(t, "!") / chars,
        "questions_per_char": X.count_char(t, "?") / chars,
        "capitals_per_char": X.count_upper_letters(t) / chars,
        "constant": F.lit(0.5),
    })


def feature_breakdown(df: DataFrame) -> DataFrame:
    """The 28 features as five nested groups."""
    groups = {
        "sensationalism_indicators": L.FEATURE_NAMES[0:5] + L.FEATURE_NAMES[20:25],
        "sentiment_analysis": L.FEATURE_NAMES[5:9],
        "language_patterns": L.FEATURE_NAMES[9:14],
        "text_structure": L.FEATURE_NAMES[14:20],
        "content_quality": L.FEATURE_NAMES[25:28],
    }
    kept = [c for c in df.columns if c not in L.FEATURE_NAMES]
    return df.select(*kept, *[F.struct(*names).alias(group) for group, names in groups.items()])


def language_scores(df: DataFrame, title: str = "title", content: str = "content") -> DataFrame:
    """Capitalisation, punctuation, complexity, grammar and their mean, unrounded."""
    staged = df.withColumn("_txt", F.concat(F.col(title), F.lit(" "), F.col(content))).withColumns({
        "_pieces": X.sentence_pieces(F.col("_txt")), "_words": X.words(F.col("_txt"))})
    t, pieces, words = F.col("_txt"), F.col("_pieces"), F.col("_words")
    n = F.size(words)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    started = F.size(F.filter(pieces, lambda s: s.rlike(rf"^{X.SPACE}*\p{{Lu}}")))
    shouted = F.size(F.filter(words, lambda w: (F.length(w) > 2) & X.is_upper(w)))
    penalty = F.when(n > 0, F.least(F.lit(0.3), shouted / F.greatest(F.lit(1), n) * 2)).otherwise(F.lit(0.0))
    capitalization = F.when(F.size(pieces) < 2, F.lit(0.5)).otherwise(clamp(started / F.size(pieces) - penalty))
    punctuation = clamp(0.7 - F.least(F.lit(0.3), X.count_char(t, "!") / F.greatest(F.length(t), F.lit(1)) * 100))
    mean_length = X.total_length(words) / F.greatest(F.lit(1), n)
    complexity = (F.when(n == 0, 0.5).when(mean_length.between(4, 7), 0.8).when(mean_length < 4, 0.5)
                  .otherwise(0.6))
    errors = X.count_char(t, "  ") + X.count_matches(t, rf"{X.SPACE}+[.,!?]")
    grammar = F.greatest(F.lit(0.0), 1 - errors / F.greatest(n, F.lit(1)) * 10)
    return staged.withColumns({
        "capitalization": capitalization, "punctuation": punctuation,
        "complexity": complexity, "grammar": grammar,
    }).withColumn("language_score", (F.col("capitalization") * 0.25 + F.col("punctuation") * 0.25
                                     + F.col("complexity") * 0.25 + F.col("grammar") * 0.25)
                  ).drop("_txt", "_pieces", "_words")


def language_chart(df: DataFrame, key: str) -> DataFrame:
    """Bar-chart rows: label and value in percent."""
    rows = [F.struct(F.lit(n.capitalize()).alias("label"), F.round(F.col(n) * 100, 1).alias("value"))
            for n in ("capitalization", "punctuation", "complexity", "grammar")]
    return df.select(key, F.inline_outer(F.array(*rows)))


def language_score_simple(df: DataFrame, content: str = "content") -> DataFrame:
    """Mean of grammar by sentence length, clarity by length and structure by paragraphs."""
    c = F.col(content)
    n = X.whitespace_words(c)
    spoken = F.size(X.non_blank(F.split(c, r"\.", -1)))
    mean = n / F.greatest(spoken, F.lit(1))
    grammar = (F.when(mean.between(10, 30), 0.85)
               .when(((mean >= 5) & (mean < 10)) | ((mean > 30) & (mean <= 50)), 0.70).otherwise(0.55))
    clarity = F.when(n > 200, 0.80).when(n > 100, 0.70).otherwise(0.60)
    structure = F.when(F.size(F.split(c, "\n\n", -1)) > 3, 0.75).otherwise(0.65)
    return df.withColumns({"grammar_simple": grammar, "clarity_simple": clarity, "structure_simple": structure,
                           "language_simple": (grammar + clarity + structure) / 3.0})


def tone_keywords(df: DataFrame, text: str, positive: Sequence[str] = tuple(L.TONE_POSITIVE),
                  negative: Sequence[str] = tuple(L.TONE_NEGATIVE)) -> DataFrame:
    """Positive, negative and neutral share from two keyword lists."""
    t, low = F.col(text), F.lower(F.col(text))
    n = X.whitespace_words(t)
    tokens = F.col("_tone")
    staged = df.withColumn("_tone", X.word_tokens(t))
    share = lambda words: F.least(
        X.count_listed(tokens, low, words) / F.greatest(F.lit(1), n) * 10, F.lit(0.5))
    pos, neg = share(positive), share(negative)
    total = pos + neg + F.greatest(1.0 - pos - neg, F.lit(0.0))
    short = (F.length(X.strip(t)) < 3) | (n == 0)
    p = F.when(short, F.lit(0.33)).otherwise(F.round(pos / total, 2))
    g = F.when(short, F.lit(0.33)).otherwise(F.round(neg / total, 2))
    return staged.withColumns({"positive": p, "negative": g, "neutral": F.round(1.0 - p - g, 2)}).drop("_tone")
