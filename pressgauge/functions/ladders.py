"""Score bands and their wording."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ladder(score: Column, steps: list[tuple[float, object]], other: object) -> Column:
    """First step whose threshold ``score`` reaches, highest first."""
    threshold, value = steps[0]
    out = F.when(score >= threshold, F.lit(value))
    for threshold, value in steps[1:]:
        out = out.when(score >= threshold, F.lit(value))
    return out.otherwise(F.lit(other))


def percent(score: Column) -> Column:
    """0-1 score as a whole number of percent, halves up."""
    return F.floor(score * 100 + 0.5).cast("int")


def verdict(overall: Column) -> Column:
    return ladder(percent(overall), [(70, "HIGH CREDIBILITY"), (40, "MEDIUM CREDIBILITY")], "LOW CREDIBILITY")


def interpret_sensationalism(score: Column) -> Column:
    """Level, wording and colour of a sensationalism score."""
    def row(level: str, description: str, color: str) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(description).alias("description"),
                        F.lit(color).alias("color"))

    return (
        F.when(score < 0.3, row("Low", "Professional, balanced reporting", "green"))
        .when(score < 0.7, row("Moderate", "Some sensational elements present", "orange"))
        .otherwise(row("High", "Highly sensational or biased content", "red"))
    )


def credibility_band(score: Column) -> Column:
    return ladder(score, [(0.7, "real"), (0.4, "mixed")], "fake")


def relevance_status(score: Column) -> Column:
    return ladder(score, [(0.7, "Relevant"), (0.4, "Moderate")], "Weak")


# Status wording of the four credibility metrics (fixed values): 85 / 70 / 50 / below.
_STATUS = {
    "domain_age": ("Established", "Mature", "Moderate", "New/Unknown"),
    "url_structure": ("Professional", "Good", "Standard", "Suspicious"),
    "site_structure": ("Excellent", "Good", "Adequate", "Poor"),
    "content_format": ("Professional", "Good", "Standard", "Low Quality"),
}


def metric_status(kind: str, score: Column) -> Column:
    top, high, mid, low = _STATUS[kind]
    return ladder(score, [(85, top), (70, high), (50, mid)], low)


# Fallback wording of the metrics (fixed values).
_DESCRIPTION = {
    "url_structure": ([(85, "Professional domain structure with trusted TLD"),
                       (70, "Well-structured domain name with news indicators"),
                       (50, "Standard domain structure without red flags")],
                      "Domain structure shows suspicious patterns"),
    "site_structure": ([(70, "Professional news site structure"),
                        (50, "Standard website structure for news content")],
                       "Site structure lacks professional news indicators"),
    "content_format": ([(85, "Professional article formatting with proper structure"),
                        (70, "Well-formatted content with news article indicators"),
                        (50, "Standard content formatting")],
                       "Content format shows quality concerns"),
}


def metric_description(kind: str, score: Column) -> Column:
    steps, other = _DESCRIPTION[kind]
    return ladder(score, steps, other)


def corroboration_status(score: Column) -> Column:
    return ladder(score, [(0.7, "Strong Corroboration"), (0.5, "Moderate Corroboration"),
                          (0.3, "Weak Corroboration")], "No Corroboration")


def relevance_scale(similarity: Column) -> Column:
    """Stretch small cosine values over 0.1 to 0.9."""
    scaled = (
        F.when(similarity > 0.1, 0.7 + (similarity - 0.1) * 2.0)
        .when(similarity > 0.05, 0.4 + (similarity - 0.05) * 6.0)
        .otherwise(0.1 + similarity * 6.0)
    )
    return F.least(F.lit(0.9), F.greatest(F.lit(0.1), scaled))


def relevance_fallback(rank: Column, title: Column, snippet: Column) -> Column:
    """Relevance by position (0-based) where texts cannot be compared."""
    good = (F.length(title) > 20).cast("int") + (F.length(snippet) > 50).cast("int")
    bonus = F.when(good == 2, 0.1).when(good == 1, 0.05).otherwise(0.0)
    return F.least(F.lit(0.9), F.greatest(F.lit(0.2), 0.8 - rank * 0.1 + bonus))


def title_overlap(title_words: Column, query_words: Column) -> Column:
    """Share of the query's distinct words found in a title, scaled by 0.8."""
    wanted = F.size(F.array_distinct(query_words))
    common = F.size(F.array_intersect(title_words, query_words))
    share = common / F.greatest(F.lit(1), wanted) * 0.8
    return F.when(wanted > 0, F.least(F.lit(0.9), F.greatest(F.lit(0.3), share))).otherwise(F.lit(0.5))
