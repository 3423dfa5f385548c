"""Text expressions. All of them are built-in columns; none leaves the JVM.

``WORD`` and ``SPACE`` spell out the Unicode classes that a word character and
white space mean here, so the meaning does not depend on a regex dialect's own
``\\w`` and ``\\s``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import cache
from html.entities import html5

from pyspark.sql import Column, functions as F

from pressgauge.functions import lexicons as L

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"


def literal_regex(text: str) -> str:
    """Quote ``text`` for use inside a pattern."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def whole(alternatives: Sequence[str], quoted: bool = True) -> str:
    """Pattern matching any alternative as a whole word or phrase.

    Quoted alternatives are looked for only where one of their first characters stands.
    """
    parts = [literal_regex(a) if quoted else a for a in alternatives]
    first = f"(?=[{''.join(sorted({literal_regex(a[0]) for a in alternatives}))}])" if quoted and all(alternatives) else ""
    return f"{first}(?<!{WORD})(?:{'|'.join(parts)})(?!{WORD})"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space; ends are stripped."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def text_full(title: Column, text: Column) -> Column:
    """Title, blank line, text."""
    return F.concat(title, F.lit("\n\n"), text)


def single_space_words(text: Column) -> Column:
    """Number of pieces between single spaces; empty pieces count."""
    return F.size(F.split(text, " ", -1))


def words(text: Column) -> Column:
    """Maximal runs of non-space characters, in order."""
    return F.array_remove(F.split(text, f"{SPACE}+", -1), "")


def blank_words(text: Column) -> Column:
    """``words`` of a text whose only white space is the blank, as ``normalize_text`` leaves it; no pattern is needed."""
    return F.array_remove(F.split(text, " ", -1), "")


def whitespace_words(text: Column) -> Column:
    """Number of words by any white space; empties never count."""
    return F.regexp_count(text, F.lit(f"{NOT_SPACE}+"))


def word_tokens(text: Column) -> Column:
    """Lower-case runs of word characters, in order."""
    return F.array_remove(F.split(F.lower(text), f"[^{WORD[1:-1]}]+", -1), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_text(text: Column) -> Column:
    """Clean text for the linguistic features.

    The order matters and is kept: white space is collapsed first, so the
    spaces put in by the later removals stay. A pass that needs a certain
    character is skipped for texts without it.
    """
    def gated(found, pattern: str):
        return lambda t: F.when(found(t), F.regexp_replace(t, pattern, " ")).otherwise(t)

    # Single blanks need no change, so only other white space and longer runs match.
    out = F.regexp_replace(F.coalesce(text, F.lit("")),
                           rf"[\t-\r\x1c-\x1f\x{{85}}\p{{Z}}&&[^ ]]{SPACE}*| {SPACE}+", " ")
    out = let(out, gated(lambda t: t.contains("http") | t.contains("www."),
                         rf"https?://{NOT_SPACE}+|www\.{NOT_SPACE}+"))
    # A match can only begin where a run of non-space characters begins.
    out = let(out, gated(lambda t: t.contains("@"), rf"(?<!{NOT_SPACE}){NOT_SPACE}[^@{SPACE[1:-1]}]*+@{NOT_SPACE}+"))
    out = let(out, gated(lambda t: t.contains("<"), "<[^\n]*?>"))
    # Most characters are settled by the first class. Blanks are the only white space left.
    return F.trim(F.regexp_replace(out, r"[[^a-z ]&&[^\p{L}\p{N}_.!?]]", " "))


def content_tokens(text: Column, stop_words: Sequence[str]) -> Column:
    """Word tokens of more than two characters that are not stop words."""
    return F.filter(word_tokens(text), lambda w: (F.length(w) > 2) & ~w.isin(*stop_words))


def count_char(text: Column, char: str) -> Column:
    """Occurrences of one literal string, non-overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))) / F.lit(len(char))).cast("int")


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_phrases(text: Column, phrases: Sequence[str]) -> Column:
    """Whole matches of literal phrases; a text that holds none of them is not searched by the pattern."""
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return F.when(found, count_matches(text, whole(phrases))).otherwise(F.when(text.isNotNull(), 0))


def count_patterns(text: Column, patterns: Sequence[str]) -> Column:
    """Sum of matches over patterns; a span matched by two patterns counts twice."""
    return _total([count_matches(text, p) for p in patterns])


def count_data_references(text: Column, patterns: Sequence[str] = tuple(L.DATA_REFERENCE_PATTERNS)) -> Column:
    """``count_patterns`` of the data references; a pattern that needs a mark is left out for texts without it."""
    terms = []
    for pattern in patterns:
        count = count_matches(text, pattern)
        mark = next((m for p, m in ((r"%", "%"), (r"\$", "$"), (r"\.", ".")) if p in pattern), None)
        terms.append(F.when(text.contains(mark), count).otherwise(F.when(text.isNotNull(), 0)) if mark else count)
    return _total(terms)


def count_words(text: Column, entries: Sequence[str]) -> Column:
    """Whole-word matches summed over list entries; a repeated entry counts twice."""
    lowered = F.lower(text)
    return _total([count_matches(lowered, whole([e])) for e in entries])


def count_listed(tokens: Column, lowered: Column, entries: Sequence[str]) -> Column:
    """``count_words`` on already split tokens.

    Entries made of word characters only are looked up in the token array (one
    hash probe per token); phrases that cannot overlap share one pass.
    """
    return count_alternations(tokens, lowered, [[e] for e in entries])


def count_alternations(tokens: Column, lowered: Column, groups: Sequence[Sequence[str]]) -> Column:
    """``count_patterns`` for alternations of literal words and phrases.

    Single words are counted on the token array. Phrases that cannot overlap
    are counted in one pass over the text, whatever group they come from; a
    group whose own phrases can overlap keeps its own pattern, in which they
    exclude each other.
    """
    plain = [w for g in groups for w in g if re.fullmatch(r"\w+", w)]
    terms = [_count_in(tokens, layer) for layer in _layers(plain)]
    loose: list[str] = []
    for group in groups:
        phrases = [p for p in group if not re.fullmatch(r"\w+", p)]
        if any(_overlap(p, q) for p in phrases for q in phrases if p != q):
            terms.append(count_phrases(lowered, phrases))
        else:
            loose += phrases
    terms += [count_phrases(lowered, batch) for batch in _batches(loose)]
    return _total(terms)


def _overlap(a: str, b: str) -> bool:
    """Whether occurrences of two different phrases can share text."""
    shorter = min(len(a), len(b))
    return a in b or b in a or any(a[-n:] == b[:n] or b[-n:] == a[:n] for n in range(1, shorter)
                                   if _edge(a, n, True) and _edge(b, n, False) or _edge(b, n, True) and _edge(a, n, False))


def _edge(phrase: str, n: int, tail: bool) -> bool:
    """Whether the last (or first) ``n`` characters are cut at a word boundary."""
    pair = phrase[-n - 1:][:2] if tail else phrase[n - 1:n + 1]
    return len(pair) == 2 and not (pair[0].isalnum() and pair[1].isalnum())


def _batches(phrases: Sequence[str]) -> list[list[str]]:
    """Phrases in batches without overlaps; a repeated phrase goes to another batch."""
    batches: list[list[str]] = []
    for phrase in phrases:
        for batch in batches:
            if all(phrase != q and not _overlap(phrase, q) for q in batch):
                batch.append(phrase)
                break
        else:
            batches.append([phrase])
    return batches


def _count_in(tokens: Column, entries: Sequence[str]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(*entries)))


def listed_tokens(tokens: Column, *lists: Sequence[str]) -> Column:
    """The tokens that are in any of the lists: ``count_listed`` finds the same in them as in all."""
    entries = sorted({w for entries in lists for w in entries if re.fullmatch(r"\w+", w)})
    return F.filter(tokens, lambda w: w.isin(*entries)) if entries else F.slice(tokens, 1, 0)


def _layers(entries: Sequence[str]) -> list[list[str]]:
    """Split a list with repeats into lists without, so that repeats count again."""
    layers: list[list[str]] = []
    for entry in entries:
        for layer in layers:
            if entry not in layer:
                layer.append(entry)
                break
        else:
            layers.append([entry])
    return layers


def _total(terms: list[Column]) -> Column:
    out = F.lit(0)
    for term in terms:
        out = out + term
    return out


def is_upper(word: Column) -> Column:
    """At least one upper-case letter and no other cased letter."""
    return word.rlike(r"^[^\p{Lu}\p{Ll}\p{Lt}]*+\p{Lu}[^\p{Ll}\p{Lt}]*+\z")


def count_upper_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Lu}"))


def sentence_pieces(text: Column) -> Column:
    """Pieces between runs of ``.!?``; an empty tail is a piece too."""
    return F.split(text, "[.!?]+", -1)


def non_blank(pieces: Column) -> Column:
    return F.filter(pieces, lambda s: s.rlike(NOT_SPACE))


def sentences(text: Column) -> Column:
    """Stripped sentences: the text is cut after ``.``, ``!`` or ``?`` and white space."""
    cut = F.split(text, rf"(?<=[.!?]){SPACE}+", -1)
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def total_length(parts: Column) -> Column:
    """Characters in an array of strings."""
    return F.length(F.array_join(parts, ""))


def repetition_ratio(tokens: Column) -> Column:
    """Distinct tokens that occur more than once, as a share of distinct tokens."""
    repeated = let(F.sort_array(tokens), lambda ordered: F.size(F.array_distinct(
        F.filter(ordered, lambda w, i: w == F.get(ordered, i + 1)))))
    return repeated / F.greatest(F.lit(1), F.size(F.array_distinct(tokens)))


def unique_ratio(tokens: Column) -> Column:
    return F.size(F.array_distinct(tokens)) / F.greatest(F.lit(1), F.size(tokens))


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared distinct words over all distinct words; 0 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


@cache
def _named_entities() -> dict[str, str]:
    """Every named character reference that ends in a semicolon, from the standard library's table."""
    return {"&" + name: value for name, value in html5.items() if name.endswith(";")}


def decode_entities(text: Column) -> Column:
    """Numeric and named character references, each decoded once; unknown ones stay.

    All references of a text are found in one pass; each distinct one is then replaced, "&amp;" last, so that what it
    uncovers is not decoded again.
    """
    table = F.from_json(F.lit(json.dumps(_named_entities())), "map<string,string>")

    def one(ref: Column) -> Column:
        hexed = ref.rlike("^&#[xX]")
        digits = F.regexp_extract(ref, "([0-9A-Fa-f]+);$", 1)
        code = F.when(hexed, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        valid = code.isNotNull() & (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        code = F.when(valid, code).otherwise(F.lit(0xFFFD))
        utf16 = F.when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise(
            F.concat(F.lpad(F.hex(F.lit(0xD800) + ((code - 0x10000) / 1024).cast("int")), 4, "0"),
                     F.lpad(F.hex(F.lit(0xDC00) + F.pmod(code - 0x10000, F.lit(1024))), 4, "0")))
        return F.when(ref.startswith("&#"), F.decode(F.unhex(utf16), "UTF-16BE")).otherwise(F.coalesce(table[ref], ref))

    found = F.array_distinct(F.regexp_extract_all(text, F.lit("(&(?:#(?:[xX][0-9A-Fa-f]{1,12}|[0-9]{1,15})|[A-Za-z][A-Za-z0-9]{1,31});)")))
    last = F.array(F.lit("&amp;"), F.lit("&AMP;"), F.lit("&#38;"), F.lit("&#x26;"))
    refs = F.concat(F.array_except(found, last), F.array_intersect(found, last))
    return F.when(F.size(refs) > 0, F.aggregate(refs, text, lambda acc, ref: F.replace(acc, ref, one(ref)))).otherwise(text)


def clean_html(text: Column) -> Column:
    """Tags out, entities decoded, white space collapsed."""
    return strip(F.regexp_replace(decode_entities(F.regexp_replace(text, "<[^\n]*?>", "")), f"{SPACE}+", " "))


def strip_unprintable(text: Column) -> Column:
    """Letters, numbers, punctuation, symbols and spaces of the basic plane; the rest becomes a space."""
    out = F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}\p{{P}}\p{{S}}\t-\r\x1c-\x20\x{{85}}\p{{Z}}]", " ")
    out = F.regexp_replace(out, r"[\x{10000}-\x{10FFFF}]", " ")
    return collapse(out)


def truncate_at_word(text: Column, n: int = 1000) -> Column:
    """Cut to ``n`` characters, back to the last space, with an ellipsis."""
    head = F.substring(text, 1, n)
    at_space = F.when(head.contains(" "), F.regexp_extract(head, "(?s)^(.*) ", 1)).otherwise(head)
    return F.when(F.length(text) > n, F.concat(at_space, F.lit("..."))).otherwise(text)


def parse_published(text: Column, default: Column | None = None) -> Column:
    """Date from the accepted article and feed formats, else ``default``."""
    head = F.substring(text, 1, 19)
    day = F.coalesce(
        F.try_to_timestamp(head, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(head, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(head, F.lit("d/M/yyyy")),
        F.try_to_timestamp(head, F.lit("M/d/yyyy")),
    ).cast("date")
    # Feed dates: drop the weekday name and the zone, keep the calendar day.
    rfc = F.regexp_extract(text, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1)
    feed = F.try_to_timestamp(F.when(rfc != "", rfc), F.lit("d MMM yyyy")).cast("date")
    return F.coalesce(day, feed, default if default is not None else F.lit(None).cast("date"))


def looks_binary(text: Column) -> Column:
    """More than 100 NULs, or any NUL with under 70 % printable characters."""
    nul = F.regexp_count(text, F.lit(r"\x00"))
    printable = F.regexp_count(text, F.lit(r"[\t\n\r\x20-\x7e]|[^\p{C}\p{Z}]")) / F.greatest(F.lit(1), F.length(text))
    return (nul > 100) | ((printable < 0.7) & (nul > 0))
