"""URL expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from pressgauge.functions import lexicons as L


def clean_url(url: Column) -> Column:
    """Scheme, host and path only, without trailing slashes."""
    return F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*$", ""), "/+$", "")


def article_id(url: Column) -> Column:
    """Key of an ingested article."""
    return F.md5(clean_url(url))


def request_id(url: Column) -> Column:
    """Key of an analysed article: the URL as given."""
    return F.md5(url)


def normalized_url(url: Column) -> Column:
    """Lower-cased, without outer blanks and trailing slashes."""
    return F.regexp_replace(F.lower(F.trim(url)), "/+$", "")


def domain_raw(url: Column) -> Column:
    """Everything between scheme and first slash: port and ``www.`` stay."""
    return F.regexp_replace(F.regexp_replace(url, "https?://", ""), "(?s)/.*", "")


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*://)?([^/?#]*)", 1)


def domain_of(url: Column) -> Column:
    """Lower-cased host without ``www.``; a missing scheme is accepted."""
    return F.lower(F.replace(host(url), F.lit("www."), F.lit("")))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*://)?[^/?#]*([^?#]*)", 1)


def base_domain(domain: Column) -> Column:
    """Last two labels."""
    return F.substring_index(domain, ".", -2)


def first_label(domain: Column) -> Column:
    return F.substring_index(domain, ".", 1)


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | text.contains(needle)
    return out


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def is_article_url_strict(url: Column) -> Column:
    """Deep enough path, no listing page, and an article mark or a long path."""
    path = path_of(url)
    rejected = (F.length(path) < 5) | contains_any(F.lower(path), L.STRICT_REJECT)
    return ~rejected & (contains_any(path, L.STRICT_INDICATORS) | (F.length(path) > 10))


def is_article_url_quick(url: Column) -> Column:
    """No media or listing page, and a year, a long number or two path segments."""
    path = F.lower(path_of(url))
    return ~contains_any(path, L.QUICK_SKIP) & (
        path.rlike(r"/202[0-9]|/2030|\d{6,}") | (F.size(path_segments(path)) >= 2))


def is_article_link(url: Column) -> Column:
    """Link test used when walking a page: skip list, then six alternative signs."""
    path = path_of(url)
    lowered = F.lower(path)
    segments = path_segments(path)
    depth = F.size(segments)
    last = F.coalesce(F.element_at(F.concat(F.array(F.lit("")), segments), -1), F.lit(""))
    slug = ((F.length(last) - F.length(F.replace(last, F.lit("-"), F.lit(""))) >= 2)
            & F.length(last).between(15, 200) & last.rlike("[a-z]"))
    signs = (
        path.rlike("/202[0-9]|/2030")
        | (contains_any(lowered, L.LINK_KEYWORDS) & (depth >= 2))
        | path.rlike(r"\p{Nd}{6,}")
        | slug
        | ((depth >= 3) & F.exists(segments, lambda s: F.length(s) > 20))
        | path.rlike(r"/\p{Nd}{4}[/-]\p{Nd}{1,2}[/-]\p{Nd}{1,2}")
    )
    return ~contains_any(lowered, L.LINK_SKIP) & signs


def strip_host_prefixes(domain: Column) -> Column:
    """Drop leading mobile, edition and country labels."""
    pattern = "^(?:" + "|".join(p.replace(".", r"\.") for p in L.HOST_PREFIXES) + ")+"
    return F.regexp_replace(F.lower(domain), pattern, "")


def _strip_anywhere(domain: Column) -> Column:
    out = F.lower(domain)
    for prefix in L.HOST_PREFIXES:
        out = F.replace(out, F.lit(prefix), F.lit(""))
    return out


def is_reliable(domain: Column, sources: Sequence[str], legacy: bool = False) -> Column:
    """Flexible match against a list of reliable sources.

    Equal, contained either way, or the same first label of four or more
    characters. The empty domain is not reliable. ``legacy`` removes the
    prefixes anywhere in the name and lets the empty domain match.
    """
    clean = _strip_anywhere(domain) if legacy else strip_host_prefixes(domain)
    names = F.array(*[F.lit(s.replace("www.", "")) for s in sources])
    hit = F.exists(names, lambda s: s.eqNullSafe(clean) | clean.contains(s) | s.contains(clean) | (
        (F.length(first_label(s)) >= 4) & (first_label(s) == first_label(clean))))
    if legacy:
        return F.coalesce(hit, F.lit(False))
    return F.coalesce((clean != "") & hit, F.lit(False))


def credible_by_substring(domain: Column, domains: Sequence[str]) -> Column:
    """Any listed domain occurs inside the lower-cased domain."""
    cleaned = [d.lower().replace("www.", "") for d in domains]
    return contains_any(F.lower(domain), cleaned) if cleaned else F.lit(True)


def source_tier(domain: Column) -> Column:
    """Credibility of an outlet by tier."""
    out = F.lit(L.TIER_DEFAULT)
    for value, names in reversed(L.TIERS):
        out = F.when(domain.isin(*names), F.lit(value)).otherwise(out)
    return out


def same_site(a: Column, b: Column) -> Column:
    """Equal, contained either way, or the same first label."""
    return (a == b) | a.contains(b) | b.contains(a) | (first_label(a) == first_label(b))


def absolute_url(base: Column, href: Column) -> Column:
    """Resolve a link against the page it stands on."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.concat(root, F.regexp_replace(F.when(path_of(base) == "", F.lit("/")).otherwise(path_of(base)), "[^/]*$", ""))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, path_of(base), href))
        .otherwise(F.concat(folder, href))
    )
