"""Stored HTML pages and XML feeds turned into tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pressgauge.functions import lexicons as L, text as X, urls as U

PARSED = 64               # pages of which a worker holds the parts at once

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

PAGE_PARTS = T.StructType([
    T.StructField("h1", T.StringType()),
    T.StructField("title_tag", T.StringType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    T.StructField("time_value", T.StringType()),
    T.StructField("article_paragraphs", T.ArrayType(T.StringType())),
    T.StructField("paragraphs", T.ArrayType(T.StringType())),
    T.StructField("text_divs", T.ArrayType(T.StringType())),
    T.StructField("body_text", T.StringType()),
])


class _PageParts(HTMLParser):
    """Collects the raw parts the extraction rules choose from; decides nothing itself."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.first: dict[str, str] = {}
        self.meta: dict[str, str] = {}
        self.time_value: str | None = None
        self.open_texts: list[tuple[str, int, list[str]]] = []
        self.article: list[str] = []
        self.container_depth: dict[str, int] = {}
        self.by_container: dict[str, list[str]] = {"article": [], "main": [], "div": []}
        self.paragraphs: list[str] = []
        self.divs: list[str] = []
        self.body: list[str] = []

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = values.get("property") or values.get("name")
            if name and name not in self.meta:
                self.meta[name] = values.get("content", "")
        if tag == "time" and self.time_value is None:
            self.time_value = values.get("datetime") or None
        if tag == "p":
            self._close("p")
        if tag in _VOID:
            return
        self.stack.append((tag, values.get("class", "")))
        depth = len(self.stack)
        wanted = tag in ("h1", "title", "p", "time")
        cls = values.get("class", "")
        kind = tag if tag in ("article", "main") else "div" if tag == "div" and re.search(L.ARTICLE_CLASS, cls, re.I) else None
        if kind and kind not in self.container_depth and not self.by_container[kind]:
            self.container_depth[kind] = depth
        if wanted or (tag == "div" and re.search(L.TEXT_CLASS, cls, re.I)):
            self.open_texts.append((tag, depth, []))

    def _close(self, tag):
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                while len(self.stack) > at:
                    self._finish(len(self.stack))
                    self.stack.pop()
                return

    def _finish(self, depth):
        for item in [o for o in self.open_texts if o[1] == depth]:
            self.open_texts.remove(item)
            tag, _, chunks = item
            if tag == "div":
                text = " ".join(c.strip() for c in chunks if c.strip())
                self.divs.append(text)
                continue
            text = "".join(chunks).strip()
            if tag == "p":
                self.paragraphs.append(text)
                for kind in self.container_depth:
                    self.by_container[kind].append(text)
            elif tag == "time":
                self.time_value = self.time_value or text
            else:
                self.first.setdefault(tag, text)
        for kind, at in list(self.container_depth.items()):
            if at == depth:
                del self.container_depth[kind]

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        for _, _, chunks in self.open_texts:
            chunks.append(data)
        if not any(t in L.NON_CONTENT_TAGS for t, _ in self.stack) and data.strip():
            self.body.append(data.strip())

    def parts(self) -> dict:
        while self.stack:
            self._finish(len(self.stack))
            self.stack.pop()
        chosen = next((self.by_container[k] for k in ("article", "main", "div") if self.by_container[k]), [])
        return {"h1": self.first.get("h1"), "title_tag": self.first.get("title"), "meta": self.meta,
                "time_value": self.time_value, "article_paragraphs": chosen, "paragraphs": self.paragraphs,
                "text_divs": self.divs, "body_text": " ".join(self.body)}


def page_parts(html: str | None) -> dict:
    parser = _PageParts()
    parser.feed(html or "")
    parser.close()
    return parser.parts()


def parsed_batches(batches: Iterator[pa.RecordBatch], names: list[str], html: str) -> Iterator[pa.RecordBatch]:
    """Task: pages to their kept columns and parts, ``PARSED`` pages at a time, so that a worker never holds the parts of a
    whole batch."""
    texts = pa.list_(pa.string())
    types = {"meta": pa.map_(pa.string(), pa.string()), "article_paragraphs": texts, "paragraphs": texts, "text_divs": texts}
    for batch in batches:
        for lo in range(0, batch.num_rows, PARSED):
            some = batch.slice(lo, PARSED)
            parts = [page_parts(h.as_py()) for h in some.column(html)]
            for p in parts:
                p["meta"] = list(p["meta"].items())
            yield pa.RecordBatch.from_arrays(
                [*(some.column(n) for n in names), *(pa.array([p[n] for p in parts], types.get(n, pa.string())) for n in PAGE_PARTS.names)],
                names=[*names, *PAGE_PARTS.names])


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Raw parts of every page, in small Arrow batches. All choices between them are made by columns later."""
    keep = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType([*keep, *PAGE_PARTS.fields])
    names = [f.name for f in keep]
    return pages.mapInArrow(lambda batches: parsed_batches(batches, names, html), schema)


def _long(paragraphs: str, n: int) -> Column:
    return F.filter(F.col(paragraphs), lambda p: F.length(p) > n)


def extract_articles(pages: DataFrame, url: str = "url", html: str = "html", min_len: int = 50,
                     default_date: Column | None = None) -> DataFrame:
    """``title, content, source, published_at, published_on, domain`` of stored pages.

    Content comes from the first of four places that gives at least 100
    characters: paragraphs of the article element, all paragraphs without
    boilerplate, a substantial text division, the whole visible text. Pages
    that look binary or leave under ``min_len`` characters are dropped.
    """
    usable = pages.filter((F.length(html) >= 100) & ~X.looks_binary(F.col(html)))
    parts = parse_pages(usable, html)
    meta = lambda *names: F.coalesce(*[F.when(F.trim(F.try_element_at("meta", F.lit(n))) != "",
                                              F.trim(F.try_element_at("meta", F.lit(n)))) for n in names])
    enough = lambda c: F.when(F.length(c) >= 100, c)

    first = F.array_join(_long("article_paragraphs", 20), " ")
    plain = F.filter(_long("paragraphs", 30), lambda p: ~U.contains_any(F.lower(p), L.BOILERPLATE_PHRASES))
    division = F.get(F.filter("text_divs", lambda d: F.length(d) > 200), 0)
    content = F.coalesce(enough(first), enough(F.array_join(plain, " ")), enough(division), F.col("body_text"))
    heading = F.coalesce(F.col("h1"), F.col("title_tag"), F.lit(""))
    title = F.when(F.length(heading) < 10, F.coalesce(meta("og:title", "title"), heading)).otherwise(heading)
    domain = F.replace(U.host(F.col(url)), F.lit("www."), F.lit(""))
    label = F.when(domain.contains("."), F.initcap(U.first_label(domain))).otherwise(domain)
    published = F.coalesce(meta("article:published_time", "article:published"), F.trim("time_value"),
                           meta("publishdate", "date"), F.lit(""))
    keep = [c for c in pages.columns if c != html]
    out = parts.select(
        *keep, F.when(F.trim(title) == "", F.lit("Untitled Article")).otherwise(F.trim(title)).alias("title"),
        X.strip_unprintable(content).alias("content"),
        F.coalesce(meta("og:site_name", "application-name", "site-name"), label).alias("source"),
        published.alias("published_at"), X.parse_published(published, default_date).alias("published_on"),
        domain.alias("domain"))
    return out.filter(F.length("content") >= min_len)


def extract_dates(pages: DataFrame, html: str = "html", default_date: Column | None = None) -> DataFrame:
    """Publication day of each page, else ``default_date``."""
    parts = parse_pages(pages, html)
    value = F.coalesce(*[F.try_element_at("meta", F.lit(n)) for n in L.DATE_META], F.col("time_value"))
    keep = [c for c in pages.columns if c != html]
    return parts.select(*keep, X.parse_published(value, default_date).alias("published_on"))


def discover_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct article links of each site: absolute, same base domain, no query or fragment."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"))
    links = pages.select(F.col(url).alias("page_url"), F.explode_outer(hrefs).alias("href"))
    links = links.filter((F.col("href") != "") & ~F.col("href").startswith("#")
                         & ~F.col("href").startswith("javascript:"))
    full = links.select("page_url", U.absolute_url(F.col("page_url"), F.col("href")).alias("full"))
    same = U.base_domain(U.host(F.col("full"))) == U.base_domain(U.host(F.col("page_url")))
    return full.filter(same & U.is_article_link(F.col("full"))).select(
        U.base_domain(U.host(F.col("page_url"))).alias("site"),
        F.regexp_replace("full", r"(?s)[?#].*$", "").alias("link")).distinct()


def _xml(column: str) -> Column:
    """Drop characters XML does not allow and an in-document type declaration."""
    clean = F.regexp_replace(F.col(column), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.regexp_replace(clean, r"(?s)<!DOCTYPE[^>\[]*(\[.*?\])?>", "")


def feed_links(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Cleaned item links of RSS and entry links of Atom feeds, distinct."""
    doc = _xml(xml)
    rss = F.xpath(doc, F.lit('//*[local-name()="item"]/*[local-name()="link"][1]/text()'))
    atom = F.xpath(doc, F.lit('//*[local-name()="entry"]/*[local-name()="link"][1]/@href'))
    links = feeds.select(F.explode_outer(F.concat(rss, atom)).alias("link")).select(F.trim("link").alias("link"))
    return links.filter(F.col("link").startswith("http")).select(
        F.regexp_replace("link", r"(?s)[?#].*$", "").alias("link")).distinct()


def feed_items(feeds: DataFrame, key: str, xml: str = "xml", title: int | None = 150, snippet: int | None = 250) -> DataFrame:
    """Title, link, source, date and snippet per feed item, in feed order.

    Every item is cut out of the feed once; its fields are read from the item.
    """
    items = F.regexp_extract_all(_xml(xml), F.lit(r"(?s)(<(?:item|entry)[\s>].*?</(?:item|entry)>)"))
    rows = feeds.select(key, F.posexplode_outer(items).alias("pos", "item"))

    def field(*names: str) -> Column:
        body = [F.regexp_extract("item", rf"(?s)<{n}(?:\s[^>]*)?>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{n}>", 1)
                for n in names]
        return F.coalesce(*[F.when(F.trim(b) != "", F.trim(b)) for b in body])

    link = F.coalesce(field("link", "guid"), F.regexp_extract("item", r"<link[^>]*href=\"([^\"]+)\"", 1))
    source_url = F.regexp_extract("item", r"<source[^>]*url=\"([^\"]+)\"", 1)
    domain = U.domain_of(link)
    domain = F.when((domain == "news.google.com") & (source_url != ""), U.domain_of(source_url)).otherwise(domain)
    plain = lambda c: X.clean_html(X.decode_entities(c))
    cut = lambda c, n: F.substring(c, 1, n) if n else c
    return rows.select(
        key, (F.col("pos") + 1).alias("item_number"), cut(plain(field("title")), title).alias("title"),
        link.alias("link"), domain.alias("domain"), F.coalesce(plain(field("source")), domain).alias("source"),
        X.parse_published(field("pubDate", "published")).alias("published_on"),
        cut(F.coalesce(plain(field("description", "summary")), F.lit("")), snippet).alias("snippet"),
    ).filter(F.col("link") != "")


def sitemap_links(sitemaps: DataFrame, key: str, xml: str = "xml", scanned: int | None = None,
                  kept: int | None = None) -> DataFrame:
    """Article-like locations: the first ``scanned`` are looked at, at most ``kept`` are kept; None for all."""
    locations = F.xpath(_xml(xml), F.lit('//*[local-name()="url"]/*[local-name()="loc"]/text()'))
    rows = sitemaps.select(key, F.posexplode_outer(F.slice(locations, 1, scanned) if scanned else locations).alias("pos", "link")).select(
        key, "pos", F.trim("link").alias("link"))
    good = rows.filter(U.is_article_url_quick(F.col("link"))).groupBy(key, "link").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy(key).orderBy("pos")
    placed = good.withColumn("position", F.row_number().over(order))
    return (placed.filter(F.col("position") <= kept) if kept else placed).select(key, "position", "link")
