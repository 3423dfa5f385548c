"""Source credibility: WHOIS records, domain rules and the combined score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from pressgauge.functions import ladders, lexicons as L, text as X, urls as U
from pressgauge.schema import WHOIS_JSON
from pressgauge.session import small_side


@dataclass
class SourceLists:
    """Domain lists of the credibility rules; any of them can be replaced."""

    reliable: Sequence[str] = field(default_factory=lambda: L.RELIABLE_SOURCES)
    problem: Mapping[str, str] = field(default_factory=lambda: L.PROBLEM_SOURCES)
    long_standing: Sequence[str] = field(default_factory=lambda: L.LONG_STANDING_DOMAINS)
    mid_age: Sequence[str] = field(default_factory=lambda: L.MID_AGE_DOMAINS)

    def table(self, spark) -> DataFrame:
        """The lists as one dictionary table; its size is that of the lists."""
        names = sorted({*self.reliable, *self.problem, *self.long_standing, *self.mid_age})
        rows = [(d, d in self.reliable, self.problem.get(d), d in self.long_standing, d in self.mid_age)
                for d in names]
        return spark.createDataFrame(
            rows, "dict_domain string, reliable boolean, issue string, long_standing boolean, mid_age boolean")


def parse_whois(df: DataFrame, raw: str, as_of: Column, keep: Sequence[str] = ("domain",)) -> DataFrame:
    """Columns of a WHOIS answer; ages and day counts are taken at ``as_of``.

    Rows without a readable creation date come out unverified.
    """
    r = df.withColumn("_r", F.from_json(raw, WHOIS_JSON).getField("WhoisRecord"))
    top = lambda f: F.col(f"_r.{f}")
    registry = lambda f: F.col(f"_r.registryData.{f}")
    filled = lambda c: F.when(c != "", c)
    day = lambda c: F.try_to_timestamp(F.substring_index(c, "T", 1), F.lit("yyyy-MM-dd")).cast("date")

    created = day(F.coalesce(registry("createdDate"), filled(top("createdDate"))))
    expires = F.coalesce(filled(registry("expiresDate")), filled(top("expiresDate")))
    updated = F.coalesce(filled(registry("updatedDate")), filled(top("updatedDate")))
    registrar = F.coalesce(filled(top("registrarName")), registry("registrarName"), F.lit(""))
    registrant = F.coalesce(top("registrant"), registry("registrant"))
    person = F.coalesce(registrant.getField("name"), F.lit(""))
    org = F.coalesce(filled(registrant.getField("organization")), person)
    mail = F.lower(F.coalesce(registrant.getField("email"), F.lit("")))
    private = (U.contains_any(F.lower(org), L.PRIVACY_WORDS) | U.contains_any(F.lower(person), L.PRIVACY_WORDS)
               | mail.contains("redacted") | mail.contains("privacy"))
    # Name servers and status codes come as a list, a list inside an object, or plain text.
    servers_text = F.coalesce(top("nameServers"), F.lit(""))
    servers = F.coalesce(
        F.from_json(F.get_json_object(servers_text, "$.hostNames"), "array<string>"),
        F.when(servers_text.startswith("["), F.from_json(servers_text, "array<string>")),
        F.array().cast("array<string>"))
    status_text = F.coalesce(filled(registry("status")), filled(top("status")), F.lit(""))
    statuses = (F.when(status_text == "", F.array().cast("array<string>"))
                .when(status_text.startswith("["), F.from_json(status_text, "array<string>"))
                .otherwise(F.array(status_text)))
    joined = F.lower(F.array_join(servers, " "))
    hosting = F.lit("Unknown")
    for needle, name in reversed(L.HOSTING_PROVIDERS):
        hosting = F.when(joined.contains(needle), F.lit(name)).otherwise(hosting)
    signed = F.lower(F.coalesce(filled(registry("dnssec")), top("dnssec"), F.lit("")))
    verified = created.isNotNull()
    return r.select(
        *keep,
        verified.alias("verified"),
        F.round(F.datediff(as_of, created) / 365.25, 2).alias("age_years"),
        created.alias("created_date"),
        registrar.alias("registrar"),
        U.contains_any(F.lower(registrar), [t.lower() for t in L.TRUSTED_REGISTRARS]).alias("registrar_trusted"),
        private.alias("privacy_protected"),
        F.when(private, F.lit("")).otherwise(org).alias("registrant_org"),
        F.when(verified, F.lit("active")).alias("status"),
        F.substring_index(expires, "T", 1).alias("expires_date"),
        F.datediff(day(expires), as_of).alias("days_until_expiry"),
        F.substring_index(updated, "T", 1).alias("updated_date"),
        F.datediff(as_of, day(updated)).alias("days_since_update"),
        servers.alias("name_servers"),
        hosting.alias("hosting_provider"),
        signed.isin(*L.DNSSEC_ON).alias("dnssec_enabled"),
        F.exists(statuses, lambda s: U.contains_any(s, L.LOCK_CODES)).alias("domain_locked"),
        statuses.alias("status_codes"),
    )


def fresh_whois(requests: DataFrame, cache: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Requested domains with the cached record if it is younger than ``hours``."""
    recent = cache.filter(F.col("cached_at") > as_of - F.make_interval(hours=F.lit(hours)))
    return requests.join(recent, "domain", "left").withColumn("is_fresh", F.col("cached_at").isNotNull())


def with_source_lists(df: DataFrame, lists: SourceLists) -> DataFrame:
    """Attach the dictionary entries of the domain (``d_*``) and of its base domain (``b_*``).

    The dictionary has as many rows as the lists, so both joins are broadcast
    joins and the corpus is not shuffled.
    """
    table = lists.table(df.sparkSession)
    names = ["reliable", "issue", "long_standing", "mid_age"]
    for prefix, column in (("d", "domain"), ("b", "base_domain")):
        side = table.select(F.col("dict_domain").alias(f"_{prefix}"),
                            *[F.col(n).alias(f"{prefix}_{n}") for n in names])
        df = df.join(F.broadcast(side), F.col(column) == F.col(f"_{prefix}"), "left").drop(f"_{prefix}")
    flags = {f"{p}_{n}": F.coalesce(F.col(f"{p}_{n}"), F.lit(False))
             for p in ("d", "b") for n in ("reliable", "long_standing", "mid_age")}
    return df.withColumns(flags)


def domain_age_score() -> Column:
    """Verified age ladder, else an estimate from the lists."""
    verified = ladders.ladder(F.col("age_years"), [
        (20, 95.0), (10, 90.0), (5, 85.0), (3, 75.0), (2, 65.0), (1, 55.0)], 40.0)
    estimate = (F.when(F.col("d_long_standing"), 90.0).when(F.col("d_mid_age"), 75.0)
                .when(F.col("d_reliable"), 70.0).when(F.col("d_issue").isNotNull(), 20.0).otherwise(50.0))
    known = F.coalesce(F.col("verified"), F.lit(False)) & F.col("age_years").isNotNull()
    return F.when(known, verified).otherwise(estimate)


def _bounded(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("double")


def url_structure_score() -> Column:
    domain, path = F.col("domain"), U.path_of(F.col("url"))
    on = lambda cond, points: F.when(cond, points).otherwise(0)
    tld = (F.when(domain.endswith(".edu"), 30).when(domain.endswith(".gov"), 30).when(domain.endswith(".org"), 20)
           .when(domain.endswith(".com"), 10).when(domain.rlike(r"\.(tk|ml|ga|cf)$"), -30).otherwise(0))
    dashes = F.length(domain) - F.length(F.replace(domain, F.lit("-"), F.lit("")))
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    score = (50 + tld + on(U.contains_any(domain, ["news", "report", "times"]), 5)
             + on(domain.rlike(r"\p{Nd}{4,}"), -15) + on(F.length(U.first_label(domain)) > 20, -10)
             + on(dashes > 3, -10) + on(U.contains_any(path, ["/article/", "/news/"]), 5) + on(slashes > 6, -5))
    return (F.when(F.col("b_reliable"), 85.0).when(F.col("b_issue").isNotNull(), 30.0).otherwise(_bounded(score)))


def site_structure_score() -> Column:
    domain = F.col("domain")
    score = (50 + F.when(U.contains_any(domain, ["news", "times", "post", "herald"]), 15).otherwise(0)
             + F.when(F.length(domain) < 15, 10).otherwise(0)
             + F.when(domain.rlike(r"\.(edu|gov|org)$"), 20).otherwise(0))
    return F.when(F.col("b_reliable"), 85.0).when(F.col("b_issue").isNotNull(), 25.0).otherwise(_bounded(score))


def content_format_score() -> Column:
    url, content, title = F.col("url"), F.col("content"), F.col("title")
    on = lambda cond, points: F.when(cond, points).otherwise(0)
    n = X.whitespace_words(content)
    body = F.when(F.length(content) > 0, F.when(n > 300, 10).when(n < 100, -15).otherwise(0)
                  + on(content.contains("\n\n"), 5)).otherwise(0)
    head = on(F.length(title) > 100, -10) + on(X.count_char(title, "!") > 2, -10)
    score = (50 + on(url.rlike(r"/\p{Nd}{4}/\p{Nd}{2}/\p{Nd}{2}/"), 15)
             + on(url.contains("/article") | url.contains("/story"), 10) + on(F.length(url) > 150, -10)
             + on(X.count_upper_letters(url) > F.length(url) * 0.3, -15) + body + head)
    satire = F.col("b_issue").contains("Satirical")
    return (F.when(F.col("b_reliable"), 90.0).when(satire, 60.0).when(F.col("b_issue").isNotNull(), 30.0)
            .otherwise(_bounded(score)))


def source_class() -> Column:
    return (F.when(F.col("d_issue").isNotNull(), F.concat(F.lit("Known Issue: "), F.col("d_issue")))
            .when(F.col("d_reliable"), F.lit("Verified Reliable Source")))


METRICS = ["domain_age", "url_structure", "site_structure", "content_format"]


def credibility(df: DataFrame, lists: SourceLists | None = None, whois: DataFrame | None = None) -> DataFrame:
    """Add the four metrics (0-100), ``credibility`` (0-1, unrounded) and ``known_source``.

    ``df`` has ``url, title, content``. ``whois`` has one row per domain; it
    is broadcast where its checked size allows, so that a domain with many
    articles does not gather them in one task. Beyond that adaptive execution
    splits the large join partitions.
    """
    lists = lists or SourceLists()
    out = df.withColumn("domain", U.domain_of(F.col("url"))).withColumn("base_domain", U.base_domain(F.col("domain")))
    out = with_source_lists(out, lists)
    if whois is not None:
        out = out.join(small_side(whois), "domain", "left")
    else:
        out = out.withColumns({"verified": F.lit(False), "age_years": F.lit(None).cast("double")})
    out = out.withColumns({
        "domain_age": domain_age_score(), "url_structure": url_structure_score(),
        "site_structure": site_structure_score(), "content_format": content_format_score(),
        "known_source": source_class()})
    return out.withColumn("credibility", (F.col("domain_age") * 0.25 + F.col("url_structure") * 0.20
                                          + F.col("site_structure") * 0.30 + F.col("content_format") * 0.25) / 100)


def credibility_details(df: DataFrame, key: str) -> DataFrame:
    """Score, status and wording of each metric, one row per metric."""
    def row(kind: str) -> Column:
        score = F.col(kind)
        if kind == "domain_age":
            text = domain_age_description()
        elif kind == "site_structure":
            text = F.when(F.col("d_reliable"), F.lit("Established news organization with full transparency")).otherwise(
                ladders.metric_description(kind, score))
        else:
            text = ladders.metric_description(kind, score)
        return F.struct(F.lit(kind).alias("metric"), score.cast("int").alias("score"),
                        ladders.metric_status(kind, score).alias("status"), text.alias("description"))

    return df.select(key, F.inline_outer(F.array(*[row(k) for k in METRICS])))


def domain_age_description() -> Column:
    """Sentences on a verified record, or the list-based fallback wording."""
    estimate = (
        F.when(F.col("d_long_standing"), F.concat(F.lit("Long-standing reputable news organization ("),
                                                  F.col("domain"), F.lit(")")))
        .when(F.col("d_mid_age"), F.lit("Established news outlet with good track record"))
        .when(F.col("d_reliable"), F.lit("Recognized news source in the industry"))
        .when(F.col("domain_age") >= 50, F.lit("Domain shows moderate maturity indicators"))
        .otherwise(F.lit("Limited history or unknown domain reputation")))
    return estimate


def whois_description() -> Column:
    """Sentence list of a parsed WHOIS record (columns of ``parse_whois``)."""
    age, whole = F.col("age_years"), F.floor("age_years").cast("string")
    since = F.concat(F.lit("Domain registered in "), F.year("created_date").cast("string"), F.lit(" ("), whole)
    basic = F.when(F.col("created_date").isNotNull() & (age != 0), (
        F.when(age >= 20, F.concat(since, F.lit("+ years). Highly established online presence")))
        .when(age >= 10, F.concat(since, F.lit(" years). Well-established presence")))
        .when(age >= 5, F.concat(since, F.lit(" years). Established presence")))
        .when(age >= 2, F.concat(since, F.lit(" years). Moderate history")))
        .otherwise(F.concat(since, F.lit(" year(s)). Relatively new")))))
    registrar = F.when(F.col("registrar") != "", F.concat(
        F.when(F.col("registrar_trusted"), F.lit("Registered with reputable registrar: ")).otherwise(
            F.lit("Registered with: ")), F.col("registrar")))
    owner = F.when(F.col("privacy_protected"), F.lit("⚠️ Domain uses privacy protection - owner identity hidden")).when(
        F.col("registrant_org") != "", F.concat(F.lit("Public registration: "), F.col("registrant_org")))
    left, days = F.col("days_until_expiry"), F.col("days_until_expiry").cast("string")
    expiry = (
        F.when(left < 30, F.concat(F.lit("⚠️ Domain expires in "), days,
                                   F.lit(" days - highly suspicious for established news org")))
        .when(left < 90, F.concat(F.lit("⚠️ Domain expires soon ("), days, F.lit(" days)")))
        .when(F.col("expires_date") != "", F.concat(F.lit("Valid until "), F.substring("expires_date", 1, 4))))
    expiry = F.when(left.isNotNull(), expiry)
    changed = (F.when(F.col("days_since_update") < 7, F.lit(
        "⚠️ Domain information updated within last week - potential red flag"))
        .when(F.col("days_since_update") < 30, F.lit("Domain information recently updated")))
    hosting = F.when(F.col("hosting_provider") != "Unknown", F.concat(F.lit("Hosted on "), F.col("hosting_provider")))
    features = F.concat_ws(", ", F.when(F.col("dnssec_enabled"), F.lit("DNSSEC")),
                           F.when(F.col("domain_locked"), F.lit("Transfer Lock")))
    security = F.when(features != "", F.concat(F.lit("Security features: "), features, F.lit(" enabled")))
    sentences = F.concat_ws(". ", basic, registrar, owner, expiry, changed, hosting, security)
    return F.when(F.col("verified") & age.isNotNull(), F.concat(sentences, F.lit(".")))


def credibility_chart(df: DataFrame, key: str) -> DataFrame:
    """Radar-chart rows."""
    names = {"domain_age": "Domain Age", "url_structure": "URL Structure",
             "site_structure": "Site Structure", "content_format": "Content Format"}
    rows = [F.struct(F.lit(v).alias("label"), F.round(F.col(k), 1).alias("value")) for k, v in names.items()]
    return df.select(key, F.inline_outer(F.array(*rows)))


def enhanced_info(df: DataFrame) -> Column:
    ok = F.coalesce(F.col("verified"), F.lit(False))
    return F.struct(ok.alias("whois_verified"),
                    F.when(ok, F.lit("WHOIS API")).otherwise(F.lit("Pattern Estimation")).alias("verification_source"))


def credibility_simple(df: DataFrame, domains: Sequence[str] = tuple(L.SIMPLE_CREDIBLE_DOMAINS)) -> DataFrame:
    """List, news-word or unknown domain, and a content quality by length."""
    domain = F.replace(U.host(F.col("url")), F.lit("www."), F.lit(""))
    newsy = U.contains_any(domain, ["news", "times", "post", "tribune", "herald", "journal"])
    pick = lambda a, b, c: F.when(domain.isin(*domains), a).when(newsy, b).otherwise(c)
    n = X.whitespace_words(F.coalesce("content", F.lit("")))
    quality = F.when(n > 1000, 0.80).when(n > 500, 0.70).when(n > 200, 0.60).otherwise(0.50)
    return df.withColumns({
        "credibility_simple": pick(0.85, 0.65, 0.45),
        "source_simple": pick("Verified Reliable Source", "News Source", "Unknown Source"),
        "domain_age_simple": pick(85, 70, 50), "url_structure_simple": pick(80, 65, 50),
        "site_structure_simple": pick(85, 65, 45), "content_format_simple": pick(80, 65, 50),
        "content_quality": quality})
