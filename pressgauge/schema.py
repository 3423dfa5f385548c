"""Row layouts shared by the operators."""

from pyspark.sql import types as T

CLEAN = T.StructType([
    T.StructField("text_full", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("text_length", T.IntegerType()),
    T.StructField("word_count", T.IntegerType()),
])

SCRAPED = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("published_at", T.StringType()),
])

STORED = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("published_at", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("article_type", T.StringType()),
    T.StructField("word_count", T.IntegerType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

_REGISTRANT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("organization", T.StringType()),
    T.StructField("email", T.StringType()),
])

_REGISTRY = T.StructType([
    T.StructField("createdDate", T.StringType()),
    T.StructField("updatedDate", T.StringType()),
    T.StructField("expiresDate", T.StringType()),
    T.StructField("registrarName", T.StringType()),
    T.StructField("dnssec", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("registrant", _REGISTRANT),
])

WHOIS_JSON = T.StructType([
    T.StructField("WhoisRecord", T.StructType([
        T.StructField("createdDate", T.StringType()),
        T.StructField("updatedDate", T.StringType()),
        T.StructField("expiresDate", T.StringType()),
        T.StructField("registrarName", T.StringType()),
        T.StructField("dnssec", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("registrant", _REGISTRANT),
        T.StructField("nameServers", T.StringType()),
        T.StructField("registryData", _REGISTRY),
    ])),
])
