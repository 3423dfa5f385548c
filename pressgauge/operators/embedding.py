"""Text embeddings with a pluggable encoder."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pressgauge.functions import text as X
from pressgauge.operators.cleaning import needs_embedding
from pressgauge.operators.store import merge_store, read_buckets, upsert_articles

Encoder = Callable[[Sequence[str]], np.ndarray]


def hashing_encoder(dimensions: int = 64) -> Callable[[], Encoder]:
    """Factory of a model-free encoder: signed hashed word counts, log-damped.

    A real sentence encoder is passed the same way: a factory, called once per
    Python worker, that returns a function from texts to a matrix.
    """
    def factory() -> Encoder:
        word = re.compile(r"\w+")

        def encode(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimensions))
            for row, text in enumerate(texts):
                hashes = np.fromiter((zlib.crc32(w.encode()) for w in word.findall(text.lower())), dtype=np.int64)
                if len(hashes):
                    sign, place = np.where(hashes & 1, 1.0, -1.0), (hashes >> 1) % dimensions
                    out[row] = np.bincount(place, weights=sign, minlength=dimensions)
                    if not out[row].any():
                        # All words cancelled each other: their plain counts tell more than nothing.
                        out[row] = np.bincount(place, minlength=dimensions)
            return np.sign(out) * np.log1p(np.abs(out))

        return encode

    return factory


def embed_documents(df: DataFrame, key: str, text: str, factory: Callable[[], Encoder] | None = None,
                    min_len: int = 10) -> DataFrame:
    """``key, embedding`` (unit length; zero where the encoder finds no word) of texts with at least ``min_len``
    non-blank characters.

    Only key and text go to the workers. Batches are Arrow sized; the encoder
    is built once per worker process.
    """
    factory = factory or hashing_encoder()
    usable = df.select(key, text).filter(F.length(X.strip(F.col(text))) >= min_len)
    schema = T.StructType([df.schema[key], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches):
        encode = factory()
        for batch in batches:
            if not len(batch):
                continue
            matrix = np.asarray(encode(batch[text].tolist()), dtype=np.float64)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            unit = (matrix / np.where(norms > 0, norms, 1.0)).astype(np.float32)
            yield pd.DataFrame({key: batch[key].to_numpy(), "embedding": list(unit)})

    return usable.mapInPandas(run, schema)


def backfill_embeddings(store: DataFrame, factory: Callable[[], Encoder] | None = None) -> DataFrame:
    """The store with embeddings for the articles that lack one."""
    missing = needs_embedding(store)
    vectors = embed_documents(missing, "id", "content", factory)
    return upsert_articles(store, missing.drop("embedding").join(vectors, "id"))


def backfill_store(spark: SparkSession, path: str, factory: Callable[[], Encoder] | None = None, buckets: int = 64) -> int:
    """Embed the articles of a bucketed store that lack a vector; only their buckets are rewritten. Returns how many."""
    missing = needs_embedding(read_buckets(spark, path))
    vectors = embed_documents(missing, "id", "content", factory)
    fresh = missing.drop("embedding", "bucket").join(vectors, "id")
    return merge_store(spark, path, fresh, "id", ("id",), buckets)
