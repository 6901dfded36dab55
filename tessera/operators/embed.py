"""Vectors for texts: a provider, a cache, and computing only what is missing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vector import WIDTH
from tessera.operators import tables
from tessera.session import stored

MAX_TOKENS, OVERLAP = 512, 64
CACHE = "model string, hash string, vector array<float>, last_used timestamp"


class EmbeddingProvider(Protocol):
    """Turns texts into unit vectors. Instances travel to the tasks."""

    name: str
    max_tokens: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedNgrams:
    """Deterministic vectors from hashed runs of three characters; needs no model."""

    def __init__(self, width: int = WIDTH, max_tokens: int = MAX_TOKENS):
        self.name, self.width, self.max_tokens = f"hashed-{width}", width, max_tokens

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for i, text in enumerate(texts):
            raw = np.frombuffer(f"  {text.lower()}  ".encode(), np.uint8).astype(np.uint64)
            code = (raw[:-2] << np.uint64(16) | raw[1:-1] << np.uint64(8) | raw[2:]) * np.uint64(0x9E3779B97F4A7C15)
            at = ((code >> np.uint64(40)) % np.uint64(self.width)).astype(np.int64)
            out[i] = np.bincount(at, np.where(code >> np.uint64(63), 1.0, -1.0), self.width)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def sentence_model(name: str, max_tokens: int = MAX_TOKENS) -> EmbeddingProvider:
    """A provider by a sentence model; ImportError where the library isn't installed."""
    from sentence_transformers import SentenceTransformer

    class Provider:
        def __init__(self):
            self.name, self.max_tokens, self.model = name, max_tokens, None

        def encode(self, texts: list[str]) -> np.ndarray:
            self.model = self.model or SentenceTransformer(self.name)
            return self.model.encode(texts, normalize_embeddings=True)

    return Provider()


def windows(text: str, size: int, overlap: int = OVERLAP) -> list[str]:
    """The text, or overlapping windows of its words if it is long."""
    words = text.split()
    if len(words) <= size:
        return [text]
    step = max(1, size - overlap)
    return [" ".join(words[a : a + size]) for a in range(0, max(1, len(words) - overlap), step)]


def fitted(v: np.ndarray, width: int) -> np.ndarray:
    return np.pad(v[:width], (0, max(0, width - len(v)))).astype(np.float32)


def encoded(texts: DataFrame, provider: EmbeddingProvider, batch: int = 128, width: int = WIDTH) -> DataFrame:
    """(hash, vector) of texts (hash, text); the windows of a long text are averaged, and the mean isn't scaled again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                pieces = [windows(t, provider.max_tokens) for t in part["text"]]
                vectors = provider.encode([p for ps in pieces for p in ps])
                ends = np.cumsum([len(p) for p in pieces])
                means = [fitted(vectors[e - len(p) : e].mean(0), width) for e, p in zip(ends, pieces, strict=True)]
                yield pd.DataFrame({"hash": part["hash"].to_numpy(), "vector": [m.tolist() for m in means]})

    return texts.select("hash", "text").mapInPandas(run, "hash string, vector array<float>")


def node_text(with_docs: bool = True) -> Column:
    """What is encoded of a node: docstring and body, or the body alone."""
    return F.concat_ws("\n", F.col("docstring"), F.col("body")) if with_docs else F.col("body")


def with_vectors(rows: DataFrame, text: str, provider: EmbeddingProvider, cache: DataFrame, now: Callable = F.current_timestamp) -> tuple[DataFrame, DataFrame]:
    """rows with column vector, and the cache with what was missing added and what was used touched. Each distinct text is encoded once."""
    keyed = rows.withColumn("_hash", F.sha2(F.col(text), 256))
    wanted = keyed.where(F.col("_hash").isNotNull()).select(F.col("_hash").alias("hash"), F.col(text).alias("text")).dropDuplicates(["hash"])
    mine = cache.where(F.col("model") == provider.name)
    fresh = stored(encoded(wanted.join(mine.select("hash"), "hash", "left_anti"), provider), "encoded")
    vectors = mine.select("hash", "vector").unionByName(fresh)
    out = keyed.join(vectors.withColumnRenamed("hash", "_hash"), "_hash", "left").drop("_hash")
    used = wanted.select("hash", F.lit(1).alias("_used"))
    touched = cache.join(used, "hash", "left").withColumn("last_used", F.when(F.col("_used").isNotNull() & (F.col("model") == provider.name), now()).otherwise(F.col("last_used")))
    added = fresh.select(F.lit(provider.name).alias("model"), "hash", "vector", now().alias("last_used"))
    return out, touched.select("model", "hash", "vector", "last_used").unionByName(added)


def query_vector(provider: EmbeddingProvider, text: str, width: int = WIDTH) -> list[float]:
    """A query as the stored vectors are."""
    return fitted(np.asarray(provider.encode([text]))[0], width).tolist()


def trimmed(cache: DataFrame, size: int, batch: int = 0) -> DataFrame:
    """The newest vectors of each model."""
    return tables.newest(cache, size, "last_used", ["model"], "hash", batch=batch)
