"""Embedding providers and their cached, distributed use."""

from __future__ import annotations

import hashlib
import json
import math
import warnings
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialize
from .store import VECTORS, Store, missing, text_hash

BATCH = 64  # texts a call of the provider
ROUND = 100_000  # texts a commit


class EmbeddingUnavailable(RuntimeError):
    pass


class EmbeddingProvider(Protocol):
    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...

    def close(self) -> None: ...


class HashingEmbedder:
    """A deterministic stand-in for a model: signed counts of hashed terms."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed_query(self, text: str) -> list[float]:
        from ..functions.plain import content_terms

        vector = [0.0] * self.dimension
        for term in content_terms(text):
            h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little")
            vector[h % self.dimension] += 1.0 if h >> 63 else -1.0
        return vector

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [self.embed_query(t) for t in texts]

    def close(self) -> None:
        pass


def model_key(alias: str, metadata: dict | None = None) -> str:
    """Alias and a digest of the model's description, so that another build never meets old vectors."""
    return alias if not metadata else f"{alias}:{hashlib.sha256(json.dumps(metadata, sort_keys=True, default=str).encode()).hexdigest()[:20]}"


def checked(vectors: list[list[float]], n: int, dimension: int | None = None) -> list[list[float]]:
    if len(vectors) != n:
        raise RuntimeError("the embedding provider returned the wrong number of vectors")
    sizes = {len(v) for v in vectors} | ({dimension} if dimension else set())
    if len(sizes) > 1 or 0 in sizes or not all(math.isfinite(x) for v in vectors for x in v):
        raise ValueError("vectors must be finite, not empty, and of one dimension")
    return vectors


def embed_missing(store: Store, model: str, texts: DataFrame, make: Callable[[], EmbeddingProvider], batch: int = BATCH, round_size: int = ROUND) -> DataFrame:
    """``texts(text)`` to ``(text, vector)``; distinct texts that the store lacks are embedded in tasks and stored first.

    They are written once, and then embedded in rounds of about ``round_size``, each a commit. A batch that fails does not lose the others of its round:
    they are stored, then the error is raised. So a later call goes on from what is stored, and no stored text is embedded again.
    """
    wanted = texts.select("text").withColumn("text_hash", text_hash(model, F.col("text")))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = None
        try:
            for frame in frames:
                for at in range(0, len(frame), batch):
                    part, error = frame.iloc[at : at + batch], None
                    try:
                        provider = provider or make()
                        found = checked(provider.embed_documents(part["text"].tolist()), len(part))
                    except Exception as e:  # told to the driver once the round is stored
                        found, error = [None] * len(part), f"{type(e).__name__}: {e}"
                    yield pd.DataFrame({"text_hash": part["text_hash"].tolist(), "vector": found, "error": error})
        finally:
            if provider:
                provider.close()

    pending = materialize(missing(wanted, store.vectors(model)).select("text_hash", "text"), "pending")
    n = pending.count()
    rounds = -(-n // round_size)
    spread = max(1, min(texts.sparkSession.sparkContext.defaultParallelism, -(-n // (batch * max(1, rounds)))))
    for i in range(rounds):
        some = pending.where(F.pmod(F.xxhash64("text_hash"), F.lit(rounds)) == i).repartition(spread, "text_hash")
        done = materialize(some.mapInPandas(work, f"{VECTORS}, error string"), "embedded")
        store.put_vectors(model, done.where("error IS NULL"))
        failed = done.where("error IS NOT NULL").select("error").first()
        if failed:
            kind, _, told = failed["error"].partition(": ")
            raise (ValueError if kind == "ValueError" else RuntimeError)(told)
    return wanted.join(store.vectors(model), "text_hash").select("text", "vector")


def optional_provider(make: Callable[[], EmbeddingProvider], required: bool = False) -> EmbeddingProvider | None:
    """None, with a warning, where no model can be had and none was asked for; retrieval is lexical then."""
    try:
        return make()
    except (ImportError, EmbeddingUnavailable) as e:
        if required:
            raise
        warnings.warn(f"no embeddings, lexical retrieval only: {e}", stacklevel=2)
        return None
