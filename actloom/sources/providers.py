"""Pluggable sources for vectors and for policies: what a service would answer, behind a small interface.

A provider is a picklable callable on a list of texts. Calls run by batches on the executors with retries; a
batch that fails for good gives null vectors and an error, never random ones. The shipped providers are
deterministic: a hashing embedder and a stub policy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class HashingEmbedder:
    """Unit vectors of signed word counts over ``size`` slots; a text without words gives the zero vector."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
                row[h % self.size] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()


def embed(df: DataFrame, text: str, provider: Callable[[list[str]], list[list[float]]], batch: int = 64, retries: int = 3) -> DataFrame:
    """Adds ``embedding`` (null on failure) and ``embedding_error``."""

    @F.pandas_udf("embedding array<float>, embedding_error string")
    def run(texts):
        import pandas as pd

        rows, held = [], texts.fillna("").tolist()
        for i in range(0, len(held), batch):
            part, error = held[i : i + batch], "no attempt"
            for _ in range(max(1, retries)):
                try:
                    vectors = provider(part)
                    if len(vectors) != len(part):
                        raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                    rows += [(v, None) for v in vectors]
                    break
                except Exception as e:  # noqa: BLE001  a provider may raise anything; the rows carry it
                    error = f"{type(e).__name__}: {e}"[:200]
            else:
                rows += [(None, error)] * len(part)
        return pd.DataFrame(rows, columns=["embedding", "embedding_error"])

    return df.withColumn("__e", run(text)).select(*df.columns, "__e.embedding", "__e.embedding_error")


def grouped_embeddings(df: DataFrame, key: list[str], text: str, pos: str, provider, reps: int = 1) -> DataFrame:
    """One centroid a group from its representatives' vectors only, so that a dear provider sees few texts."""
    from ..operators.cluster import centroids, representatives

    chosen = embed(representatives(df, key, text, pos, reps), text, provider)
    return centroids(chosen.filter("embedding is not null"), key, "embedding")


def labels(clusters: DataFrame, provider: Callable[[list[str]], list[str]], text: str = "text") -> DataFrame:
    """A label for each cluster's sample text by a policy provider; null if it fails."""

    @F.pandas_udf("string")
    def run(texts):
        import pandas as pd

        try:
            return pd.Series(provider(texts.fillna("").tolist()), dtype=object)
        except Exception:  # noqa: BLE001
            return pd.Series([None] * len(texts), dtype=object)

    return clusters.withColumn("label", run(text))


def stub_labels(texts: list[str]) -> list[str]:
    """The deterministic policy: a text's first three words."""
    return [" ".join(t.split()[:3]) for t in texts]
