"""Embeddings of texts: a provider is a function from a batch of texts to a matrix; this one needs no model."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.submissions import retried

DIMENSIONS = 64


def hash_vectors(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed counts of hashed words, of length 1 (0 for texts without words)."""
    words = [t.lower().split() for t in texts]
    # each distinct word is hashed once; the counts are one addition over all texts
    known = {w: zlib.crc32(w.encode()) for w in {w for ws in words for w in ws}}
    row = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
    h = np.fromiter((known[w] for ws in words for w in ws), np.int64, len(row))
    signs = np.where(h // dimensions % 2, 1.0, -1.0)
    out = np.bincount(row * dimensions + h % dimensions, weights=signs, minlength=len(texts) * dimensions).reshape(len(texts), dimensions)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return (out / np.where(length == 0, 1, length)).astype(np.float32)


class EmbeddingError(ValueError):
    """A provider's answer doesn't fit what it was asked."""


@dataclass(frozen=True)
class Provider:
    """embed: texts to a matrix, a row per text; called in each worker with at most ``batch`` texts, again after errors."""

    name: str
    dimensions: int
    embed: Callable[[list[str]], np.ndarray]
    batch: int = 100
    attempts: int = 3


HASHED = Provider("hash", DIMENSIONS, hash_vectors, batch=4096, attempts=1)


def checked(provider: Provider, texts: list[str]) -> np.ndarray:
    """The provider's vectors of texts; their number and dimension must be right."""
    call = retried(provider.embed, provider.attempts, 2.0, 30.0)
    parts = [np.zeros((0, provider.dimensions), np.float32)]
    for a in range(0, len(texts), provider.batch):
        part = texts[a : a + provider.batch]
        vectors = np.asarray(call(part), np.float32)
        if len(vectors) != len(part):
            raise EmbeddingError(f"{provider.name}: {len(vectors)} vectors for {len(part)} texts")
        if vectors.ndim != 2 or vectors.shape[1] != provider.dimensions:
            raise EmbeddingError(f"{provider.name}: vectors of {vectors.shape[1:]} numbers, not {provider.dimensions}")
        parts.append(vectors)
    return np.concatenate(parts)


def embedding(provider: Provider = HASHED):
    """A function of a text column: its vectors by a provider, nulls as empty texts."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(checked(provider, texts.fillna("").tolist())))

    return vectors


hash_embedding = embedding()
