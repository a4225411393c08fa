"""Embeddings: providers, batching and checks. The built-in provider hashes tokens; no model is needed."""

from __future__ import annotations

import asyncio
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.errors import EngineError
from .numbering import numbered

Provider = Callable[[list[str]], np.ndarray]


class _Places(dict):
    """Place of a token's count: its bucket, behind all buckets where its sign is positive; those of frequent tokens remembered."""

    def __init__(self, dimension: int) -> None:
        self.dimension = dimension

    def __missing__(self, token: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = int(hashlib.md5(token.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()[:8], 16)
        self[token] = out = h % self.dimension + (self.dimension if h >> 31 else 0)
        return out


def hashing_provider(dimension: int = 64) -> Provider:
    """Signed feature hashing of lower-cased tokens, by MD5: the same on every machine."""
    places = _Places(dimension)

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 2 * dimension))
        for i, t in enumerate(texts):
            out[i] = np.bincount([places[w] for w in (t or "").lower().split()], minlength=2 * dimension)
        return out[:, dimension:] - out[:, :dimension]

    return encode


def encode(provider: Provider, normalise: bool = True, batch_size: int = 32) -> Callable[[Column], Column]:
    if not 1 <= batch_size <= 512:
        raise ValueError("batch_size must be within 1 and 512")

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        rows: list[list[float]] = []
        for at in range(0, len(values), batch_size):
            m = provider([v or "" for v in values[at : at + batch_size]])
            if normalise:
                n = np.linalg.norm(m, axis=1, keepdims=True)
                m = m / np.where(n == 0, 1, n)
            rows += m.astype(np.float32).tolist()
        return pa.array(rows, pa.list_(pa.float32()))

    return run


def encode_one(provider: Provider, text: str, normalise: bool = True) -> list[float]:
    """The vector of one text, as ``encode`` gives it in a column."""
    if not (text or "").strip():
        raise EngineError("EMPTY_EMBEDDING_INPUT", "there is nothing to embed")
    m = np.asarray(provider([text]), np.float64)
    if m.ndim != 2 or len(m) != 1:
        raise EngineError("EMBEDDING_INFERENCE_FAILED", f"one text gave {m.shape}")
    n = np.linalg.norm(m[0])
    return (m[0] / (n if normalise and n else 1)).astype(np.float32).tolist()


async def encode_one_async(provider: Provider, text: str, normalise: bool = True) -> list[float]:
    """The same without holding up the caller's loop."""
    return await asyncio.to_thread(encode_one, provider, text, normalise)


async def encode_batch_async(texts: DataFrame, provider: Provider, column: str = "text", into: str = "vector", normalise: bool = True, batch_size: int = 32) -> pa.Table:
    """A table of texts with their vectors, encoded on the executors while the caller's loop goes on; for results that fit the caller."""
    made = texts.withColumn(into, encode(provider, normalise, batch_size)(F.col(column)))
    return await asyncio.to_thread(made.toArrow)


def batch_size_for(lengths: DataFrame, column: str, token_budget: int = 32_768, least: int = 1, most: int = 256) -> DataFrame:
    """One row: texts per batch such that their mean length fills the token budget; none at all give the most."""
    mean = F.greatest(F.lit(1.0), F.avg(column) / 4.0)
    return lengths.agg(F.coalesce(F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.lit(token_budget) / mean))), F.lit(most)).cast("int").alias("batch_size"))


def with_batches(df: DataFrame, key: str, group: str, size: int) -> DataFrame:
    """Batch number and place in it, by ``key`` within each ``group``."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    at = F.col("_batched")
    placed = numbered(df, [group], [key], "_batched")
    return placed.withColumn("batch_number", F.floor(at / size).cast("int")).withColumn("batch_index", (at % size).cast("int")).drop("_batched")


def require_dimension(vector: Column, dimension: int) -> Column:
    """The vector, or an error that stops the job where its size differs."""
    return F.when(F.size(vector) == dimension, vector).otherwise(F.raise_error(F.concat(F.lit(f"EMBEDDING_DIMENSION_MISMATCH: expected {dimension}, got "), F.size(vector).cast("string"))).cast("array<float>"))


def nonblank(texts: DataFrame, column: str = "text") -> DataFrame:
    return texts.where(F.length(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")) > 0)
