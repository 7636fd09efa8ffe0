"""Embeddings from a provider, and what an index says of them.

A provider names its model and its dimension, and `load()` gives a function
from a list of texts to vectors.  It is sent to the workers unloaded: each
worker loads the model once and calls it with batches of up to `batch` texts.

Defined results: a null text counts as empty, since every chunk has a vector;
rows without a key are left out; equal texts are embedded once for each row; a
vector of another dimension, or with values that are not finite, fails the job
and names the model.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import xxhash
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = re.compile(r"\w+")
#: Of Spark's hash, so that `retrieval.hash_embeddings` gives the same vectors.
SEED = 42
Embed = Callable[[list[str]], "np.ndarray | Iterator[np.ndarray]"]


class Provider(Protocol):
    """What embeds texts."""

    model: str
    dim: int

    def load(self) -> Embed: ...


class WrongVectors(ValueError):
    """The provider gave something else than one finite vector of its dimension for each text."""


@dataclass(frozen=True)
class HashProvider:
    """A deterministic stand-in for a model: hashed words with signs, length
    one; a text without words gives zeros."""

    model: str = "hashed-words"
    dim: int = 384

    def load(self) -> Embed:
        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), self.dim))
            for row, text in zip(out, texts, strict=True):
                for word in WORDS.findall(text.lower()):
                    h = np.int64(np.uint64(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), SEED)).view(np.int64))
                    row[h % self.dim] += 1 if h >= 0 else -1
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norms > 0, norms, 1)

        return embed


@dataclass(frozen=True)
class FunctionProvider:
    """Any loader of a function from texts to vectors."""

    model: str
    dim: int
    loader: Callable[[], Embed]

    def load(self) -> Embed:
        return self.loader()


def flat(found: object, dim: int, n: int, model: str) -> np.ndarray:
    """One row a text: providers give an array, or an iterator of arrays of
    one or several rows."""
    parts = [found] if isinstance(found, np.ndarray) else list(found)
    rows = [np.atleast_2d(np.asarray(p, dtype=np.float64)) for p in parts]
    if any(r.ndim != 2 or r.shape[1] != dim for r in rows):
        raise WrongVectors(f"{model} gave vectors of {sorted({r.shape[-1] for r in rows})} values, not {dim}")
    out = np.concatenate(rows) if rows else np.zeros((0, dim))
    if len(out) != n:
        raise WrongVectors(f"{model} gave {len(out)} vectors for {n} texts")
    if not np.isfinite(out).all():
        raise WrongVectors(f"{model} gave values that are not finite")
    return out.astype(np.float32)


def embed(chunks: DataFrame, provider: Provider, key: str = "chunk_id", parent: str | None = "parent_document_id", value: str = "text", batch: int = 64) -> DataFrame:
    """key, parent, embedding_model, embedding_vector: a row for each chunk."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        call = provider.load()

        def predict(texts: np.ndarray) -> np.ndarray:
            own = ["" if t is None else str(t) for t in texts.reshape(-1)]
            return flat(call(own), provider.dim, len(own), provider.model)

        return predict

    vector = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    rows = chunks.where(F.col(key).isNotNull())
    names = [key, *([parent] if parent else [])]
    return rows.select(*names, F.lit(provider.model).alias("embedding_model"), vector(F.coalesce(F.col(value), F.lit(""))).alias("embedding_vector"))


def manifest(embeddings: DataFrame, run_id: str, source: str) -> DataFrame:
    """One row about a run: model, dimension and number of embeddings."""
    dim = F.coalesce(F.max(F.size("embedding_vector")), F.lit(0))
    model = F.max("embedding_model")
    return embeddings.agg(model.alias("model"), dim.alias("embedding_dim"), F.count(F.lit(1)).alias("chunks_embedded")).select(F.lit(run_id).alias("run_id"), F.lit(source).alias("source"), "model", "embedding_dim", "chunks_embedded", F.current_timestamp().alias("created_at"))
