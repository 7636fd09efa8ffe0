"""Search, neighbours, answers and documents over stored tables, as functions.

A web server would call these; each returns a DataFrame of the size asked for.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import fulltext, merge, retrieval


class NotFound(LookupError):
    """What a server would answer with 404."""


class Unavailable(RuntimeError):
    """What a server would answer with 503."""


@dataclass(frozen=True)
class Config:
    """Where the database is and how scores are blended."""

    dsn: str | None = None
    alpha: float = retrieval.ALPHA

    @classmethod
    def from_environment(cls, env: dict[str, str] | None = None) -> Config:
        """DATABASE_URL, or else POSTGRES_DSN; FUSION_ALPHA."""
        env = dict(os.environ) if env is None else env
        return cls(env.get("DATABASE_URL") or env.get("POSTGRES_DSN"), float(env.get("FUSION_ALPHA", retrieval.ALPHA)))

    def problems(self) -> list[str]:
        found = [] if self.dsn else ["neither DATABASE_URL nor POSTGRES_DSN is set"]
        return found if 0 <= self.alpha <= 1 else [*found, "FUSION_ALPHA lies outside 0 to 1"]


def search(chunks: DataFrame, query: str, k: int = 10, key: str = "chunk_id") -> DataFrame:
    return retrieval.fts(chunks, query, k, key)


def search_index(index: DataFrame | fulltext.TextIndex, query: str, k: int = 10, key: str = "chunk_id") -> DataFrame:
    """English search over stored postings; a `TextIndex` follows changes."""
    return index.search(query, k) if isinstance(index, fulltext.TextIndex) else fulltext.search(index, query, k, key)


def hybrid(chunks: DataFrame, vectors: DataFrame, query: str, probe: DataFrame, k: int = 10, only: Column | None = None, config: Config | None = None, index: DataFrame | fulltext.TextIndex | None = None) -> DataFrame:
    """With an `index` over doc_id, its postings are read and no text but that
    of the k results."""
    hits = None
    if isinstance(index, fulltext.TextIndex):
        index = index.postings()
    if index is not None:
        allowed = index if only is None else index.join(chunks.where(only).select("doc_id"), "doc_id", "left_semi")
        hits = fulltext.search(allowed, query, k, "doc_id")
    return retrieval.hybrid(chunks, vectors, query, probe, k, only, (config or Config()).alpha, hits)


def similar(chunks: DataFrame, vectors: DataFrame, chunk: int, k: int = 10, key: str = "doc_id", vector_key: str = "vec_id") -> DataFrame:
    """Neighbours of a chunk; NotFound if the chunk or its vector is unknown."""
    if chunks.where(F.col(key) == chunk).isEmpty():
        raise NotFound("chunk_id not found")
    if vectors.where(F.col(vector_key) == chunk).isEmpty():
        raise NotFound("chunk_id not found in vector store")
    return retrieval.similar(vectors, chunk, k)


def answer(hits: DataFrame) -> DataFrame:
    return retrieval.answer(hits)


def get_document(documents: DataFrame, document_id: object, key: str = "doc_id") -> DataFrame:
    """One row; NotFound if there is none."""
    found = documents.where(F.col(key) == document_id).limit(1)
    if found.isEmpty():
        raise NotFound("document not found")
    return found


def list_documents(documents: DataFrame, limit: int = 20, key: str = "doc_id") -> DataFrame:
    return documents.orderBy(F.desc(key)).limit(limit)


def health(documents: DataFrame, vectors: DataFrame, config: Config) -> dict[str, object]:
    """Counts and what is wrong with the configuration."""
    problems = config.problems()
    return {"status": "degraded" if problems else "ok", "problems": problems, "documents": documents.count(), "vectors": vectors.count()}


def orphans_removed(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """What a cascading delete leaves: children whose parent is still there."""
    return children.join(merge.orphans(children, parents, child_key, parent_key).select(child_key).distinct(), child_key, "left_anti")
