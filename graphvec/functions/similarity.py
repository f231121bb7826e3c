"""Vector similarity as columns (single-precision, in element order) and as block products for batches of queries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CodecError, InvalidConfig

COSINE, DOT, EUCLIDEAN = "cosine", "dot_product", "euclidean"


@dataclass(frozen=True)
class VectorConfig:
    """Settings of a vector index. Search is exact; ``ef_search`` bounds the ranked candidates."""

    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    similarity: Any = COSINE

    def __post_init__(self) -> None:
        if self.m < 2 or self.ef_construction < 1 or self.ef_search < 1:
            raise InvalidConfig("m must be at least 2, ef_construction and ef_search at least 1")

    def storable(self) -> None:
        if self.similarity not in (COSINE, DOT, EUCLIDEAN):
            raise CodecError("a custom similarity can't be stored")


def _sum(left: Column, right: Column, step) -> Column:
    return F.aggregate(F.zip_with(left, right, step), F.lit(0.0).cast("float"), lambda a, x: (a + x).cast("float"))


def score(vector: Column, query: Column, similarity: str) -> Column:
    """Similarity of two vectors of one length; for euclidean it is the distance, lower is better."""
    dot = _sum(vector, query, lambda a, b: a * b)
    if similarity == DOT:
        return dot
    if similarity == COSINE:
        norms = (F.sqrt(_sum(vector, vector, lambda a, b: a * b)).cast("float") * F.sqrt(_sum(query, query, lambda a, b: a * b)).cast("float")).cast("float")
        return F.when(norms == 0, F.lit(0.0).cast("float")).otherwise((dot / norms).cast("float"))
    if similarity == EUCLIDEAN:
        return F.sqrt(_sum(vector, query, lambda a, b: (a - b) * (a - b))).cast("float")
    raise InvalidConfig(f"unknown similarity {similarity!r}")


def ascending(similarity: str) -> bool:
    return similarity == EUCLIDEAN


def block_scores(vectors: np.ndarray, queries: np.ndarray, similarity: str) -> np.ndarray:
    """(vectors x queries) scores, higher is better."""
    product = vectors @ queries.T
    if similarity == DOT:
        return product
    if similarity == COSINE:
        norms = np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
        return np.divide(product, norms, out=np.zeros_like(product), where=norms > 0)
    squares = (vectors**2).sum(axis=1)[:, None] + (queries**2).sum(axis=1)[None, :] - 2 * product
    return -np.sqrt(np.maximum(squares, 0))


def as_query(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)).cast("float") for x in values)).cast("array<float>")
