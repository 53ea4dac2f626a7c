"""Distances of many vectors to many queries, in Arrow batches.

Sums run over the dimensions one after another in double, for all vectors of a
batch at once, so each result is bit for bit the left-to-right sum of its row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from stratalode.errors import VectorCorrupt


def matrix(values: pa.Array, dims: int) -> np.ndarray:
    """(dims, rows) in double; an error for a row of another length, with nulls or values that are not finite."""
    flat = values.flatten()
    if values.null_count or flat.null_count or not np.all(np.asarray(values.value_lengths()) == dims):
        raise VectorCorrupt("a stored vector has another length")
    m = np.ascontiguousarray(np.asarray(flat, dtype=np.float32).reshape(-1, dims).T).astype(np.float64)
    if not np.isfinite(m).all():
        raise VectorCorrupt("a stored value is not finite")
    return m


def stored(query: list[float]) -> list[float]:
    """The query rounded to 32 bits, as vectors are stored."""
    return np.asarray(query, dtype=np.float32).astype(np.float64).tolist()


def distances(metric: str, query: list[float], m: np.ndarray) -> np.ndarray:
    """Distances of the columns of ``m`` to one query."""
    total = np.zeros(m.shape[1])
    if metric == "l2":
        for x, row in zip(query, m, strict=True):
            d = x - row
            total += d * d
        return np.sqrt(total)
    for x, row in zip(query, m, strict=True):
        total += x * row
    if metric == "dot":
        return -total
    own = 0.0
    for x in query:
        own += x * x
    return 1 - total / (math.sqrt(own) * norms(m))


def norms(m: np.ndarray) -> np.ndarray:
    square = np.zeros(m.shape[1])
    for row in m:
        square += row * row
    if not square.all():
        raise VectorCorrupt("a stored cosine vector has norm 0")
    return np.sqrt(square)


def nearest(d: np.ndarray, limit: int | None) -> np.ndarray:
    """Places of the ``limit`` least distances, with all ties at the edge."""
    if limit is None or len(d) <= limit:
        return np.arange(len(d))
    if not limit:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(d <= np.partition(d, limit - 1)[limit - 1])
