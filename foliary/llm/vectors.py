"""Columns of vectors for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integer vectors take part while sums of products of two of them fit a long.
LARGEST_NORM2 = float(1 << 60)


def whole(embedding: Column) -> Column:
    """True for vectors without null or non-finite components, false for others and for nulls."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good & (F.size(embedding) > 0), F.lit(False))


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of a column of whole vectors: for each number of components the rows and their vectors as doubles."""
    if not len(column):
        return []
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(size)
    out = []
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        at = (ends - size)[rows][:, None] + np.arange(d)
        out.append((rows, flat[at]))
    return out


def scaled(column: pa.Array, by: float = 256.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Like matrices, of floor(by * x); rows are left out whose squared norm is too large for longs."""
    out = []
    with np.errstate(over="ignore", invalid="ignore"):
        for rows, m in matrices(column):
            m = np.floor(by * m)
            fits = (m * m).sum(axis=1) < LARGEST_NORM2
            out.append((rows[fits], m[fits]))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: by doubles where no partial sum can reach 2^53
    (Cauchy-Schwarz), else by longs, whose sums may wrap on the way but not at the end."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    largest = np.sqrt((a * a).sum(axis=1).max()) * np.sqrt((b * b).sum(axis=1).max())
    if largest < 2.0**53:
        return a @ b.T
    return a.astype(np.int64) @ b.astype(np.int64).T
