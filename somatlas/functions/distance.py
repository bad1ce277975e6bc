"""Distances between array columns, and nearest prototypes by them, as Column expressions and as NumPy kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "sqeuclidean", "manhattan", "cosine", "chebyshev")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def distance(a: Column, b: Column, metric: str = "euclidean", p: float = 2.0) -> Column:
    """The distance of two array<double> columns of one length. Cosine of a zero vector is 1."""
    if metric == "minkowski":
        parts = F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))
        return F.pow(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(1.0 / p))
    if metric == "cosine":
        size = norm(a) * norm(b)
        return F.when(size == 0, 1.0).otherwise(1.0 - dot(a, b) / size)
    if metric == "manhattan":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    if metric == "chebyshev":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, x))
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    if metric == "sqeuclidean":
        return square
    if metric == "euclidean":
        return F.sqrt(square)
    raise ValueError(f"metric must be one of {', '.join(METRICS)}, minkowski; got {metric!r}")


def nearest(features: Column, codebook: Column, k: int = 1, metric: str = "euclidean") -> Column:
    """The k nearest of ``codebook``, an array of (id, w), as an array of (d, id): nearest first, ties to the lower id."""
    each = F.transform(codebook, lambda c: F.struct(distance(features, c["w"], metric).alias("d"), c["id"].alias("id")))
    return F.array(F.array_min(each)) if k == 1 else F.slice(F.array_sort(each), 1, k)


def pairwise(x: np.ndarray, w: np.ndarray, metric: str = "euclidean", p: float = 2.0) -> np.ndarray:
    """Distances (len(x), len(w)) in the direct form."""
    if metric == "cosine":
        size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(w, axis=1)[None, :]
        return 1.0 - np.divide(x @ w.T, size, out=np.zeros_like(size), where=size > 0)
    out = np.empty((len(x), len(w)))
    for j, c in enumerate(w):
        d = x - c
        if metric == "euclidean":
            out[:, j] = np.sqrt(np.einsum("ij,ij->i", d, d))
        elif metric == "sqeuclidean":
            out[:, j] = np.einsum("ij,ij->i", d, d)
        elif metric == "manhattan":
            out[:, j] = np.abs(d).sum(1)
        elif metric == "chebyshev":
            out[:, j] = np.abs(d).max(1, initial=0.0)
        elif metric == "minkowski":
            out[:, j] = (np.abs(d) ** p).sum(1) ** (1 / p)
        else:
            raise ValueError(f"unknown metric {metric!r}")
    return out


def nearest_rows(x: np.ndarray, w: np.ndarray, k: int = 1, metric: str = "euclidean", p: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances), each (len(x), k), nearest first; equal distances go to the lower id.

    For Euclidean distances a matrix product finds the candidates, and those
    within rounding of the k-th are measured again in the direct form.
    """
    k = min(k, len(w))
    if metric in ("euclidean", "sqeuclidean") and len(w) > k:
        half = (w * w).sum(1) / 2 - x @ w.T  # squared distance less |x|^2, halved
        kth = np.partition(half, k - 1, axis=1)[:, k - 1 : k]
        scale = 1e-9 * (1.0 + np.abs(half).max(1, keepdims=True) + (x * x).sum(1, keepdims=True))
        row, col = np.nonzero(half <= kth + scale)
        d = x[row] - w[col]
        d = np.einsum("ij,ij->i", d, d)
        order = np.lexsort((col, d, row))
        row, col, d = row[order], col[order], d[order]
        first = np.searchsorted(row, np.arange(len(x)))
        at = first[:, None] + np.arange(k)
        return col[at], d[at] if metric == "sqeuclidean" else np.sqrt(d[at])
    d = pairwise(x, w, metric, p)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(d, order, 1)
