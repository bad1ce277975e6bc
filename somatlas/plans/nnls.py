"""Non-negative least squares over a shared dictionary: Lawson and Hanson's active sets, for many rows at once."""

from __future__ import annotations

import numpy as np

TOLERANCE = 1e-10


def _solve(gram: np.ndarray, targets: np.ndarray, active: np.ndarray) -> np.ndarray:
    """For each row the least-squares coefficients on its active set, 0 elsewhere; rows that share a set share one solve."""
    out = np.zeros_like(targets)
    sets, which = np.unique(np.packbits(active, axis=1), axis=0, return_inverse=True)
    order = np.argsort(which, kind="stable")
    for rows in np.split(order, np.cumsum(np.bincount(which, minlength=len(sets)))[:-1]):
        at = np.flatnonzero(active[rows[0]])
        if not len(at):
            continue
        block = gram[np.ix_(at, at)]
        try:
            s = np.linalg.solve(block, targets[np.ix_(rows, at)].T)
        except np.linalg.LinAlgError:
            s = np.linalg.lstsq(block, targets[np.ix_(rows, at)].T, rcond=None)[0]
        out[np.ix_(rows, at)] = s.T
    return out


def nnls_rows(gram: np.ndarray, targets: np.ndarray, max_iter: int | None = None, tol: float = TOLERANCE) -> np.ndarray:
    """c >= 0 of least |x - c D| for every row, given gram = D D' and targets = x D'.

    Every row goes through the active sets that it would go through alone; in
    each round all rows that are not done yet enter their best column, and those
    whose solution has a negative part step back to the border, together.
    """
    n, k = targets.shape
    c, active, grad = np.zeros((n, k)), np.zeros((n, k), bool), targets.astype(float).copy()
    going = np.arange(n)
    for _ in range(max_iter or 3 * k):
        open_ = np.where(active[going], -np.inf, grad[going])
        going = going[open_.max(1, initial=-np.inf) > tol]
        if not len(going):
            break
        active[going, np.where(active[going], -np.inf, grad[going]).argmax(1)] = True
        inner = going
        while len(inner):
            s = _solve(gram, targets[inner], active[inner])
            low = active[inner] & (s <= tol)
            good = ~low.any(1)
            c[inner[good]] = s[good]
            inner, s, low = inner[~good], s[~good], low[~good]
            old = c[inner]
            step = np.where(low, old / np.maximum(old - s, 1e-300), np.inf).min(1, initial=np.inf)[:, None]
            moved = np.where(active[inner], old + step * (s - old), 0.0)
            active[inner] &= moved > tol
            c[inner] = np.where(active[inner], moved, 0.0)
        grad[going] = targets[going] - c[going] @ gram
    return c


def nnls(gram: np.ndarray, target: np.ndarray, max_iter: int | None = None, tol: float = TOLERANCE) -> np.ndarray:
    """``nnls_rows`` for one row."""
    return nnls_rows(gram, np.asarray(target, float)[None], max_iter, tol)[0]


def codes(x: np.ndarray, dictionary: np.ndarray) -> np.ndarray:
    """Coefficients (len(x), len(dictionary)); rows of both sides are scaled to unit length, zero rows stay zero."""
    unit = lambda a: a / np.where((n := np.linalg.norm(a, axis=1, keepdims=True)) > 0, n, 1.0)
    x, d = unit(x), unit(dictionary)
    return nnls_rows(d @ d.T, x @ d.T) if len(x) else np.zeros((0, len(d)))
