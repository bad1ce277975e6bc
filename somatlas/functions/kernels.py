"""Scalar laws of training: sample weights, neighbourhood, schedules, thresholds. NumPy and Column forms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SE_FACTOR = 150.0  # fixed value of the "se" threshold
VERTICAL_FACTOR = 1.5  # fixed value of the threshold for child maps


def sample_weight(d: np.ndarray, variance: float) -> np.ndarray:
    """1 - sqrt(1 - exp(-d^2 / V)); 1 for all where V is 0."""
    if variance <= 0:
        return np.ones_like(d, dtype=float)
    return 1.0 - np.sqrt(1.0 - np.exp(-(d**2) / variance))


def sample_weight_col(d: Column, variance: Column) -> Column:
    return F.when(variance <= 0, 1.0).otherwise(1.0 - F.sqrt(1.0 - F.exp(-(d * d) / variance)))


def neighbourhood(hops: np.ndarray, sigma: float) -> np.ndarray:
    """exp(-hops^2 / (2 sigma^2)); 0 where no way leads."""
    return np.exp(-(hops**2) / (2.0 * sigma**2))


def neighbourhood_col(hops: Column, sigma: Column) -> Column:
    return F.exp(-(hops * hops) / (2.0 * sigma * sigma))


def linear_decay(start: float, end: float, max_iter: int, t: float) -> float:
    r = t / max_iter
    return start * (1.0 - r) + end * r


def exponential_decay(start: float, end: float, t: float, rate: float) -> float:
    return end + (start - end) * math.exp(-rate * t)


def sigma_at(epoch: int, n_neurons: int, n_iter: int, coarse_frac: float, coarse: bool, decay: str, rate: float, start: float | None, end: float | None) -> float:
    """The neighbourhood's width: decays over the coarse phase, stays at its end value in the fine one."""
    s0 = 0.2 * math.sqrt(n_neurons) if start is None else start
    s1 = max(0.7, 0.05 * math.sqrt(n_neurons)) if end is None else end
    if not coarse:
        return s1
    t = epoch / coarse_frac
    return linear_decay(s0, s1, n_iter, t) if decay == "linear" else exponential_decay(s0, s1, t, rate)


def growing_threshold(method: str, criterion: str, spreading_factor: float, n_features: int, std: np.ndarray) -> float:
    """Entropy: the spreading factor; classical: -d ln(sf); se: 150 (-ln sf) |std|."""
    if criterion == "entropy":
        return spreading_factor
    if method == "classical":
        return -n_features * math.log(spreading_factor)
    return SE_FACTOR * -math.log(spreading_factor) * float(np.linalg.norm(std))


def normal_pdf_col(d: Column, sigma: Column) -> Column:
    return F.exp(-(d * d) / (2.0 * sigma * sigma)) / (sigma * math.sqrt(2.0 * math.pi))
