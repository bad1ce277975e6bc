"""The training loop: samples stay where they are, the map goes to them once an epoch.

An epoch is one pass that returns sums of the map's size. Each task adds up
its batches; with many partitions the tasks' sums meet by neuron before they
reach the driver, so the driver gets one set of sums and not one a task.
``LocalSamples`` runs the same loop over one array: for child maps, and for
tables small enough (``local_cells``) that a job an epoch would cost more than
the epoch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somatlas.functions.distance import nearest_rows
from somatlas.functions.kernels import growing_threshold, neighbourhood, sample_weight, sigma_at
from somatlas.operators.aggregates import feature_moments
from somatlas.operators.assign import matrix
from somatlas.operators.growth import GrowingMap
from somatlas.runtime import Scratch, ordered_rank

TREE_FROM = 64  # partitions from which sums meet by neuron before the driver


@dataclass
class Settings:
    n_iter: int = 200
    convergence_iter: int = 1
    spreading_factor: float = 0.5
    sigma_start: float | None = None
    sigma_end: float | None = None
    decay_function: str = "exponential"
    learning_rate: float = 0.02
    coarse_training_frac: float = 0.5
    seed: int | None = None
    convergence_threshold: float = 1e-5
    max_neurons: int = 100
    metric: str = "euclidean"
    threshold_method: str = "se"
    growth_criterion: str = "quantization_error"
    sample_weighting: str = "exponential"
    topology_neighborhood: int = 8
    u_matrix: str = "local"
    interior_blocks_growth: bool = False
    remove_dead_neurons: bool = True

    def check(self, labelled: bool) -> None:
        choices = {
            "decay_function": ("linear", "exponential"), "threshold_method": ("se", "classical"), "growth_criterion": ("quantization_error", "entropy"),
            "sample_weighting": ("exponential", "none"), "topology_neighborhood": (8, 4), "u_matrix": ("local", "global"),
        }
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}; got {getattr(self, name)!r}")
        if self.n_iter < 1 or self.max_neurons < 4 or self.convergence_iter < 1:
            raise ValueError("n_iter and convergence_iter must be at least 1, max_neurons at least 4")
        if not 0 < self.coarse_training_frac <= 1:
            raise ValueError("coarse_training_frac must be above 0 and at most 1")
        if self.spreading_factor <= 0:
            raise ValueError("spreading_factor must be above 0")
        if self.growth_criterion == "entropy" and not labelled:
            raise ValueError("the entropy criterion needs labels")


@dataclass
class Sums:
    """By neuron: samples, weights, weighted features, features, distances, and samples of each class.

    Features are summed as differences to ``base``, the weights of the epoch,
    so that those far from 0 lose no digits.
    """

    n: np.ndarray
    w: np.ndarray
    wx: np.ndarray
    x: np.ndarray
    d: np.ndarray
    classes: np.ndarray
    base: np.ndarray | float = 0.0

    @classmethod
    def zero(cls, weights: np.ndarray, c: int) -> Sums:
        k, dim = weights.shape
        return cls(np.zeros(k), np.zeros(k), np.zeros((k, dim)), np.zeros((k, dim)), np.zeros(k), np.zeros((k, c)), weights)

    def add(self, x: np.ndarray, y: np.ndarray | None, weights: np.ndarray, s: Settings, variance: float) -> None:
        if not len(x):
            return
        ids, d = nearest_rows(x, weights, 1, s.metric)
        ids, d = ids[:, 0], d[:, 0]
        w = sample_weight(d, variance) if s.sample_weighting == "exponential" else np.ones(len(x))
        k = len(self.n)
        self.n += np.bincount(ids, minlength=k)
        self.w += np.bincount(ids, w, minlength=k)
        self.d += np.bincount(ids, d, minlength=k)
        hot = np.zeros((k, len(x)))
        hot[ids, np.arange(len(x))] = 1.0
        x = x - weights[ids]
        self.x += hot @ x
        self.wx += hot @ (x * w[:, None])
        if y is not None and self.classes.shape[1]:
            np.add.at(self.classes, (ids, y), 1)

    def table(self) -> np.ndarray:
        return np.hstack([self.n[:, None], self.w[:, None], self.d[:, None], self.wx, self.x, self.classes])

    @classmethod
    def of(cls, t: np.ndarray, base: np.ndarray) -> Sums:
        dim = base.shape[1]
        return cls(t[:, 0], t[:, 1], t[:, 3 : 3 + dim], t[:, 3 + dim : 3 + 2 * dim], t[:, 2], t[:, 3 + 2 * dim :], base)

    def centers(self) -> np.ndarray:
        """Weighted means; plain means where all weights have vanished; rows without samples stay at the base."""
        plain = self.x / np.maximum(self.n, 1)[:, None]
        return self.base + np.where((self.w > 0)[:, None], self.wx / np.where(self.w > 0, self.w, 1)[:, None], plain)

    def entropy(self) -> np.ndarray:
        p = self.classes / np.maximum(self.classes.sum(1, keepdims=True), 1)
        return -(p * np.log2(np.where(p > 0, p, 1))).sum(1)


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    var_pop: np.ndarray

    @property
    def std_samp(self) -> np.ndarray:
        return np.sqrt(self.var_pop * self.n / max(1, self.n - 1))


class LocalSamples:
    def __init__(self, x: np.ndarray, y: np.ndarray | None = None, n_classes: int = 0):
        """``x`` in the order of the ids; ``y`` holds class numbers."""
        self.x, self.y, self.n_classes = x, y, n_classes

    def moments(self) -> Moments:
        return Moments(len(self.x), self.x.mean(0), self.x.var(0))

    def rows(self, ranks: np.ndarray) -> np.ndarray:
        return self.x[ranks]

    def epoch(self, weights: np.ndarray, s: Settings, variance: float) -> Sums:
        out = Sums.zero(weights, self.n_classes)
        for at in range(0, len(self.x), 8192):
            out.add(self.x[at : at + 8192], None if self.y is None else self.y[at : at + 8192], weights, s, variance)
        return out

    def close(self) -> None:
        pass


class SparkSamples:
    """Samples as a table id, features and, if they are labelled, class_index. Every epoch reads it again; ``keep`` has the executors store it."""

    def __init__(self, df: DataFrame, n_classes: int = 0, keep: bool = False):
        self.spark, self.n_classes, self.keep = df.sparkSession, n_classes, keep
        self.df = df.persist(StorageLevel.MEMORY_AND_DISK) if keep else df

    def moments(self) -> Moments:
        rows = feature_moments(self.df).orderBy("dim").collect()
        if not rows:
            return Moments(0, np.empty(0), np.empty(0))
        if len({r["n"] for r in rows}) > 1:
            raise ValueError("feature vectors differ in length")
        if not np.isfinite([[r["lo"], r["hi"]] for r in rows]).all():
            raise ValueError("features must be finite numbers")
        return Moments(rows[0]["n"], np.array([r["mean"] for r in rows]), np.array([r["var_pop"] for r in rows]))

    def rows(self, ranks: np.ndarray) -> np.ndarray:
        """The samples at these places in the order of the ids."""
        scratch = Scratch(self.spark, "seeds")
        ranked = ordered_rank(scratch, self.df.select("id"), [F.col("id")], "ids").where(F.col("__rank").isin([int(r) for r in ranks]))
        place = {r["id"]: r["__rank"] for r in ranked.collect()}
        found = {place[r["id"]]: r["features"] for r in self.df.where(F.col("id").isin(list(place))).select("id", "features").collect()}
        return np.array([found[int(r)] for r in ranks])

    def epoch(self, weights: np.ndarray, s: Settings, variance: float) -> Sums:
        w, n_classes = self.spark.sparkContext.broadcast(weights), self.n_classes
        k, dim = weights.shape
        columns = ["features", "class_index"][: 1 + bool(n_classes)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums.zero(w.value, n_classes)
            for b in batches:
                for at in range(0, b.num_rows, 8192):
                    part = b.slice(at, 8192)
                    sums.add(matrix(part.column(0)), part.column(1).to_numpy(zero_copy_only=False) if n_classes else None, w.value, s, variance)
            ids = np.flatnonzero(sums.n)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(ids, pa.int32()), pa.array(list(sums.table()[ids]), pa.list_(pa.float64()))], names=["part", "neuron_id", "sums"])

        schema = "part int, neuron_id int, sums array<double>"
        parts = self.df.select(*columns).mapInArrow(run, schema)
        if self.df.rdd.getNumPartitions() >= TREE_FROM:
            parts = parts.repartition("neuron_id").sortWithinPartitions("neuron_id", "part").mapInArrow(_meet, schema)
        total = np.zeros((k, 3 + 2 * dim + n_classes))
        for r in sorted(parts.collect(), key=lambda r: (r["part"], r["neuron_id"])):
            total[r["neuron_id"]] += r["sums"]
        w.unpersist()
        return Sums.of(total, weights)

    def close(self) -> None:
        if self.keep:
            self.df.unpersist()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            total[i] = total[i] + np.array(s) if i in total else np.array(s)
    ids = sorted(total)
    yield pa.RecordBatch.from_arrays([pa.array([0] * len(ids), pa.int32()), pa.array(ids, pa.int32()), pa.array([total[i] for i in ids], pa.list_(pa.float64()))], names=["part", "neuron_id", "sums"])


@dataclass
class Trained:
    map: GrowingMap
    threshold: float
    variance: float
    n_iter: int
    converged: bool
    n_features: int
    n_samples: int
    sigmas: list[float] = field(default_factory=list)


def update(weights: np.ndarray, sums: Sums, hops: np.ndarray, sigma: float) -> np.ndarray:
    """The batch rule: centres times counts, smoothed over the grid. A neuron that nothing reaches keeps its weight."""
    h = neighbourhood(hops, sigma)
    total = h @ sums.n
    moved = (h @ (sums.n[:, None] * sums.centers())) / np.where(total > 0, total, 1)[:, None]
    return np.where((total > 0)[:, None], moved, weights)


def train(samples: LocalSamples | SparkSamples, s: Settings) -> Trained:
    s.check(bool(samples.n_classes))
    m = samples.moments()
    if m.n < 4:
        raise ValueError(f"at least 4 samples are needed; got {m.n}")
    threshold = growing_threshold(s.threshold_method, s.growth_criterion, s.spreading_factor, len(m.mean), m.std_samp)
    variance = float(m.var_pop.sum())
    ranks = np.random.default_rng(s.seed).choice(m.n, 4, replace=False)
    grid = GrowingMap(samples.rows(ranks))
    hops, converged, sigmas, epoch = grid.hops(), False, [], 0
    for epoch in range(s.n_iter):
        coarse = epoch <= s.coarse_training_frac * s.n_iter
        size = len(grid)
        if len(hops) != size:
            hops = grid.hops()
        sums = samples.epoch(grid.weights, s, variance)
        sigma = sigma_at(epoch, size, s.n_iter, s.coarse_training_frac, coarse, s.decay_function, s.learning_rate, s.sigma_start, s.sigma_end)
        sigmas.append(sigma)
        new = update(grid.weights, sums, hops, sigma)
        converged |= bool(np.linalg.norm(new - grid.weights, axis=1).sum() < s.convergence_threshold)
        grid.weights = new
        grid.errors = sums.entropy() if s.growth_criterion == "entropy" else sums.d.copy()
        if converged and not coarse:
            break
        if coarse and size < s.max_neurons and epoch % s.convergence_iter == s.convergence_iter - 1:
            grid.distribute_errors(threshold)
            grid.grow(threshold, epoch, s.interior_blocks_growth)
    return Trained(grid, threshold, variance, epoch, converged, len(m.mean), m.n, sigmas)
