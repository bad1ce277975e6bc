"""Aggregates over assigned samples (id, label, neuron_id, distance): each a DataFrame to a DataFrame of the map's size."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from somatlas.functions.kernels import normal_pdf_col, sample_weight_col
from somatlas.operators.assign import matrix
from somatlas.runtime import ship_package


def neuron_totals(assigned: DataFrame, neurons: DataFrame) -> DataFrame:
    """neuron_id, hit_count and error (the sum of distances) of every neuron, 0 where no sample is."""
    sums = assigned.groupBy("neuron_id").agg(F.count(F.lit(1)).alias("hit_count"), F.sum("distance").alias("error"))
    return neurons.select("neuron_id").join(F.broadcast(sums), "neuron_id", "left").select("neuron_id", F.coalesce("hit_count", F.lit(0)).alias("hit_count"), F.coalesce("error", F.lit(0.0)).alias("error"))


def mean_error(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.avg("distance").alias("quantization_error"))


def partial_moments(samples: DataFrame, features: str = "features") -> DataFrame:
    """part, dim, n, mean, m2, lo, hi: each task's moments of each feature, gathered batch by batch; a row for each task and feature."""
    ship_package(samples.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2, lo, hi = 0, 0.0, 0.0, np.inf, -np.inf
        for b in batches:
            x = matrix(b.column(0))
            if not len(x):
                continue
            new, bm = n + len(x), x.mean(0)
            if n and len(bm) != len(mean):
                raise ValueError("feature vectors differ in length")
            mean, m2, n = *joined(n, mean, m2, len(x), bm, ((x - bm) ** 2).sum(0)), new
            lo, hi = np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0))
        if n:
            part, k = TaskContext.get().partitionId(), len(mean)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, part, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, n)), *map(pa.array, (mean, m2, lo, hi))], names=["part", "dim", "n", "mean", "m2", "lo", "hi"])

    return samples.select(F.col(features).cast("array<double>")).mapInArrow(run, "part int, dim int, n long, mean double, m2 double, lo double, hi double")


def joined(n: int, mean, m2, k: int, other, other_m2) -> tuple:
    """Mean and sum of squared deviations of two sets together (Chan and others, 1983): no large numbers are subtracted."""
    gap = other - mean
    return mean + gap * (k / (n + k)), m2 + other_m2 + gap * gap * (n * k / (n + k))


def feature_moments(samples: DataFrame) -> DataFrame:
    """dim, n, mean, var_pop, std_samp, lo, hi of each feature.

    The tasks' moments meet around the mean of all, not by differences of
    squares, so features far from 0 keep their variance. One shuffle, by dim.
    """
    all_ = Window.partitionBy("dim")  # a row for each task
    parts = partial_moments(samples).withColumn("total", F.sum("n").over(all_)).withColumn("center", F.sum(F.col("mean") * F.col("n") / F.col("total")).over(all_))
    gap = F.col("mean") - F.col("center")
    merged = parts.groupBy("dim", F.col("total").alias("n"), F.col("center").alias("mean")).agg(F.sum(F.col("m2") + F.col("n") * gap * gap).alias("m2"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.select("dim", "n", "mean", (F.col("m2") / F.col("n")).alias("var_pop"), F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std_samp"), "lo", "hi")


def total_variance(samples: DataFrame) -> DataFrame:
    return feature_moments(samples).agg(F.sum("var_pop").alias("total_variance"))


def centers(assigned: DataFrame, weight: Column | None = None) -> DataFrame:
    """neuron_id, dim, value and hit_count: the weighted mean of each neuron's samples, and how many they are; ``assigned`` carries the samples' features.

    Each task adds up its samples by neuron, so what moves is a table of the map's size from each task.
    """
    ship_package(assigned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            ids, w, x = np.asarray(b.column(0)), np.asarray(b.column(1)), matrix(b.column(2))
            rows, at = np.unique(ids, return_inverse=True)
            hot = np.zeros((len(rows), len(x)))
            hot[at, np.arange(len(x))] = w
            for i, s in zip(rows.tolist(), np.hstack([hot @ x, hot.sum(1, keepdims=True), np.bincount(at)[:, None]])):
                total[i] = total[i] + s if i in total else s
        for i, s in total.items():
            k = len(s) - 2
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, i, np.int32)), pa.array(np.arange(k, dtype=np.int32)), *map(pa.array, (s[:k], np.full(k, s[k]), np.full(k, int(s[k + 1]))))], names=["neuron_id", "dim", "wx", "w", "n"])

    w = F.lit(1.0) if weight is None else weight
    parts = assigned.select("neuron_id", w.cast("double").alias("w"), F.col("features").cast("array<double>")).mapInArrow(run, "neuron_id int, dim int, wx double, w double, n long")
    return parts.groupBy("neuron_id", "dim").agg((F.sum("wx") / F.sum("w")).alias("value"), F.sum("n").alias("hit_count"))


def weighted(assigned: DataFrame, samples: DataFrame) -> DataFrame:
    """Adds sample_weight, by the total variance of the samples (one row, broadcast)."""
    return assigned.crossJoin(F.broadcast(total_variance(samples))).withColumn("sample_weight", sample_weight_col(F.col("distance"), F.col("total_variance")))


def entropy(assigned: DataFrame) -> DataFrame:
    """neuron_id, entropy: of its samples' labels, base 2."""
    counts = assigned.groupBy("neuron_id", "label").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("neuron_id"))  # a row for each neuron and class
    return counts.withColumn("p", share).groupBy("neuron_id").agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"))


def density(assigned: DataFrame, sigma: DataFrame) -> DataFrame:
    """neuron_id, density: mean normal density of its samples' distances; ``sigma`` is one row."""
    return assigned.crossJoin(F.broadcast(sigma)).groupBy("neuron_id").agg(F.avg(normal_pdf_col(F.col("distance"), F.col("sigma"))).alias("density"))


def mode_label(assigned: DataFrame) -> DataFrame:
    """neuron_id, label: the most frequent, ties to the one that is first by id."""
    counts = assigned.groupBy("neuron_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    best = F.min_by("label", F.struct(-F.col("n"), F.col("first")))
    return counts.groupBy("neuron_id").agg(best.alias("label"))


def class_probabilities(assigned: DataFrame) -> DataFrame:
    """neuron_id, label, probability, over the classes that a neuron has samples of."""
    counts = assigned.groupBy("neuron_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("neuron_id", "label", (F.col("n") / F.sum("n").over(Window.partitionBy("neuron_id"))).alias("probability"))


def classes(samples: DataFrame) -> DataFrame:
    """class_index, label: the distinct labels in order."""
    return samples.select("label").where("label is not null").distinct().select((F.row_number().over(Window.orderBy("label")) - 1).alias("class_index"), "label")


def histogram_entropy(samples: DataFrame, bins: int = 20) -> DataFrame:
    """id, entropy (base 2) of the sample's features over equal bins from its least to its largest."""
    low, high = F.array_min("features"), F.array_max("features")
    out = samples.select("id", "features", low.alias("lo"), high.alias("hi"))
    at = F.transform("features", lambda v: F.when(F.col("hi") > F.col("lo"), F.least(F.floor((v - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).otherwise(F.lit(0)))
    out = out.withColumn("at", at)
    shares = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter("at", lambda v: v == b)) / F.size("features"))
    return out.withColumn("p", shares).select("id", F.aggregate("p", F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log(p) / math.log(2)).otherwise(0.0)).alias("entropy"))


def nearest_samples(assigned: DataFrame) -> DataFrame:
    """neuron_id, sample_id, distance: the sample nearest to each prototype, ties to the lower id."""
    best = F.min(F.struct("distance", "id"))
    return assigned.groupBy("neuron_id").agg(best.alias("b")).select("neuron_id", F.col("b.id").alias("sample_id"), F.col("b.distance").alias("distance"))
