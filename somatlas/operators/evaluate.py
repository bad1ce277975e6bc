"""Evaluation of predictions (label, prediction): one aggregate of the confusion table's size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def accuracy(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def confusion(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion_by_prediction(predicted: DataFrame) -> DataFrame:
    """label, prediction, share of the prediction's rows that have the label."""
    return confusion(predicted).select("label", "prediction", (F.col("n") / F.sum("n").over(Window.partitionBy("prediction"))).alias("share"))


def class_report(predicted: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support of each class that occurs as label or prediction; empty ratios are 0."""
    c = confusion(predicted)
    sides = F.array(F.struct(F.col("label").alias("k"), F.lit(1).alias("t")), F.struct(F.col("prediction").alias("k"), F.lit(0).alias("t")))
    long = c.select("n", (F.col("label") == F.col("prediction")).alias("hit"), F.explode(sides).alias("s"))
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    by = long.groupBy(F.col("s.k").alias("label")).agg(n((F.col("s.t") == 1) & F.col("hit")).alias("tp"), n(F.col("s.t") == 1).alias("support"), n(F.col("s.t") == 0).alias("predicted"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return by.select("label", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support")


def macro_f1(predicted: DataFrame) -> DataFrame:
    return class_report(predicted).agg(F.avg("f1").alias("macro_f1"))


def prototype_colors(weights: np.ndarray) -> list[str]:
    """A colour for each prototype: three principal components as lightness and two opponent axes, as hex."""
    x = weights - weights.mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    c = np.zeros((len(x), 3))
    c[:, : min(3, u.shape[1])] = (u * s)[:, :3]
    span = c.max(0) - c.min(0)
    c = (c - c.min(0)) / np.where(span > 0, span, 1)
    lab = c * [100, 200, 200] - [0, 100, 100]
    # CIE Lab to linear sRGB under the D65 white point.
    f = np.stack([(lab[:, 0] + 16) / 116 + lab[:, 1] / 500, (lab[:, 0] + 16) / 116, (lab[:, 0] + 16) / 116 - lab[:, 2] / 200], 1)
    xyz = np.where(f > 6 / 29, f**3, 3 * (6 / 29) ** 2 * (f - 4 / 29)) * [0.95047, 1.0, 1.08883]
    rgb = xyz @ np.array([[3.2406, -0.9689, 0.0557], [-1.5372, 1.8758, -0.2040], [-0.4986, 0.0415, 1.0570]])
    rgb = np.clip(np.where(rgb > 0.0031308, 1.055 * np.maximum(rgb, 1e-12) ** (1 / 2.4) - 0.055, 12.92 * rgb), 0, 1)
    return ["#" + "".join(f"{round(v * 255):02x}" for v in row) for row in rgb]
