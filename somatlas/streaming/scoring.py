"""Scoring of streams: the nearest-neuron join is stateless, so it runs on a stream as it does on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somatlas.operators.assign import assign_expr


def score_stream(stream: DataFrame, neurons: DataFrame) -> DataFrame:
    """Adds neuron_id and distance to a stream with ``features``; ``neurons`` is a table of the map's size."""
    return assign_expr(stream, neurons)


def hits_by_window(scored: DataFrame, time: str, window: str, watermark: str) -> DataFrame:
    """start, neuron_id, hits and mean distance for each window; in append and update mode rows later than the watermark are dropped, in complete mode none."""
    by = scored.withWatermark(time, watermark).groupBy(F.window(time, window).alias("w"), "neuron_id")
    return by.agg(F.count(F.lit(1)).alias("hits"), F.avg("distance").alias("mean_distance")).select(F.col("w.start").alias("start"), "neuron_id", "hits", "mean_distance")
