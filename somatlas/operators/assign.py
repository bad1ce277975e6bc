"""Nearest-neighbour joins of samples to a map's prototypes.

The map is small (its size is a parameter), the samples are not: the codebook
is broadcast and samples never move. ``assign`` runs an Arrow kernel over
whole batches; ``assign_expr`` is the same join as one Column expression over
a codebook row, for streams and small maps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somatlas.functions.distance import nearest, nearest_rows
from somatlas.runtime import ship_package


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of doubles; raises ValueError where rows differ in length or hold nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if column.null_count:
        raise ValueError("a feature vector is null")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a feature is null")
    if not n:
        return np.empty((0, 0))
    if len(flat) % n or len(set(np.diff(column.offsets.to_numpy()).tolist())) > 1:
        raise ValueError("feature vectors differ in length")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def assign(samples: DataFrame, codebook: np.ndarray, k: int = 1, metric: str = "euclidean", features: str = "features", p: float = 2.0) -> DataFrame:
    """All columns of ``samples`` but the features, with neuron_id and distance (k=2: second_id and second_distance too). No shuffle.

    Columns of these names are replaced, as by ``withColumn``.
    """
    ship_package(samples.sparkSession)
    w = samples.sparkSession.sparkContext.broadcast(np.ascontiguousarray(codebook, dtype=np.float64))
    added = ["neuron_id", "distance", "second_id", "second_distance"][: 2 * k]
    kept = [c for c in samples.columns if c not in (features, *added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, d = nearest_rows(matrix(b.column(b.num_columns - 1)), w.value, k, metric, p)
                new = [x for i in range(k) for x in (pa.array(ids[:, i], pa.int32()), pa.array(d[:, i]))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*kept, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.select(*kept).schema), *(f"{a} {'int' if a.endswith('id') else 'double'}" for a in added)])
    return samples.select(*kept, features).mapInArrow(run, schema)


def codebook_row(neurons: DataFrame) -> DataFrame:
    """One row: ``codebook``, an array of (id, w) ordered by id."""
    return neurons.agg(F.array_sort(F.collect_list(F.struct(F.col("neuron_id").alias("id"), F.col("weight").alias("w")))).alias("codebook"))


def assign_expr(samples: DataFrame, neurons: DataFrame, k: int = 1, metric: str = "euclidean") -> DataFrame:
    """As ``assign``, by expressions: the codebook is one row, so its broadcast is as large as the map."""
    names = (("neuron_id", "distance"), ("second_id", "second_distance"))[:k]
    kept = [c for c in samples.columns if c != "features" and c not in {n for pair in names for n in pair}]
    slim = samples.select(F.struct(*kept, F.lit(0).alias("_")).alias("sample"), "features")
    out = slim.crossJoin(F.broadcast(codebook_row(neurons))).withColumn("near", nearest(F.col("features"), F.col("codebook"), k, metric))
    cols = [c for i, (a, b) in enumerate(names) for c in (F.col("near")[i]["id"].alias(a), F.col("near")[i]["d"].alias(b))]
    return out.select(*(F.col(f"sample.`{c}`") for c in kept), *cols)
