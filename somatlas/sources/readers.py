"""Sources that samples come from and sinks that maps go to. All file access is Spark's, so any path it can open will do."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from somatlas.operators.prep import assemble


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",", timestamp_format: str | None = None, drop_nulls: bool = False) -> DataFrame:
    """CSV with a header and a given schema: no pass to guess types. Other separators and timestamp formats are options."""
    reader = spark.read.schema(schema).option("header", True).option("sep", sep)
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format)
    df = reader.csv(path)
    return df.na.drop() if drop_nulls else df


def read_wide_csv(spark: SparkSession, path: str, key: str | None, label: str, n_features: int, sep: str = ",") -> DataFrame:
    """CSV of a label and many numeric columns: id, features and label.

    Without a key column the id is the row's place in the whole input, files in
    the order of their names: one pass counts the rows of each part.
    """
    head = spark.read.option("header", True).option("sep", sep).csv(path).columns
    numbers = [c for c in head if c not in (key, label)][:n_features]
    schema = T.StructType([T.StructField(c, T.StringType() if c in (key, label) else T.DoubleType()) for c in head])
    df = spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)
    if key:
        return assemble(df, numbers).select(F.col(key).alias("id"), "features", F.col(label).alias("label"))
    meta = df.metadataColumn("_metadata")
    df = df.select("*", F.struct(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row")).alias("__at"))
    # Blocks of a file are read in their order, a block by one task, so the rows of a block are numbered without gaps.
    blocks = df.groupBy(F.col("__at.file").alias("file"), F.col("__at.block").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min("__at.row").alias("low"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
    shift = blocks.select(F.col("file").alias("__file"), F.col("block").alias("__block"), (F.coalesce(before, F.lit(0)) - F.col("low")).alias("__shift"))
    out = assemble(df, numbers, "__features").join(F.broadcast(shift), (F.col("__at.file") == F.col("__file")) & (F.col("__at.block") == F.col("__block")))
    return out.select((F.col("__at.row") + F.col("__shift")).alias("id"), F.col("__features").alias("features"), F.col(label).alias("label"))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``.npy`` matrices as id and features; the id is the row's place in the whole input, files in the order of their paths.

    Each file is one task's work; Spark opens it. A first pass reads the files'
    headers for their rows, one number a file.
    """
    files = spark.read.format("binaryFile").load(path)

    def heads(batches):
        for b in batches:
            n = [len(np.atleast_2d(np.load(io.BytesIO(c.as_py()), allow_pickle=False))) for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["path", "n"])

    def run(batches):
        for b in batches:
            for content, base in zip(b.column(0), b.column(1).to_pylist()):
                m = np.atleast_2d(np.load(io.BytesIO(content.as_py()), allow_pickle=False)).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(base + np.arange(len(m))), pa.array(list(m), pa.list_(pa.float64()))], names=["id", "features"])

    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("path").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    bases = files.select("path", "content").mapInArrow(heads, "path string, n long").select("path", F.coalesce(before, F.lit(0)).alias("base"))
    return files.select("path", "content").join(F.broadcast(bases), "path").select("content", "base").mapInArrow(run, "id long, features array<double>")


def read_embeddings(spark: SparkSession, path: str, key: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """Parquet vectors as id, features and label."""
    cols = [F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("features")]
    return spark.read.parquet(path).select(*cols, *([F.col(label).alias("label")] if label else []))


def from_matrix(spark: SparkSession, x: np.ndarray, y: Sequence | None = None) -> DataFrame:
    """A matrix in memory, and labels, as samples numbered by row."""
    rows = pa.table({"id": np.arange(len(x)), "features": pa.array(list(np.asarray(x, float)), pa.list_(pa.float64()))} | ({} if y is None else {"label": pa.array(list(y))}))
    return spark.createDataFrame(rows)


def write_map(nodes: DataFrame, edges: DataFrame, path: str, kind: str = "parquet") -> None:
    """Neurons and edges as Parquet, or as CSV with weights and probabilities as text, for drawing elsewhere."""
    if kind == "csv":
        nodes = nodes.withColumns({c: F.array_join(c, " ") for c in ("weight", "probabilities")})
        nodes.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/neurons")
        edges.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/edges")
    else:
        nodes.write.mode("overwrite").parquet(f"{path}/neurons")
        edges.write.mode("overwrite").parquet(f"{path}/edges")
