"""What every operator needs from the session: scratch tables, package shipping, global ranks.

Scratch tables live under ``spark.checkpoint.dir`` and nowhere else: each
executor and the driver can see that folder, so a lost executor costs a task
and not a result. Only where that setting is absent (tests on one machine) is
a temporary folder made.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Rows and bytes of the batches that go to Python workers, where the session names none: Spark's own 10,000 rows of long texts
# are hundreds of megabytes outside the heap, in every task.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
_ROW_BITS = 33  # monotonically_increasing_id() keeps the row number in its low 33 bits


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names; where none is named, a fresh one of this machine, if Spark runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="somatlas-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each context, and bound the batches they get. The driver serves the archive, so no folder is shared."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    sc = spark.sparkContext
    if getattr(sc, "_somatlas_shipped", False):
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="somatlas-code-")) / "somatlas_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    sc.addPyFile(str(archive))
    sc._somatlas_shipped = True


class Scratch:
    """Parquet tables of one query under the shared folder.

    ``save`` writes a DataFrame and returns the table as read back, which cuts
    lineage; ``drop`` deletes a table that nothing reads any more. What is left
    goes when the driver process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/somatlas/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._remove, self.path)

    def save(self, df: DataFrame, name: str = "t", **options: str) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._somatlas_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._remove(t._somatlas_path)

    def _remove(self, path: str) -> None:
        with contextlib.suppress(Exception):  # the session may be gone at exit
            jvm, jsc = self.spark._jvm, self.spark.sparkContext._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ordered_rank(scratch: Scratch, df: DataFrame, order: Sequence[Column], name: str, rank: str = "__rank") -> DataFrame:
    """Add ``rank``: the row's place, from 0 and without gaps, in the order given.

    A range exchange deals the rows, so no task gets all rows of a key: ties
    are split by a row number of the input. Each sorted partition numbers its
    own rows and the partitions' sizes are summed up to offsets; that table has
    a row for each partition, which bounds what is broadcast. ``df`` is read
    twice (the range exchange samples it), so pass a table, not a long plan.
    Names that start with two underscores are reserved.
    """
    keys = [f"__k{i}" for i in range(len(order))]
    dealt = df.withColumns({k: c for k, c in zip(keys, order)} | {"__uid": F.monotonically_increasing_id()})
    sort = [*(F.col(k).asc_nulls_first() for k in keys), F.col("__uid")]
    dealt = dealt.repartitionByRange(*sort).sortWithinPartitions(*sort)
    dealt = scratch.save(dealt.drop(*keys, "__uid").withColumn("__place", F.monotonically_increasing_id()), name)
    part = F.shiftright("__place", _ROW_BITS)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.min("__place").alias("__low"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__part", (F.coalesce(before, F.lit(0)) - F.col("__low")).alias("__shift"))
    out = dealt.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    return out.withColumn(rank, F.col("__place") + F.col("__shift")).drop("__part", "__place", "__shift")
