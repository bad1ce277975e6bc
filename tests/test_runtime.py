"""Scratch tables and global ranks."""

import os

from pyspark.sql import functions as F

from somatlas.runtime import Scratch, checkpoint_root, ordered_rank


def test_scratch_lives_under_the_shared_folder(spark):
    scratch = Scratch(spark, "t")
    out = scratch.save(spark.range(5), "numbers", compression="zstd")
    assert scratch.path.startswith(checkpoint_root(spark)) and out.count() == 5
    path = out._somatlas_path.removeprefix("file:")
    assert os.path.isdir(path)
    scratch.drop(out)
    assert not os.path.exists(path)


def test_ranks_follow_the_order_and_split_ties(spark):
    scratch = Scratch(spark, "t")
    df = spark.range(5000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(-F.col("id")).alias("b"))
    got = ordered_rank(scratch, scratch.save(df.repartition(6)), [F.col("a"), F.col("b")], "r").orderBy("__rank").collect()
    assert [r["__rank"] for r in got] == list(range(5000))
    keys = [(r["a"], r["b"] is not None, r["b"] or 0) for r in got]
    assert keys == sorted(keys)
    hot = ordered_rank(scratch, scratch.save(spark.range(9000).select(F.lit(1).alias("a")).repartition(8)), [F.col("a")], "h")
    assert sorted(r["__rank"] for r in hot.collect()) == list(range(9000))


def test_no_rows(spark):
    scratch = Scratch(spark, "t")
    assert ordered_rank(scratch, spark.range(0), [F.col("id")], "r").count() == 0
