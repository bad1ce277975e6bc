import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from somatlas.operators import evaluate, prep
from somatlas.operators.assign import assign, assign_expr


def test_constant_features(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 4.0])], "id int, features array<double>")
    assert [r["features"] for r in prep.standardize(df).orderBy("id").collect()] == [[0.0, -1.0], [0.0, 1.0]]
    assert [r["features"] for r in prep.min_max(df).orderBy("id").collect()] == [[0.0, 0.0], [0.0, 1.0]]
    assert df.select(prep.l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("f")).first()["f"] == [0.0, 0.0]


def test_columns_with_the_operators_own_names(spark):
    names = ("m", "moments", "_moments", "slot", "n_slots", "category", "__n", "stratum", "rows", "low", "__rank")
    df = spark.createDataFrame([(i, [float(i), 2.0], "abc"[i % 3]) for i in range(9)], "id int, features array<double>, c string").withColumns({n: F.lit(n) for n in names})
    for out in (prep.standardize(df), prep.min_max(df), prep.one_hot(df, "c"), prep.stratified_split(df.drop("__rank"), "c", "id", 0.5)):
        assert len(out.columns) == len(set(out.columns)) and out.count() == 9
        for n in set(names) & set(out.columns):
            assert out.where(F.col(n) != n).count() == 0
    near = assign(df.withColumn("neuron_id", F.lit("x")), np.eye(2))
    assert near.columns.count("neuron_id") == 1 and near.where("neuron_id in (0, 1)").count() == 9
    neurons = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "neuron_id int, weight array<double>")
    near = assign_expr(df.withColumns({"near": F.lit(1), "codebook": F.lit(2), "distance": F.lit("d")}), neurons)
    assert near.columns.count("distance") == 1 and near.where("codebook = 2 and near = 1").count() == 9


def test_donors_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(prep, "MAX_DONORS", 3)
    df = spark.createDataFrame([(0, 1.0, None)], "id int, a double, b double")
    with pytest.raises(ValueError, match="donors"):
        prep.impute_nearest(df, "id", ["a", "b"], df.unionByName(df), 1)


def test_one_hot_unknown_and_null(spark):
    df = spark.createDataFrame([(v,) for v in "aaabbc"] + [(None,)], "c string")
    got = {r["c"]: r["c_slot"] for r in prep.one_hot(df, "c", 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, None: 1}
    assert {r["c"]: r["c_slot"] for r in prep.one_hot(df, "c", 10).collect()} == {"a": 0, "b": 1, "c": 2, None: 3}


def test_imputing(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, None, None), (2, float("inf"), 3.0)], "id int, a double, b double")
    clean = prep.replace_infinite(df, ["a"])
    assert [r["a"] for r in clean.orderBy("id").collect()] == [1.0, None, None]
    out = prep.impute_mean(clean, ["a"]).orderBy("id").collect()
    assert [r["a"] for r in out] == [1.0] * 3 and [r["a_missing"] for r in out] == [0.0, 1.0, 1.0]
    donors = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (9.0, 90.0)], "a double, b double")
    near = prep.impute_nearest(clean, "id", ["a", "b"], donors, k=2).orderBy("id").collect()
    assert near[0]["b"] == 15.0 and near[0]["b_missing"] == 1.0 and near[1]["a"] is None and near[2]["a"] is not None


def test_split_is_by_stratum_and_stable(spark):
    df = spark.range(100).withColumn("s", F.col("id") % 3)
    a = prep.stratified_split(df, "s", "id", 0.25, seed=1)
    b = prep.stratified_split(df.repartition(7), "s", "id", 0.25, seed=1)
    assert a.exceptAll(b).count() == 0
    for r in a.groupBy("s").agg(F.sum(F.col("is_test").cast("int")).alias("t"), F.count("*").alias("n")).collect():
        assert r["t"] == math.ceil(r["n"] * 0.25)


def test_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, prediction int")
    r = {x["label"]: x for x in evaluate.class_report(df).collect()}
    assert r[0]["precision"] == 1.0 and r[0]["recall"] == 0.5 and r[2]["f1"] == 0.0 and r[1]["support"] == 1
    assert evaluate.accuracy(df).first()[0] == 0.5


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id int, features array<double>")
    assert prep.standardize(empty).count() == 0
    assert prep.one_hot(spark.createDataFrame([], "c string"), "c").count() == 0
    assert prep.map_values(F.lit("x"), {"a": 1}) is not None
