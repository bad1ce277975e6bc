"""Training, models and projections: formulas, invariants, and both ways of running them."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from somatlas.functions.distance import METRICS, nearest_rows, pairwise
from somatlas.operators.evaluate import prototype_colors
from somatlas.plans.estimators import GrowingMapClassifier, GrowingMapClusterer, GrowingMapModel
from somatlas.plans.nnls import codes, nnls, nnls_rows
from somatlas.plans.training import LocalSamples, Settings, SparkSamples, train, update
from somatlas.sources.readers import from_matrix, read_csv, read_npy, read_wide_csv, write_map


def blobs(n=240, classes=3, dim=4, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 4, (classes, dim))
    y = np.arange(n) % classes
    return centers[y] + rng.normal(0, spread, (n, dim)), y


@pytest.mark.parametrize("metric", METRICS)
def test_nearest_rows_against_the_full_matrix(metric):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(200, 5)), rng.normal(size=(17, 5))
    w[9] = w[3]
    x[0] = w[3]
    d = pairwise(x, w, metric)
    ids, got = nearest_rows(x, w, 2, metric)
    want = np.argsort(d, axis=1, kind="stable")[:, :2]
    assert (ids == want).all() and np.allclose(got, np.take_along_axis(d, want, 1))


def one_epoch(x, w, variance, hops, sigma):
    """The epoch's formulas, sample by sample."""
    k = len(w)
    d = np.sqrt(((x[:, None] - w[None]) ** 2).sum(2))
    win, best = d.argmin(1), d.min(1)
    s = 1 - np.sqrt(1 - np.exp(-(best**2) / variance))
    c, n = np.zeros_like(w), np.zeros(k)
    for g in range(k):
        m = win == g
        n[g] = m.sum()
        if n[g]:
            c[g] = (s[m, None] * x[m]).sum(0) / s[m].sum()
    h = np.exp(-(hops**2) / (2 * sigma**2))
    return (h @ (n[:, None] * c)) / (h @ n)[:, None], np.bincount(win, best, minlength=k)


def test_epoch_is_the_formula_for_local_and_spark_samples(spark):
    x, y = blobs()
    w, hops = x[:6] + 0.1, np.abs(np.arange(6)[:, None] - np.arange(6)[None]).astype(float)
    variance = x.var(0).sum()
    want, error = one_epoch(x, w, variance, hops, 0.9)
    df = from_matrix(spark, x, y.tolist()).withColumnRenamed("label", "class_index").repartition(5)
    for samples in (LocalSamples(x, y, 3), SparkSamples(df, 3)):
        sums = samples.epoch(w, Settings(), variance)
        assert np.allclose(update(w, sums, hops, 0.9), want) and np.allclose(sums.d, error)
        assert sums.classes.sum() == len(x)
        m = samples.moments()
        assert m.n == len(x) and np.allclose(m.mean, x.mean(0)) and np.allclose(m.var_pop, x.var(0)) and np.allclose(m.std_samp, x.std(0, ddof=1))
        assert np.allclose(samples.rows(np.array([5, 0])), x[[5, 0]])
        samples.close()


def test_sums_meet_by_neuron_when_there_are_many_partitions(spark):
    x, _ = blobs()
    w = x[:5]
    a, b = (SparkSamples(from_matrix(spark, x).repartition(n)) for n in (2, 70))
    assert np.allclose(a.epoch(w, Settings(), 1.0).table(), b.epoch(w, Settings(), 1.0).table())


def test_dead_neurons_do_not_shift_centres():
    x, _ = blobs()
    w = np.vstack([np.full((1, 4), 1e3), x[:2], np.full((1, 4), -1e3), x[2:4]])
    sums = LocalSamples(x).epoch(w, Settings(sample_weighting="none"), 1.0)
    win = nearest_rows(x, w)[0][:, 0]
    for g in np.unique(win):
        assert np.allclose(sums.centers()[g], x[win == g].mean(0))
    assert sums.n[0] == sums.n[3] == 0


def test_local_and_distributed_training_agree(spark):
    x, y = blobs()
    s = Settings(n_iter=8, spreading_factor=0.9, seed=3)
    a = train(LocalSamples(x), s)
    b = train(SparkSamples(from_matrix(spark, x).repartition(3)), s)
    assert a.map.cells == b.map.cells and np.allclose(a.map.weights, b.map.weights)
    assert len(a.map) > 4


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e9])
def test_features_far_from_zero(spark, offset):
    x, _ = blobs()
    x = x + offset
    s = Settings(n_iter=8, spreading_factor=0.9, seed=3)
    local, spread = LocalSamples(x), SparkSamples(from_matrix(spark, x).repartition(7))
    a, b = local.moments(), spread.moments()
    assert np.allclose(a.var_pop, b.var_pop, rtol=1e-6) and np.allclose(b.var_pop, (x - x.mean(0)).var(0), rtol=1e-6)
    a, b = train(local, s), train(spread, s)
    assert a.map.cells == b.map.cells and np.allclose(a.map.weights - offset, b.map.weights - offset, atol=1e-5) and len(a.map) > 4
    assert np.allclose(a.map.weights.mean(0) - offset, train(LocalSamples(x - offset), s).map.weights.mean(0), atol=0.3)


def test_training_is_repeatable_and_partition_free(spark):
    x, y = blobs()
    df = from_matrix(spark, x, [f"c{v}" for v in y])
    nodes = [GrowingMapClusterer(nIter=10, spreadingFactor=0.9, seed=1, localCells=c).fit(df.repartition(p)).nodes().orderBy("neuron_id").toPandas() for c, p in ((0, 2), (0, 5), (10**6, 3))]
    for n in nodes[1:]:
        assert (n[["x", "y", "hit_count"]] == nodes[0][["x", "y", "hit_count"]]).all(axis=None)
        assert np.allclose(np.stack(n["weight"]), np.stack(nodes[0]["weight"]))


@pytest.mark.parametrize("given", [{}, {"metric": "manhattan"}, {"metric": "cosine"}, {"sampleWeighting": "none", "topologyNeighborhood": 4, "uMatrix": "global"}, {"thresholdMethod": "classical", "decayFunction": "linear"}, {"interiorBlocksGrowth": True, "removeDeadNeurons": False, "convergenceIter": 3}])
def test_clusterer_invariants(spark, given):
    x, _ = blobs()
    df = from_matrix(spark, x)
    model = GrowingMapClusterer(**({"nIter": 12, "spreadingFactor": 0.9, "seed": 0} | given)).fit(df)
    n = model.nodes().toPandas()
    assert n["hit_count"].sum() == len(x) and len(n) >= 1
    if given.get("removeDeadNeurons", True):
        assert (n["hit_count"] > 0).all()
    out = model.transform(df).toPandas()
    assert len(out) == len(x) and out["prediction"].between(0, len(n) - 1).all()
    e = {(r["src"], r["dst"]) for r in model.edges().collect()}
    assert e == {(b, a) for a, b in e}
    assert 0 <= model.metrics["topographic_error"] <= 1
    if given.get("metric", "euclidean") == "euclidean":
        assert np.isclose(model.quantization_error(df), model.metrics["quantization_error"])
        assert (model.topographic_function(df).count()) >= 1
        assert model.nearest_samples(df).count() == (n["hit_count"] > 0).sum()


def test_classifier_separates_blobs(spark):
    x, y = blobs()
    df = from_matrix(spark, x, [f"c{v}" for v in y])
    for given in ({}, {"probabilityMode": "bmu"}, {"growthCriterion": "entropy", "spreadingFactor": 0.3}, {"localCells": 0, "nIter": 8}):
        model = GrowingMapClassifier(**({"nIter": 30, "spreadingFactor": 0.95, "seed": 2} | given)).fit(df)
        assert model.classes == ["c0", "c1", "c2"]
        p = np.stack(model.predict_proba(df).toPandas()["probabilities"])
        assert np.allclose(p.sum(1), 1) and (p >= 0).all()
        assert model.score(df) > 0.9, given


def test_vectors_and_float_arrays_are_features_too(spark):
    x, _ = blobs(40)
    df = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)], ["id", "features"])
    a = GrowingMapClusterer(nIter=4, seed=0).fit(df).weights
    b = GrowingMapClusterer(nIter=4, seed=0).fit(from_matrix(spark, x)).weights
    assert np.allclose(a, b)


def test_vertical_growth(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.2 + 0.8 * (i % 2), (150, 3)) for i, c in enumerate(rng.normal(0, 6, (4, 3)))])
    df = from_matrix(spark, x, [int(i // 150) for i in range(600)])
    trees = []
    for cells in (10**7, 0):
        model = GrowingMapClassifier(nIter=8, spreadingFactor=0.4, thresholdMethod="classical", maxNeurons=6, verticalGrowth=True, minSamplesVerticalGrowth=60, maxDepth=2, seed=0, localCells=cells).fit(df)
        n = model.nodes().toPandas()
        assert n["map_id"].nunique() > 1
        for r in n[n["child_id"].notna()].itertuples():
            assert n[n["map_id"] == r.child_id]["hit_count"].sum() == r.hit_count
        out = model.assign(df).toPandas()
        leaves = {(r.map_id, r.neuron_id) for r in n[n["child_id"].isna()].itertuples()}
        assert set(zip(out["map_id"], out["neuron_id"])) <= leaves
        assert model.score(df) > 0.8
        trees.append(n["map_id"].nunique())
    assert trees[0] == trees[1]


def test_edges_of_the_input(spark):
    same = from_matrix(spark, np.ones((6, 3)))
    model = GrowingMapClusterer(nIter=3, seed=0).fit(same)
    assert np.allclose(model.weights, 1.0)
    with pytest.raises(ValueError, match="at least 4"):
        GrowingMapClusterer(nIter=2).fit(from_matrix(spark, np.ones((3, 2))))
    bad = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0]), (2, [1.0]), (3, [0.0])], "id long, features array<double>")
    with pytest.raises(ValueError, match="length"):
        GrowingMapClusterer(nIter=2).fit(bad)
    null = spark.createDataFrame([(i, [float(i)] if i else None) for i in range(5)], "id long, features array<double>")
    with pytest.raises(ValueError, match="null"):
        GrowingMapClusterer(nIter=2).fit(null)
    nan = from_matrix(spark, np.array([[0.0], [1.0], [np.nan], [3.0], [4.0]]))
    with pytest.raises(ValueError, match="finite"):
        GrowingMapClusterer(nIter=2).fit(nan)
    for wrong in ({"decayFunction": "cubic"}, {"nIter": 0}, {"maxNeurons": 3}, {"coarseTrainingFrac": 0.0}, {"growthCriterion": "entropy"}):
        with pytest.raises(ValueError):
            GrowingMapClusterer(**wrong).fit(same)
    with pytest.raises(ValueError, match="no parameter"):
        GrowingMapClusterer(nSteps=3)


def test_extra_columns_pass_through(spark):
    x, _ = blobs(60)
    df = from_matrix(spark, x).withColumn("distance0", F.lit("a")).withColumn("weight", F.lit(None).cast("string"))
    model = GrowingMapClusterer(nIter=3, seed=0).fit(df)
    assert model.transform(df).columns == [*df.columns, "prediction"]


def test_params_copy_and_persistence(spark, tmp_path):
    x, y = blobs()
    df = from_matrix(spark, x, [f"c{v}" for v in y])
    est = GrowingMapClassifier(nIter=9, seed=4, predictionCol="guess")
    assert est.copy({est.nIter: 5}).value("nIter") == 5 and est.value("nIter") == 9
    model = est.fit(df)
    assert "guess" in model.transform(df).columns
    model.save_maps(str(tmp_path / "m"))
    again = GrowingMapModel.load_maps(spark, str(tmp_path / "m"))
    a, b = (m.maps.predict(df).orderBy("id").toPandas()["prediction"].tolist() for m in (model, again))
    assert a == b and again.classes == model.classes
    write_map(model.nodes(), model.edges(), str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/neurons")).count() == model.nodes().count()


def test_nnls_conditions():
    rng = np.random.default_rng(5)
    for k, d in ((3, 8), (12, 5), (30, 4)):
        dictionary, x = rng.normal(size=(k, d)), rng.normal(size=(40, d))
        c = codes(x, dictionary)
        unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
        grad = unit(x) @ unit(dictionary).T - c @ (unit(dictionary) @ unit(dictionary).T)
        assert (c >= 0).all() and (grad < 1e-7).all() and (np.abs(grad[c > 0]) < 1e-7).all()
    assert nnls(np.eye(2), np.array([-1.0, -2.0])).tolist() == [0, 0]
    assert codes(np.zeros((1, 3)), np.eye(3)).tolist() == [[0, 0, 0]]


def plain_nnls(gram, t, tol=1e-10):
    """Lawson and Hanson for one row."""
    n = len(t)
    c, on = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * n):
        grad = np.where(on, -np.inf, t - gram @ c)
        if grad.max() <= tol:
            break
        on[grad.argmax()] = True
        while on.any():
            s = np.zeros(n)
            s[on] = np.linalg.lstsq(gram[np.ix_(on, on)], t[on], rcond=None)[0]
            if (s[on] > tol).all():
                c = s
                break
            low = on & (s <= tol)
            c = c + (c[low] / np.maximum(c[low] - s[low], 1e-300)).min() * (s - c)
            on &= c > tol
            c = np.where(on, c, 0)
    return c


def test_batched_nnls_against_single_rows():
    rng = np.random.default_rng(6)
    for k, d in ((1, 3), (6, 20), (25, 6), (40, 40)):
        dictionary = rng.normal(size=(k, d)) + 0.3
        if k > 20:
            dictionary[7] = dictionary[3]  # two equal columns, one that is a sum of others, one of zeros
            dictionary[9] = dictionary[1] + dictionary[2]
            dictionary[11] = 0
        x = rng.normal(size=(150, d)) + 0.3
        x[5] = 0
        gram, t = dictionary @ dictionary.T, x @ dictionary.T
        got = nnls_rows(gram, t)
        want = np.stack([plain_nnls(gram, row) for row in t])
        assert (got >= 0).all()
        loss = lambda c: ((x - c @ dictionary) ** 2).sum(1)
        assert np.allclose(loss(got), loss(want), atol=1e-8)
        if k <= 6:
            assert np.allclose(got, want, atol=1e-9)


def test_pipelines_are_saved_with_the_map(spark, tmp_path):
    x, y = blobs()
    df = from_matrix(spark, x, [f"c{v}" for v in y])
    for est in (GrowingMapClusterer(nIter=5, seed=1), GrowingMapClassifier(nIter=5, seed=1, predictionCol="guess", verticalGrowth=True)):
        path = str(tmp_path / type(est).__name__)
        Pipeline(stages=[est]).write().overwrite().save(path + "-unfitted")
        again = Pipeline.load(path + "-unfitted").getStages()[0]
        assert {p.name: v for p, v in again.extractParamMap().items()} == {p.name: v for p, v in est.extractParamMap().items()}
        fitted = Pipeline(stages=[again]).fit(df)
        fitted.write().overwrite().save(path)
        a, b = (m.transform(df).orderBy("id").collect() for m in (fitted, PipelineModel.load(path)))
        assert a == b and est.value("predictionCol") in a[0].asDict()


def test_projection_rebuilds_prototypes(spark):
    x, _ = blobs()
    model = GrowingMapClusterer(nIter=10, spreadingFactor=0.9, seed=0).fit(from_matrix(spark, x))
    out = model.project(from_matrix(spark, model.weights)).orderBy("id").toPandas()
    c = np.stack(out["coefficients"])
    unit = model.weights / np.linalg.norm(model.weights, axis=1, keepdims=True)
    assert np.allclose(c @ unit, unit, atol=1e-6)


def test_sources(spark, tmp_path):
    m = np.arange(12.0).reshape(4, 3)
    np.save(tmp_path / "m.npy", m)
    assert [r["features"] for r in read_npy(spark, str(tmp_path / "m.npy")).orderBy("id").collect()] == m.tolist()
    (tmp_path / "many").mkdir()
    for i, rows in enumerate((m[:1], m[1:3], m[3:])):
        np.save(tmp_path / "many" / f"{i}.npy", rows)
    assert [(r["id"], r["features"]) for r in read_npy(spark, str(tmp_path / "many")).orderBy("id").collect()] == list(enumerate(m.tolist()))
    (tmp_path / "wide").mkdir()
    for i in range(3):
        (tmp_path / "wide" / f"{i}.csv").write_text("label,id,p1\n" + "".join(f"c{i},{10 * i + k},1\n" for k in range(i + 2)))
    wide = read_wide_csv(spark, str(tmp_path / "wide"), None, "label", 2).orderBy("id").collect()
    assert [(r["id"], r["features"][0]) for r in wide] == list(enumerate([0.0, 1.0, 10.0, 11.0, 12.0, 20.0, 21.0, 22.0, 23.0]))
    (tmp_path / "w.csv").write_text("label,p0,p1\na,1,2\nb,3,4\n")
    wide = read_wide_csv(spark, str(tmp_path / "w.csv"), None, "label", 2).orderBy("label").collect()
    assert [(r["label"], r["features"]) for r in wide] == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    (tmp_path / "t.csv").write_text("k\tt\tv\n1\t05/06/2020 10:00\t2\n2\t\t3\n")
    t = read_csv(spark, str(tmp_path / "t.csv"), "k int, t timestamp, v double", "\t", "dd/MM/yyyy HH:mm", drop_nulls=True).collect()
    assert len(t) == 1 and t[0]["t"].month == 6


def test_prototype_colors():
    c = prototype_colors(np.random.default_rng(0).normal(size=(9, 5)))
    assert len(c) == 9 and all(len(x) == 7 and x[0] == "#" for x in c)
    assert len(prototype_colors(np.ones((2, 1)))) == 2
