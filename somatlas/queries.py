"""The catalogue of the engine's own queries over the driver's tables.

``samples`` are the embeddings; the fixed codebook is the first 16 vectors on
a 4 x 4 grid (x = id div 4, y = id mod 4). Results are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somatlas.functions.kernels import growing_threshold, neighbourhood_col, sigma_at
from somatlas.operators import aggregates as agg
from somatlas.operators import evaluate, prep, topology
from somatlas.operators.assign import assign, assign_expr
from somatlas.plans.estimators import GrowingMapClassifier, GrowingMapClusterer
from somatlas.plans.model import FittedMaps
from somatlas.plans.training import SparkSamples
from somatlas.runtime import Scratch, ship_package, table
from somatlas.sources.readers import read_csv, read_embeddings
from somatlas.streaming.scoring import hits_by_window, score_stream

SIDE = 4


def samples(spark: SparkSession, d: str) -> DataFrame:
    return read_embeddings(spark, f"{d}/embeddings.parquet")


def neurons(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).where(F.col("id") < SIDE * SIDE)
    return s.select(F.col("id").cast("int").alias("neuron_id"), F.expr(f"int(id div {SIDE})").alias("x"), F.expr(f"int(id % {SIDE})").alias("y"), F.col("features").alias("weight"))


def codebook(spark: SparkSession, d: str) -> np.ndarray:
    return np.array([r["weight"] for r in neurons(spark, d).orderBy("neuron_id").collect()])


def edges(spark: SparkSession, d: str) -> DataFrame:
    return topology.grid_edges(neurons(spark, d))


def tidy(df: DataFrame) -> DataFrame:
    """Integers as long, doubles at six places."""
    kinds = {f.name: f.dataType for f in df.schema}
    fix = {n: F.round(n, 6) for n, t in kinds.items() if isinstance(t, (T.DoubleType, T.FloatType))} | {n: F.col(n).cast("long") for n, t in kinds.items() if isinstance(t, (T.IntegerType, T.ByteType, T.ShortType))}
    return df.withColumns(fix) if fix else df


def _near(spark, d, k=1, metric="euclidean"):
    return assign(samples(spark, d), codebook(spark, d), k, metric)


def _near_with_features(spark, d):
    s = samples(spark, d)
    return assign(s.withColumn("f", F.col("features")), codebook(spark, d)).withColumnRenamed("f", "features")


def _totals(spark, d):
    return agg.neuron_totals(_near(spark, d), neurons(spark, d))


def _errors(spark, d):
    return topology.degrees(neurons(spark, d).select("neuron_id"), edges(spark, d)).join(_totals(spark, d).select("neuron_id", "error"), "neuron_id")


def _low_threshold(spark, d) -> float:
    """Half of the mean error, so that some neurons are above it and some below."""
    r = _errors(spark, d).agg(F.avg("error")).first()
    return r[0] / 2


def _weighted(spark, d):
    return agg.weighted(_near_with_features(spark, d), samples(spark, d))


def _centers(spark, d):
    return agg.centers(_weighted(spark, d), F.col("sample_weight"))


KERNEL_SIGMA = 1.0


def _kernel(spark, d):
    return topology.hops(edges(spark, d), SIDE * SIDE).withColumn("h", neighbourhood_col(F.col("hops").cast("double"), F.lit(KERNEL_SIGMA)))


def _epoch(spark, d):
    """neuron_id, dim, value: the codebook after one epoch from the fixed one."""
    mass = _centers(spark, d).select(F.col("neuron_id").alias("j"), "dim", "value", F.col("hit_count").cast("double").alias("n"))
    near = mass.join(F.broadcast(_kernel(spark, d)), "j")
    return near.groupBy(F.col("i").alias("neuron_id"), "dim").agg((F.sum(F.col("h") * F.col("n") * F.col("value")) / F.sum(F.col("h") * F.col("n"))).alias("value"))


def _predicted(spark, d):
    near = _near(spark, d)
    return near.select("id", "label", "neuron_id").join(F.broadcast(agg.mode_label(near).withColumnRenamed("label", "prediction")), "neuron_id")


def _pairs(spark, d):
    hops = topology.hops(topology.delaunay_edges(_near(spark, d, 2)), SIDE * SIDE)
    return topology.connectivity(topology.neuron_pairs(neurons(spark, d)), hops)


def _long(df: DataFrame, name: str = "features") -> DataFrame:
    return df.select("id", F.posexplode(name).alias("dim", "value"))


def growing_thresholds(spark, d):
    m = agg.feature_moments(samples(spark, d)).agg(F.sqrt(F.sum(F.col("std_samp") * F.col("std_samp"))).alias("norm"), F.count(F.lit(1)).alias("n")).first()
    std = np.array([m["norm"]])
    rows = [(name, growing_threshold(method, criterion, 0.5, m["n"], std)) for name, method, criterion in (("se", "se", "quantization_error"), ("classical", "classical", "quantization_error"), ("entropy", "se", "entropy"))]
    return spark.createDataFrame(rows, "method string, threshold double")


def sigma_schedule(spark, d):
    rows = [(decay, e, sigma_at(e, SIDE * SIDE, 200, 0.5, e <= 100, decay, 0.02, None, None)) for decay in ("exponential", "linear") for e in range(200)]
    return spark.createDataFrame(rows, "decay string, epoch int, sigma double")


def dead_neuron_removal(spark, d):
    n = neurons(spark, d)
    far = n.where("neuron_id < 2").select((F.col("neuron_id") * 0 + 16 + F.col("neuron_id")).alias("neuron_id"), F.lit(4).alias("x"), F.col("neuron_id").alias("y"), F.transform("weight", lambda v: v * 0 + 1000.0).alias("weight"))
    wide = n.unionByName(far)
    book = np.array([r["weight"] for r in wide.orderBy("neuron_id").collect()])
    totals = agg.neuron_totals(assign(samples(spark, d), book), wide)
    live, _ = topology.remove_dead(wide, totals, topology.grid_edges(wide))
    return live.select("neuron_id", "x", "y")


def customer_segments(spark, d):
    """Customers by recency, frequency and money from orders and lineitem, each to the nearest of four fixed segments."""
    spent = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("money"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(spent, "o_orderkey")
    days = F.datediff(F.lit("1998-12-31").cast("date"), F.max("o_orderdate").cast("date")).cast("double")
    rfm = orders.groupBy(F.col("o_custkey").alias("id")).agg((days / 1000).alias("r"), (F.count(F.lit(1)) / 10).alias("f"), (F.sum("money") / 1e6).alias("m"))
    book = np.array([[0.2, 0.5, 0.5], [0.2, 1.5, 2.0], [1.0, 0.5, 0.5], [1.0, 1.5, 2.0]])
    return assign(prep.assemble(rfm, ["r", "f", "m"]).select("id", "features"), book).groupBy("neuron_id").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("distance"))


def csv_scan(spark, d):
    """events written as tab-separated text and read back with a schema."""
    out = Scratch(spark, "csv")
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    e.write.option("header", True).option("sep", "\t").option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(f"{out.path}/events")
    back = read_csv(spark, f"{out.path}/events", "event_id bigint, ts timestamp, event_type string, value double", "\t", "yyyy-MM-dd HH:mm:ss.SSSSSS", drop_nulls=True)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min(F.unix_micros("ts")).alias("first_us"))


def clean_and_impute(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).when(F.col("event_id") % 11 == 0, None).otherwise(F.col("value")))
    out = prep.impute_mean(prep.replace_infinite(e.select("event_id", "event_type", "v"), ["v"]), ["v"])
    return out.groupBy("event_type").agg(F.sum("v").alias("total"), F.sum("v_missing").alias("missing"))


def stratified_split_counts(spark, d):
    split = prep.stratified_split(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 0.2)
    return split.groupBy("event_type", "is_test").agg(F.count(F.lit(1)).alias("n"))


def fit_clusterer(spark, d, **given):
    return GrowingMapClusterer(**({"nIter": 30, "spreadingFactor": 0.9, "seed": 0} | given)).fit(samples(spark, d))


def train_vq(spark, d):
    n = fit_clusterer(spark, d).nodes()
    return tidy(n.select("neuron_id", "x", "y", "hit_count", "error", "average_distance", "density", "epoch_created"))


def train_vq_distributed(spark, d):
    n = fit_clusterer(spark, d, nIter=6, localCells=0).nodes()
    return tidy(n.select("neuron_id", "x", "y", "hit_count", "error", "average_distance", "density", "epoch_created"))


def train_classifier(spark, d):
    model = GrowingMapClassifier(nIter=20, spreadingFactor=0.9, seed=0).fit(samples(spark, d))
    return tidy(model.transform(samples(spark, d)).select("id", "label", "prediction"))


def train_entropy(spark, d):
    model = GrowingMapClassifier(nIter=20, spreadingFactor=2.0, growthCriterion="entropy", seed=0).fit(samples(spark, d))
    return tidy(model.nodes().select("neuron_id", "x", "y", "hit_count", "label_index"))


def project_nnls(spark, d):
    out = fit_clusterer(spark, d).project(samples(spark, d))
    return tidy(out.select("id", F.posexplode("coefficients").alias("neuron_id", "coefficient")).where("coefficient > 0"))


# A low threshold and small maps, so that neurons stay above 1.5 thresholds and get child maps.
HIERARCHY = {"nIter": 8, "spreadingFactor": 0.95, "thresholdMethod": "classical", "maxNeurons": 6, "verticalGrowth": True, "minSamplesVerticalGrowth": 20, "maxDepth": 2, "seed": 0}
# Two epochs of four neurons: a fit that can be written down in SQL.
TWO_EPOCHS = {"nIter": 2, "maxNeurons": 4, "topologyNeighborhood": 4, "seed": 0}


def two_epoch_map(spark, d, **given):
    n = fit_clusterer(spark, d, **(TWO_EPOCHS | given)).nodes()
    return tidy(n.select("neuron_id", "x", "y", "hit_count", "error", "average_distance", F.posexplode("weight").alias("dim", "value")))


def two_epoch_metrics(spark, d):
    m = fit_clusterer(spark, d, **TWO_EPOCHS).metrics
    return tidy(spark.createDataFrame([(m["quantization_error"], m["topographic_error"], m["total_variance"], m["n_samples"], m["n_features"])], "quantization_error double, topographic_error double, total_variance double, n_samples long, n_features long"))


def two_epoch_round_trip(spark, d):
    """The fitted map saved as a pipeline's stage, loaded and applied."""
    path = f"{Scratch(spark, 'pipeline').path}/model"
    Pipeline(stages=[GrowingMapClusterer(**TWO_EPOCHS)]).fit(samples(spark, d)).write().overwrite().save(path)
    return tidy(PipelineModel.load(path).transform(samples(spark, d)).select("id", "prediction"))


def two_epoch_classes(spark, d, column):
    model = GrowingMapClassifier(**(TWO_EPOCHS | {"probabilityMode": "bmu"})).fit(samples(spark, d))
    if column == "prediction":
        return tidy(model.transform(samples(spark, d)).select("id", "prediction"))
    return tidy(model.predict_proba(samples(spark, d)).select("id", F.posexplode("probabilities").alias("class_index", "probability")).where("probability > 0"))


def two_epoch_entropy(spark, d):
    """The entropy of each neuron's labels and the label that it stands for."""
    n = GrowingMapClassifier(**(TWO_EPOCHS | {"growthCriterion": "entropy"})).fit(samples(spark, d)).nodes()
    e = F.aggregate("probabilities", F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return tidy(n.select("neuron_id", "label_index", e.alias("entropy")))


def project_on_two(spark, d):
    """Mixtures of two prototypes."""
    maps = FittedMaps.of_codebook(spark, [(0, 0), (0, 1)], codebook(spark, d)[:2])
    return tidy(maps.project(samples(spark, d)).select("id", F.posexplode("coefficients").alias("neuron_id", "coefficient")).where("coefficient > 0"))


def total_variance_distributed(spark, d):
    """The variance that training over the cluster uses, of features far from 0."""
    far = samples(spark, d).withColumn("features", F.transform("features", lambda v, i: v + (i % 3) * 1e6))
    return tidy(spark.createDataFrame([(float(SparkSamples(far).moments().var_pop.sum()),)], "total_variance double"))


def vertical_growth(spark, d):
    model = GrowingMapClassifier(**HIERARCHY).fit(samples(spark, d))
    return tidy(model.nodes().groupBy("map_id").agg(F.count(F.lit(1)).alias("n"), F.sum("hit_count").alias("hit_count"), F.count("child_id").alias("children")))


def hierarchical_predict(spark, d):
    model = fit_clusterer(spark, d, **HIERARCHY)
    return tidy(model.assign(samples(spark, d)).select("id", "map_id", "neuron_id", "distance"))


def predict_proba(spark, d):
    model = GrowingMapClassifier(nIter=15, spreadingFactor=0.9, seed=0).fit(samples(spark, d))
    return tidy(model.predict_proba(samples(spark, d)).select("id", F.posexplode("probabilities").alias("class_index", "probability")).where("probability > 0"))


def topographic_function_of_a_fit(spark, d):
    return tidy(fit_clusterer(spark, d, nIter=15).topographic_function(samples(spark, d)))


def prototype_colors(spark, d):
    """The map's prototypes as colours by their principal components."""
    model = fit_clusterer(spark, d, nIter=15)
    return spark.createDataFrame(list(enumerate(evaluate.prototype_colors(model.weights))), "neuron_id long, color string")


def model_round_trip(spark, d):
    model = fit_clusterer(spark, d, nIter=10)
    path = f"{Scratch(spark, 'model').path}/map"
    model.save_maps(path)
    return tidy(type(model).load_maps(spark, path).transform(samples(spark, d)).select("id", "prediction"))


def stream_scoring(spark, d):
    """events as a stream of (value, hour) features to four fixed prototypes, hits by day."""
    out = Scratch(spark, "stream")
    protos = spark.createDataFrame([(0, [0.0, 6.0]), (1, [0.0, 18.0]), (2, [100.0, 6.0]), (3, [100.0, 18.0])], "neuron_id int, weight array<double>")
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 8).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.array("value", F.hour("ts").cast("double")).alias("features"))
    hits = hits_by_window(score_stream(stream, protos), "ts", "1 day", "1 hour")
    done: list[str] = []

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.path}/hits/{number}")
        done.append(f"{out.path}/hits/{number}")

    # Complete mode: append mode would keep the last windows in the state, and drop what comes later than the watermark.
    query = hits.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{out.path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return tidy(spark.read.schema(hits.schema).parquet(done[-1]) if done else spark.createDataFrame([], hits.schema))


Query = Callable[[SparkSession, str], DataFrame]
_SQL = {
    "samples": "samples AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS f, CAST(label AS BIGINT) AS label FROM embeddings)",
    "cb": "cb AS (SELECT id AS nid, id // 4 AS x, id % 4 AS y, f AS w FROM samples WHERE id < 16)",
    "near": "near AS (SELECT s.id, s.label, s.f, c.nid, list_distance(s.f, c.w) AS d, row_number() OVER (PARTITION BY s.id ORDER BY list_distance(s.f, c.w), c.nid) AS r FROM samples s CROSS JOIN cb c)",
    "bmu": "bmu AS (SELECT * FROM near WHERE r = 1)",
    "top2": "top2 AS (SELECT a.id, a.nid AS n1, a.d AS d1, b.nid AS n2, b.d AS d2 FROM near a JOIN near b ON a.id = b.id AND a.r = 1 AND b.r = 2)",
    "totals": "totals AS (SELECT c.nid, count(b.id) AS n, coalesce(sum(b.d), 0.0) AS e FROM cb c LEFT JOIN bmu b ON b.nid = c.nid GROUP BY c.nid)",
    "long": "long AS (SELECT id, label, unnest(range(64)) AS dim, unnest(f) AS v FROM samples)",
    "var": "var AS (SELECT sum(vp) AS tv, sqrt(sum(ss * ss)) AS nrm, count(*) AS k FROM (SELECT var_pop(v) AS vp, stddev_samp(v) AS ss FROM long GROUP BY dim))",
    "edges": "edges AS (SELECT a.nid AS src, b.nid AS dst FROM cb a JOIN cb b ON abs(a.x - b.x) + abs(a.y - b.y) = 1)",
    "deg": "deg AS (SELECT c.nid, count(e.dst) AS degree FROM cb c LEFT JOIN edges e ON e.src = c.nid GROUP BY c.nid)",
    "sw": "sw AS (SELECT b.id, b.nid, b.f, b.label, 1 - sqrt(1 - exp(-(b.d * b.d) / var.tv)) AS s FROM bmu b CROSS JOIN var)",
    "cen": "cen AS (SELECT nid, dim, sum(s * v) / sum(s) AS c FROM (SELECT nid, s, unnest(range(64)) AS dim, unnest(f) AS v FROM sw) GROUP BY nid, dim)",
    "hop": "hop AS (SELECT a.nid AS i, b.nid AS j, abs(a.x - b.x) + abs(a.y - b.y) AS h FROM cb a CROSS JOIN cb b)",
    "epo": "epo AS (SELECT hop.i AS nid, cen.dim, sum(exp(-(h * h) / 2.0) * t.n * cen.c) / sum(exp(-(h * h) / 2.0) * t.n) AS v FROM hop JOIN cen ON cen.nid = hop.j JOIN totals t ON t.nid = hop.j GROUP BY hop.i, cen.dim)",
    "del": "del AS (SELECT DISTINCT least(n1, n2) AS a, greatest(n1, n2) AS b FROM top2)",
    "dele": "dele AS (SELECT a, b FROM del UNION SELECT b, a FROM del)",
    "delh": "walk(i, j, h) AS (SELECT nid, nid, 0 FROM cb UNION SELECT w.i, e.b, w.h + 1 FROM walk w JOIN dele e ON e.a = w.j WHERE w.h < 16), delh AS (SELECT i, j, min(h) AS h FROM walk GROUP BY i, j)",
    "pairs": "pairs AS (SELECT a.nid AS i, b.nid AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS eu, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS ch, delh.h FROM cb a CROSS JOIN cb b LEFT JOIN delh ON delh.i = a.nid AND delh.j = b.nid WHERE a.nid <> b.nid)",
    "mode": "mode AS (SELECT nid, label AS pred FROM (SELECT nid, label, row_number() OVER (PARTITION BY nid ORDER BY count(*) DESC, min(id)) AS r FROM bmu GROUP BY nid, label) WHERE r = 1)",
    "pred": "pred AS (SELECT b.id, b.label, m.pred FROM bmu b JOIN mode m ON m.nid = b.nid)",
    "low": "low AS (SELECT avg(e) / 2 AS gt FROM totals)",
    "err": "err AS (SELECT t.nid, t.e, g.degree FROM totals t JOIN deg g ON g.nid = t.nid)",
}


def _with(names: str, body: str) -> str:
    return "WITH RECURSIVE " + ", ".join(_SQL[n] for n in names.split()) + " " + body


def _metric(expr: str) -> str:
    near = f"SELECT s.id, c.nid, {expr} AS d, row_number() OVER (PARTITION BY s.id ORDER BY {expr}, c.nid) AS r FROM samples s CROSS JOIN cb c"
    return _with("samples cb", f"SELECT id, nid AS neuron_id, round(d, 6) AS distance FROM ({near}) WHERE r = 1")


_NEAR = "samples cb near bmu"


def _two_epochs() -> str:
    """CTEs up to ``live``: the map after two epochs of four neurons (nid, x, y, w), less dead ones, with hits and error; ``last`` has each sample's neuron.

    The first prototypes are rows that a seeded generator draws by the number of rows, listed for the tables' sizes.
    """
    sizes = (100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000)
    ranks = ", ".join(f"({n}, {k}, {r})" for n in sizes for k, r in enumerate(np.random.default_rng(0).choice(n, 4, replace=False)))
    hop = "abs(i.nid // 2 - j.nid // 2) + abs(i.nid % 2 - j.nid % 2)"
    parts = [_SQL["samples"], _SQL["long"], _SQL["var"], f"ranks(n, k, r) AS (VALUES {ranks})", "w0 AS (SELECT k AS nid, f AS w FROM (SELECT f, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM samples) s JOIN ranks USING (n, r))"]
    for e in range(3):
        parts.append(f"n{e} AS (SELECT s.id, s.label, s.f, c.nid, list_distance(s.f, c.w) AS d, row_number() OVER (PARTITION BY s.id ORDER BY list_distance(s.f, c.w), c.nid) AS r FROM samples s CROSS JOIN w{e} c)")
        if e < 2:
            sigma = sigma_at(e, 4, 2, 0.5, True, "exponential", 0.02, None, None)
            parts.append(f"c{e} AS (SELECT nid, dim, sum(s * v) / sum(s) AS c, count(*) AS n FROM (SELECT nid, 1 - sqrt(1 - exp(-(d * d) / var.tv)) AS s, unnest(range(64)) AS dim, unnest(f) AS v FROM n{e} CROSS JOIN var WHERE r = 1) GROUP BY nid, dim)")
            h = f"exp(-(({hop}) * ({hop})) / (2 * {sigma!r} * {sigma!r}))"
            parts.append(f"w{e + 1} AS (SELECT nid, list(v ORDER BY dim) AS w FROM (SELECT i.nid, j.dim, sum({h} * j.n * j.c) / sum({h} * j.n) AS v FROM w{e} i CROSS JOIN c{e} j GROUP BY i.nid, j.dim) GROUP BY nid)")
    parts.append("around AS (SELECT i.nid, avg(list_distance(i.w, j.w)) AS ad FROM w2 i JOIN w2 j ON " + hop + " = 1 GROUP BY i.nid)")
    parts.append("hits AS (SELECT nid, count(*) AS n, sum(d) AS e FROM n2 WHERE r = 1 GROUP BY nid)")
    parts.append("live AS (SELECT row_number() OVER (ORDER BY nid) - 1 AS number, nid, nid // 2 AS x, nid % 2 AS y, w, n, e, ad FROM w2 JOIN hits USING (nid) JOIN around USING (nid))")
    parts.append("last AS (SELECT id, label, d, number, x, y FROM (SELECT s.id, s.label, l.number, l.x, l.y, list_distance(s.f, l.w) AS d, row_number() OVER (PARTITION BY s.id ORDER BY list_distance(s.f, l.w), l.number) AS r FROM samples s CROSS JOIN live l) WHERE r = 1)")
    parts.append("classes AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT label FROM samples))")
    parts.append("shares AS (SELECT number, label, k, count(*) / sum(count(*)) OVER (PARTITION BY number) AS p, min(id) AS first FROM last JOIN classes USING (label) GROUP BY number, label, k)")
    return "WITH " + ", ".join(parts) + " "


_EPOCHS = _two_epochs()
_TWO_MAP = _EPOCHS + "SELECT number AS neuron_id, x, y, n AS hit_count, round(e, 6) AS error, round(ad, 6) AS average_distance, unnest(range(64)) AS dim, unnest(list_transform(w, lambda v: round(v, 6))) AS value FROM live"
_PHI = "CASE WHEN k > 0 THEN count(*) FILTER (WHERE ch > k AND h = 1) ELSE count(*) FILTER (WHERE abs(eu - 1) < 1e-9 AND (h IS NULL OR h > -k)) END"

_CATALOGUE: dict[str, tuple[Query, str | None]] = {
    "bmu_euclidean": (lambda s, d: _near(s, d).select("id", "neuron_id", "distance"), _metric("list_distance(s.f, c.w)")),
    "bmu_expression": (lambda s, d: assign_expr(samples(s, d), neurons(s, d)).select("id", "neuron_id", "distance"), _metric("list_distance(s.f, c.w)")),
    "bmu_manhattan": (lambda s, d: _near(s, d, 1, "manhattan").select("id", "neuron_id", "distance"), _metric("list_sum(list_transform(list_zip(s.f, c.w), lambda z: abs(z[1] - z[2])))")),
    "bmu_chebyshev": (lambda s, d: _near(s, d, 1, "chebyshev").select("id", "neuron_id", "distance"), _metric("list_max(list_transform(list_zip(s.f, c.w), lambda z: abs(z[1] - z[2])))")),
    "bmu_cosine": (lambda s, d: _near(s, d, 1, "cosine").select("id", "neuron_id", "distance"), _metric("list_cosine_distance(s.f, c.w)")),
    "bmu_minkowski": (lambda s, d: assign(samples(s, d), codebook(s, d), 1, "minkowski", p=3.0).select("id", "neuron_id", "distance"), _metric("pow(list_sum(list_transform(list_zip(s.f, c.w), lambda z: pow(abs(z[1] - z[2]), 3))), 1.0 / 3)")),
    "bmu_top2": (lambda s, d: _near(s, d, 2).select("id", "neuron_id", "distance", "second_id", "second_distance"), _with("samples cb near top2", "SELECT id, n1 AS neuron_id, round(d1, 6) AS distance, n2 AS second_id, round(d2, 6) AS second_distance FROM top2")),
    "hit_count": (lambda s, d: _totals(s, d).select("neuron_id", "hit_count"), _with(f"{_NEAR} totals", "SELECT nid AS neuron_id, n AS hit_count FROM totals")),
    "quantization_error_per_neuron": (lambda s, d: _totals(s, d).select("neuron_id", "error"), _with(f"{_NEAR} totals", "SELECT nid AS neuron_id, round(e, 6) AS error FROM totals")),
    "quantization_error_mean": (lambda s, d: agg.mean_error(_near(s, d)), _with(_NEAR, "SELECT round(avg(d), 6) AS quantization_error FROM bmu")),
    "total_variance": (lambda s, d: agg.total_variance(samples(s, d)), _with("samples long var", "SELECT round(tv, 6) AS total_variance FROM var")),
    "feature_std": (lambda s, d: agg.feature_moments(samples(s, d)).select("dim", "std_samp"), _with("samples long", "SELECT dim, round(stddev_samp(v), 6) AS std_samp FROM long GROUP BY dim")),
    "growing_threshold": (growing_thresholds, _with("samples long var", "SELECT 'se' AS method, round(150 * -ln(0.5) * nrm, 6) AS threshold FROM var UNION ALL SELECT 'classical', round(-k * ln(0.5), 6) FROM var UNION ALL SELECT 'entropy', 0.5 FROM var")),
    "sample_weight": (lambda s, d: _weighted(s, d).select("id", "sample_weight"), _with(f"{_NEAR} long var sw", "SELECT id, round(s, 6) AS sample_weight FROM sw")),
    "voronoi_centers_weighted": (lambda s, d: _centers(s, d).drop("hit_count"), _with(f"{_NEAR} long var sw cen", "SELECT nid AS neuron_id, dim, round(c, 6) AS value FROM cen")),
    "voronoi_centers_mean": (lambda s, d: agg.centers(_near_with_features(s, d)).drop("hit_count"), _with(_NEAR, "SELECT nid AS neuron_id, dim, round(avg(v), 6) AS value FROM (SELECT nid, unnest(range(64)) AS dim, unnest(f) AS v FROM bmu) GROUP BY nid, dim")),
    "sigma_schedule": (sigma_schedule, "SELECT decay, epoch, round(CASE WHEN epoch > 100 THEN 0.7 WHEN decay = 'linear' THEN 0.8 * (1 - epoch / 0.5 / 200) + 0.7 * (epoch / 0.5 / 200) ELSE 0.7 + (0.8 - 0.7) * exp(-0.02 * (epoch / 0.5)) END, 6) AS sigma FROM (SELECT unnest(['exponential', 'linear']) AS decay), range(200) t(epoch)"),
    "hop_distance": (lambda s, d: topology.hops(edges(s, d), SIDE * SIDE), _with("samples cb edges", ", walk(i, j, h) AS (SELECT nid, nid, 0 FROM cb UNION SELECT w.i, e.dst, w.h + 1 FROM walk w JOIN edges e ON e.src = w.j WHERE w.h < 8) SELECT i, j, CAST(min(h) AS BIGINT) AS hops FROM walk GROUP BY i, j")),
    "grid_distances": (lambda s, d: topology.neuron_pairs(neurons(s, d)), _with("samples cb", "SELECT a.nid AS i, b.nid AS j, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS euclidean, abs(a.x - b.x) + abs(a.y - b.y) AS manhattan, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS chebyshev FROM cb a CROSS JOIN cb b")),
    "grid_edges": (edges, _with("samples cb edges", "SELECT src, dst FROM edges")),
    "neighborhood_kernel": (lambda s, d: _kernel(s, d).select("i", "j", "h"), _with("samples cb hop", "SELECT i, j, round(exp(-(h * h) / 2.0), 6) AS h FROM hop")),
    "epoch_update": (_epoch, _with(f"{_NEAR} totals long var sw cen hop epo", "SELECT nid AS neuron_id, dim, round(v, 6) AS value FROM epo")),
    "weight_change": (
        lambda s, d: _epoch(s, d).join(neurons(s, d).select("neuron_id", F.posexplode("weight").alias("dim", "old")), ["neuron_id", "dim"]).groupBy("neuron_id").agg(F.sqrt(F.sum(F.pow(F.col("value") - F.col("old"), 2))).alias("c")).agg(F.sum("c").alias("change")),
        _with(f"{_NEAR} totals long var sw cen hop epo", "SELECT round(sum(c), 6) AS change FROM (SELECT epo.nid, sqrt(sum((epo.v - o.v) * (epo.v - o.v))) AS c FROM epo JOIN (SELECT nid, unnest(range(64)) AS dim, unnest(w) AS v FROM cb) o ON o.nid = epo.nid AND o.dim = epo.dim GROUP BY epo.nid)"),
    ),
    "u_matrix_local": (lambda s, d: topology.u_matrix(neurons(s, d), edges(s, d)), _with("samples cb edges", "SELECT a.nid AS neuron_id, round(avg(list_distance(a.w, b.w)), 6) AS average_distance FROM cb a JOIN edges e ON e.src = a.nid JOIN cb b ON b.nid = e.dst GROUP BY a.nid")),
    "u_matrix_global": (lambda s, d: topology.u_matrix(neurons(s, d), edges(s, d), "global"), _with("samples cb edges deg", "SELECT a.nid AS neuron_id, round(sum(g.degree * list_distance(a.w, b.w)) / sum(g.degree), 6) AS average_distance FROM cb a CROSS JOIN cb b JOIN deg g ON g.nid = b.nid GROUP BY a.nid")),
    "node_density": (
        lambda s, d: agg.density(_near(s, d), topology.u_matrix(neurons(s, d), edges(s, d)).agg(F.avg("average_distance").alias("sigma"))),
        _with(f"{_NEAR} edges", ", u AS (SELECT avg(m) AS sg FROM (SELECT avg(list_distance(a.w, b.w)) AS m FROM cb a JOIN edges e ON e.src = a.nid JOIN cb b ON b.nid = e.dst GROUP BY a.nid)) SELECT nid AS neuron_id, round(avg(exp(-(d * d) / (2 * sg * sg)) / (sg * sqrt(2 * pi()))), 6) AS density FROM bmu CROSS JOIN u GROUP BY nid"),
    ),
    "topographic_error_8": (lambda s, d: topology.topographic_error(_near(s, d, 2), neurons(s, d), 8), _with("samples cb near top2", "SELECT round(avg(CASE WHEN greatest(abs(a.x - b.x), abs(a.y - b.y)) > 1 THEN 1.0 ELSE 0.0 END), 6) AS topographic_error FROM top2 JOIN cb a ON a.nid = n1 JOIN cb b ON b.nid = n2")),
    "topographic_error_4": (lambda s, d: topology.topographic_error(_near(s, d, 2), neurons(s, d), 4), _with("samples cb near top2", "SELECT round(avg(CASE WHEN abs(a.x - b.x) + abs(a.y - b.y) > 1 THEN 1.0 ELSE 0.0 END), 6) AS topographic_error FROM top2 JOIN cb a ON a.nid = n1 JOIN cb b ON b.nid = n2")),
    "topographic_error_count": (
        lambda s, d: topology.topographic_error(_near(s, d, 2), neurons(s, d), 8).select((F.col("topographic_error") * SIDE * SIDE).alias("errors")),
        _with("samples cb near top2", "SELECT round(16 * avg(CASE WHEN greatest(abs(a.x - b.x), abs(a.y - b.y)) > 1 THEN 1.0 ELSE 0.0 END), 6) AS errors FROM top2 JOIN cb a ON a.nid = n1 JOIN cb b ON b.nid = n2"),
    ),
    "neuron_label_mode": (lambda s, d: agg.mode_label(_near(s, d)), _with(f"{_NEAR} mode", "SELECT nid AS neuron_id, pred AS label FROM mode")),
    "class_probabilities": (lambda s, d: agg.class_probabilities(_near(s, d)), _with(_NEAR, "SELECT nid AS neuron_id, label, round(count(*) / sum(count(*)) OVER (PARTITION BY nid), 6) AS probability FROM bmu GROUP BY nid, label")),
    "neuron_entropy": (lambda s, d: agg.entropy(_near(s, d)), _with(_NEAR, "SELECT nid AS neuron_id, round(entropy(label), 6) AS entropy FROM bmu GROUP BY nid")),
    "classes": (lambda s, d: agg.classes(samples(s, d)), "SELECT row_number() OVER (ORDER BY label) - 1 AS class_index, CAST(label AS BIGINT) AS label FROM (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL)"),
    "predict_bmu_class": (lambda s, d: _predicted(s, d).select("id", "prediction"), _with(f"{_NEAR} mode pred", "SELECT id, pred AS prediction FROM pred")),
    "score_accuracy": (lambda s, d: evaluate.accuracy(_predicted(s, d)), _with(f"{_NEAR} mode pred", "SELECT round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred")),
    "macro_f1": (
        lambda s, d: evaluate.macro_f1(_predicted(s, d)),
        _with(f"{_NEAR} mode pred", "SELECT round(avg(f1), 6) AS macro_f1 FROM (SELECT c.k, 2.0 * count(*) FILTER (WHERE label = k AND pred = k) / (count(*) FILTER (WHERE label = k) + count(*) FILTER (WHERE pred = k)) AS f1 FROM pred CROSS JOIN (SELECT DISTINCT label AS k FROM pred UNION SELECT DISTINCT pred FROM pred) c GROUP BY c.k)"),
    ),
    "confusion_matrix_pred_norm": (lambda s, d: evaluate.confusion_by_prediction(_predicted(s, d)), _with(f"{_NEAR} mode pred", "SELECT label, pred AS prediction, round(count(*) / sum(count(*)) OVER (PARTITION BY pred), 6) AS share FROM pred GROUP BY label, pred")),
    "boundary_neurons": (lambda s, d: topology.boundary_neurons(neurons(s, d), edges(s, d)).select("neuron_id", "degree"), _with("samples cb edges deg", "SELECT nid AS neuron_id, degree FROM deg WHERE degree < 4")),
    "error_distribution": (
        lambda s, d: topology.distribute_errors(_errors(s, d), edges(s, d), _low_threshold(s, d)).select("neuron_id", "error"),
        _with(f"{_NEAR} totals edges deg low err", ", giver AS (SELECT nid, e / 2 AS half FROM err CROSS JOIN low WHERE degree = 4 AND e > gt), links AS (SELECT g.nid AS src, g.half, t.nid AS dst, count(*) OVER (PARTITION BY g.nid) AS n FROM giver g JOIN edges ON edges.src = g.nid JOIN err t ON t.nid = edges.dst AND t.degree < 4), gain AS (SELECT dst, sum(half / n) AS gain FROM links GROUP BY dst) SELECT err.nid AS neuron_id, round(coalesce(giver.half, err.e) + coalesce(gain.gain, 0), 6) AS error FROM err LEFT JOIN giver ON giver.nid = err.nid LEFT JOIN gain ON gain.dst = err.nid"),
    ),
    "growth_candidates": (lambda s, d: topology.growth_candidates(_errors(s, d), _low_threshold(s, d)), _with(f"{_NEAR} totals edges deg low err", "SELECT row_number() OVER (ORDER BY e DESC, nid) AS growth_order, nid AS neuron_id, round(e, 6) AS error FROM err CROSS JOIN low WHERE degree < 4 AND e > gt")),
    "vertical_candidates": (
        lambda s, d: topology.vertical_candidates(_totals(s, d), _low_threshold(s, d), 20),
        _with(f"{_NEAR} totals low", "SELECT nid AS neuron_id, round(e, 6) AS error, n AS hit_count FROM totals CROSS JOIN low WHERE e > 1.5 * gt AND n > 20"),
    ),
    "class_report": (
        lambda s, d: evaluate.class_report(_predicted(s, d)),
        _with(f"{_NEAR} mode pred", ", c AS (SELECT DISTINCT label AS k FROM pred UNION SELECT DISTINCT pred FROM pred), t AS (SELECT k, count(*) FILTER (WHERE label = k AND pred = k) AS tp, count(*) FILTER (WHERE label = k) AS sup, count(*) FILTER (WHERE pred = k) AS pr FROM pred CROSS JOIN c GROUP BY k) SELECT k AS label, round(CASE WHEN pr > 0 THEN tp / pr ELSE 0 END, 6) AS precision, round(CASE WHEN sup > 0 THEN tp / sup ELSE 0 END, 6) AS recall, round(2 * tp / (pr + sup), 6) AS f1, sup AS support FROM t"),
    ),
    "neuron_degrees": (lambda s, d: topology.degrees(neurons(s, d).select("neuron_id"), edges(s, d)), _with("samples cb edges deg", "SELECT nid AS neuron_id, degree FROM deg")),
    "impute_nearest": (
        lambda s, d: prep.impute_nearest(table(s, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("a"), (F.col("event_id") % 97).cast("double").alias("b")), "event_id", ["a", "b"], s.range(20).select((F.col("id") * 7 + 0.5).alias("a"), (F.col("id") * 5).cast("double").alias("b")), 3).select("event_id", "a", "b", "a_missing"),
        "WITH pool AS (SELECT r * 7 + 0.5 AS a, CAST(r * 5 AS DOUBLE) AS b FROM range(20) t(r)), e AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS a, CAST(event_id % 97 AS DOUBLE) AS b FROM events), near AS (SELECT e.event_id, p.a, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.b - p.b), p.a) AS k FROM e CROSS JOIN pool p WHERE e.a IS NULL), m AS (SELECT event_id, avg(a) AS a FROM near WHERE k <= 3 GROUP BY event_id) SELECT e.event_id, round(coalesce(e.a, m.a), 6) AS a, e.b, CAST(e.a IS NULL AS DOUBLE) AS a_missing FROM e LEFT JOIN m USING (event_id)",
    ),
    "dead_neuron_removal": (dead_neuron_removal, _with("samples cb", "SELECT nid AS neuron_id, x, y FROM cb")),
    "delaunay_edges": (lambda s, d: topology.delaunay_edges(_near(s, d, 2)), _with("samples cb near top2 del", "SELECT a AS src, b AS dst FROM del")),
    "delaunay_hops": (lambda s, d: topology.hops(topology.delaunay_edges(_near(s, d, 2)), SIDE * SIDE), _with("samples cb near top2 del dele delh", "SELECT i, j, CAST(h AS BIGINT) AS hops FROM delh")),
    "phi": (lambda s, d: topology.phi(_pairs(s, d), [-2, -1, 0, 1, 2]), _with("samples cb near top2 del dele delh pairs", f", p AS (SELECT k, {_PHI} AS phi FROM pairs CROSS JOIN (SELECT unnest([-2, -1, 1, 2]) AS k) GROUP BY k) SELECT CAST(k AS BIGINT) AS k, CAST(phi AS BIGINT) AS phi FROM p UNION ALL SELECT 0, CAST(sum(phi) AS BIGINT) FROM p WHERE k IN (-1, 1)")),
    "topographic_function": (
        lambda s, d: topology.topographic_function(_pairs(s, d), SIDE * SIDE, SIDE - 1),
        _with("samples cb near top2 del dele delh pairs", f", p AS (SELECT k, {_PHI} AS phi FROM pairs CROSS JOIN (SELECT unnest([-2, -1, 1, 2]) AS k) GROUP BY k), q AS (SELECT k, phi FROM p UNION ALL SELECT 0, sum(phi) FROM p WHERE k IN (-1, 1)) SELECT CAST(a.k AS BIGINT) AS k, round(a.phi / 16, 6) AS positive, round(b.phi / 16, 6) AS negative FROM q a JOIN q b ON b.k = -a.k WHERE a.k >= 0"),
    ),
    "nearest_sample_per_prototype": (lambda s, d: agg.nearest_samples(_near(s, d)), _with(_NEAR, "SELECT nid AS neuron_id, arg_min(id, (d, id)) AS sample_id, round(min(d), 6) AS distance FROM bmu GROUP BY nid")),
    "map_edges_input_space": (
        lambda s, d: edges(s, d).join(neurons(s, d).select(F.col("neuron_id").alias("src"), F.col("weight")[0].alias("x0"), F.col("weight")[1].alias("y0")), "src").join(neurons(s, d).select(F.col("neuron_id").alias("dst"), F.col("weight")[0].alias("x1"), F.col("weight")[1].alias("y1")), "dst").select("src", "dst", "x0", "y0", "x1", "y1"),
        _with("samples cb edges", "SELECT src, dst, round(a.w[1], 6) AS x0, round(a.w[2], 6) AS y0, round(b.w[1], 6) AS x1, round(b.w[2], 6) AS y1 FROM edges JOIN cb a ON a.nid = src JOIN cb b ON b.nid = dst"),
    ),
    "l2_normalize": (lambda s, d: _long(samples(s, d).withColumn("features", prep.l2_normalize(F.col("features")))), _with("samples", "SELECT id, unnest(range(64)) AS dim, unnest(list_transform(f, lambda v: round(v / nrm, 6))) AS value FROM (SELECT id, f, sqrt(list_dot_product(f, f)) AS nrm FROM samples)")),
    "standardize_pop": (lambda s, d: _long(prep.standardize(samples(s, d))), _with("samples long", "SELECT id, dim, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) AS value FROM long WINDOW w AS (PARTITION BY dim)")),
    "standardize_scale_only": (lambda s, d: _long(prep.standardize(samples(s, d), False)), _with("samples long", "SELECT id, dim, round(v / stddev_pop(v) OVER w, 6) AS value FROM long WINDOW w AS (PARTITION BY dim)")),
    "minmax": (lambda s, d: _long(prep.min_max(samples(s, d))), _with("samples long", "SELECT id, dim, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) AS value FROM long WINDOW w AS (PARTITION BY dim)")),
    "rep_histogram_entropy": (
        lambda s, d: agg.histogram_entropy(samples(s, d)),
        _with("samples long", "SELECT id, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT id, b, count(*) / 64.0 AS p FROM (SELECT id, least(floor((v - lo) * 20 / (hi - lo)), 19) AS b FROM (SELECT id, v, min(v) OVER w AS lo, max(v) OVER w AS hi FROM long WINDOW w AS (PARTITION BY id))) GROUP BY id, b) GROUP BY id"),
    ),
    "one_hot_top_k": (
        lambda s, d: prep.one_hot(table(s, d, "events").select("event_id", "event_type"), "event_type", 4).groupBy("event_type", "event_type_slot").agg(F.count(F.lit(1)).alias("n")),
        "SELECT event_type, CAST(least(row_number() OVER (ORDER BY n DESC, event_type) - 1, 3) AS BIGINT) AS event_type_slot, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)",
    ),
    "stratified_split_counts": (stratified_split_counts, "SELECT event_type, unnest([true, false]) AS is_test, unnest([CAST(ceil(n * 0.2) AS BIGINT), n - CAST(ceil(n * 0.2) AS BIGINT)]) AS n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)"),
    "pivot_long_wide": (
        lambda s, d: prep.pivot(table(s, d, "orders").groupBy(F.col("o_custkey").alias("id"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n")), "id", "o_orderstatus", "n", ["F", "O", "P"]),
        "SELECT o_custkey AS id, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS \"F\", nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS \"O\", nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS \"P\" FROM orders GROUP BY o_custkey",
    ),
    "replace_map": (lambda s, d: table(s, d, "events").select("event_id", prep.map_values(F.col("event_type"), {"purchase": 1, "view": 0, "error": -1}, 0).cast("long").alias("position")), "SELECT event_id, CAST(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS BIGINT) AS position FROM events"),
    "prototype_long": (lambda s, d: prep.prototype_long(neurons(s, d), [f"f{i}" for i in range(64)]), _with("samples cb", "SELECT nid AS neuron_id, 'f' || unnest(range(64)) AS feature, unnest(list_transform(w, lambda v: round(v, 6))) AS value FROM cb")),
    "value_counts": (lambda s, d: samples(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(label AS BIGINT) AS label, count(*) AS n FROM embeddings GROUP BY label"),
    "clean_and_impute": (clean_and_impute, "SELECT event_type, round(sum(coalesce(v, m)), 6) AS total, CAST(count(*) FILTER (WHERE v IS NULL) AS DOUBLE) AS missing FROM (SELECT event_type, v, avg(v) OVER () AS m FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END AS v FROM events)) GROUP BY event_type"),
    "csv_scan": (csv_scan, "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total, min(epoch_us(ts)) AS first_us FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL GROUP BY event_type"),
    "customer_segments": (
        customer_segments,
        "WITH spent AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS money FROM lineitem GROUP BY l_orderkey), rfm AS (SELECT o_custkey AS id, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '1998-12-31') / 1000 AS r, count(*) / 10 AS f, sum(money) / 1e6 AS m FROM orders JOIN spent ON l_orderkey = o_orderkey GROUP BY o_custkey), book(nid, r, f, m) AS (VALUES (0, 0.2, 0.5, 0.5), (1, 0.2, 1.5, 2.0), (2, 1.0, 0.5, 0.5), (3, 1.0, 1.5, 2.0)), near AS (SELECT a.id, b.nid, sqrt((a.r - b.r) ** 2 + (a.f - b.f) ** 2 + (a.m - b.m) ** 2) AS d FROM rfm a CROSS JOIN book b), best AS (SELECT id, nid, d, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS k FROM near) SELECT CAST(nid AS BIGINT) AS neuron_id, count(*) AS n, round(avg(d), 6) AS distance FROM best WHERE k = 1 GROUP BY nid",
    ),
    "two_epoch_map": (two_epoch_map, _TWO_MAP),
    "two_epoch_map_distributed": (lambda s, d: two_epoch_map(s, d, localCells=0), _TWO_MAP),
    "two_epoch_metrics": (two_epoch_metrics, _EPOCHS + ", two AS (SELECT a.nid AS n1, b.nid AS n2, a.d FROM n2 a JOIN n2 b ON a.id = b.id AND a.r = 1 AND b.r = 2) SELECT round(avg(d), 6) AS quantization_error, round(avg(CASE WHEN abs(n1 // 2 - n2 // 2) + abs(n1 % 2 - n2 % 2) > 1 THEN 1.0 ELSE 0.0 END), 6) AS topographic_error, round(min(tv), 6) AS total_variance, count(*) AS n_samples, 64 AS n_features FROM two CROSS JOIN var"),
    "two_epoch_round_trip": (two_epoch_round_trip, _EPOCHS + "SELECT id, number AS prediction FROM last"),
    "two_epoch_predict": (lambda s, d: two_epoch_classes(s, d, "prediction"), _EPOCHS + "SELECT id, best.label AS prediction FROM last JOIN (SELECT number, arg_min(label, (-p, k)) AS label FROM shares GROUP BY number) best USING (number)"),
    "two_epoch_proba": (lambda s, d: two_epoch_classes(s, d, "probabilities"), _EPOCHS + "SELECT id, k AS class_index, round(p, 6) AS probability FROM last JOIN shares USING (number)"),
    "two_epoch_entropy": (two_epoch_entropy, _EPOCHS + "SELECT number AS neuron_id, arg_min(k, (-p, first)) AS label_index, round(-sum(p * log2(p)), 6) AS entropy FROM shares GROUP BY number"),
    "project_on_two": (
        project_on_two,
        _with("samples cb", ", u AS (SELECT nid, list_transform(w, lambda v: v / sqrt(list_dot_product(w, w))) AS w FROM cb WHERE nid < 2), t AS (SELECT s.id, list_dot_product(s.f, a.w) / sqrt(list_dot_product(s.f, s.f)) AS t0, list_dot_product(s.f, b.w) / sqrt(list_dot_product(s.f, s.f)) AS t1, list_dot_product(a.w, b.w) AS g FROM samples s CROSS JOIN (SELECT w FROM u WHERE nid = 0) a CROSS JOIN (SELECT w FROM u WHERE nid = 1) b), c AS (SELECT id, CASE WHEN t0 > g * t1 AND t1 > g * t0 THEN (t0 - g * t1) / (1 - g * g) WHEN t0 >= t1 THEN t0 ELSE 0 END AS c0, CASE WHEN t0 > g * t1 AND t1 > g * t0 THEN (t1 - g * t0) / (1 - g * g) WHEN t1 > t0 THEN t1 ELSE 0 END AS c1 FROM t) SELECT id, 0 AS neuron_id, round(c0, 6) AS coefficient FROM c WHERE c0 > 1e-10 UNION ALL SELECT id, 1, round(c1, 6) FROM c WHERE c1 > 1e-10"),
    ),
    "total_variance_distributed": (total_variance_distributed, _with("samples long var", "SELECT round(tv, 6) AS total_variance FROM var")),
    "train_vq": (train_vq, None),
    "train_vq_distributed": (train_vq_distributed, None),
    "train_classifier": (train_classifier, None),
    "train_entropy": (train_entropy, None),
    "predict_proba": (predict_proba, None),
    "topographic_function_of_a_fit": (topographic_function_of_a_fit, None),
    "prototype_colors": (prototype_colors, None),
    "project_nnls": (project_nnls, None),
    "vertical_growth": (vertical_growth, None),
    "hierarchical_predict": (hierarchical_predict, None),
    "model_round_trip": (model_round_trip, None),
    "stream_scoring": (
        stream_scoring,
        "WITH book(nid, v, h) AS (VALUES (0, 0.0, 6.0), (1, 0.0, 18.0), (2, 100.0, 6.0), (3, 100.0, 18.0)), near AS (SELECT e.event_id, e.ts, b.nid, sqrt((e.value - b.v) ** 2 + (hour(e.ts) - b.h) ** 2) AS d FROM events e CROSS JOIN book b), best AS (SELECT ts, nid, d, row_number() OVER (PARTITION BY event_id ORDER BY d, nid) AS k FROM near) SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, CAST(nid AS BIGINT) AS neuron_id, count(*) AS hits, round(avg(d), 6) AS mean_distance FROM best WHERE k = 1 GROUP BY ALL",
    ),
}


def _tidied(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return tidy(query(spark, sf_dir))

    return run


def queries() -> dict[str, Query]:
    return {name: _tidied(q) for name, (q, _) in _CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql.replace(") , ", "), ") for name, (_, sql) in _CATALOGUE.items() if sql}


def entry(spark: SparkSession) -> DataFrame:
    return train_vq(spark, "/root/testdata/sf0.001")
