"""Fitted maps: state, summaries, and what a model does with new samples."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somatlas.functions.distance import nearest_rows
from somatlas.functions.kernels import VERTICAL_FACTOR, normal_pdf_col
from somatlas.operators import topology
from somatlas.operators.aggregates import nearest_samples
from somatlas.operators.assign import assign, matrix
from somatlas.operators.growth import GrowingMap
from somatlas.plans.nnls import codes
from somatlas.plans.training import LocalSamples, Settings, Trained, train
from somatlas.runtime import ship_package

NEURONS = T.StructType([
    T.StructField("map_id", T.IntegerType()), T.StructField("neuron_id", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()),
    T.StructField("weight", T.ArrayType(T.DoubleType())), T.StructField("epoch_created", T.IntegerType()), T.StructField("error", T.DoubleType()),
    T.StructField("density", T.DoubleType()), T.StructField("hit_count", T.LongType()), T.StructField("average_distance", T.DoubleType()),
    T.StructField("label_index", T.IntegerType()), T.StructField("probabilities", T.ArrayType(T.DoubleType())), T.StructField("child_id", T.IntegerType()),
])


@dataclass
class Summary:
    """Figures of one pass with the final weights: by neuron, and by neuron and class."""

    hits: np.ndarray
    error: np.ndarray
    density: np.ndarray
    apart: float
    classes: np.ndarray
    first: np.ndarray


@dataclass
class MapState:
    cells: list[tuple[int, int]]
    weights: np.ndarray
    created: list[int]
    error: np.ndarray
    density: np.ndarray
    hits: np.ndarray
    average_distance: np.ndarray
    labels: list[int | None]
    probabilities: np.ndarray
    children: list[int | None]
    metrics: dict

    def grid(self) -> GrowingMap:
        return GrowingMap.of(self.cells, self.weights, self.error)


def apart_matrix(grid: GrowingMap, neighbours: int) -> np.ndarray:
    c = np.array(grid.cells).reshape(-1, 2)
    d = np.abs(c[:, None] - c[None, :])
    return d.max(2) > 1 if neighbours == 8 else d.sum(2) > 1


def summarise_local(x: np.ndarray, y: np.ndarray | None, n_classes: int, grid: GrowingMap, s: Settings, sigma: float) -> Summary:
    k = len(grid)
    ids, d = nearest_rows(x, grid.weights, 2, s.metric)
    best, dist = ids[:, 0], d[:, 0]
    pdf = np.exp(-(dist**2) / (2 * sigma**2)) / (sigma * np.sqrt(2 * np.pi)) if sigma > 0 else np.zeros(len(x))
    hits = np.bincount(best, minlength=k)
    counts, first = np.zeros((k, n_classes), np.int64), np.full((k, n_classes), np.iinfo(np.int64).max)
    if y is not None and n_classes:
        np.add.at(counts, (best, y), 1)
        np.minimum.at(first, (best, y), np.arange(len(x)))
    return Summary(hits, np.bincount(best, dist, minlength=k), np.bincount(best, pdf, minlength=k) / np.maximum(hits, 1), float(apart_matrix(grid, s.topology_neighborhood)[best, ids[:, 1]].mean()), counts, first)


def summarise_spark(df: DataFrame, n_classes: int, grid: GrowingMap, s: Settings, sigma: float) -> Summary:
    """One pass and one aggregate by neuron and class; what comes back has the map's size."""
    k, spark = len(grid), df.sparkSession
    apart = apart_matrix(grid, s.topology_neighborhood)
    pairs = F.broadcast(spark.createDataFrame([(i, j, bool(apart[i, j])) for i in range(k) for j in range(k)], "neuron_id int, second_id int, apart boolean"))
    at = assign(df, grid.weights, 2, s.metric).join(pairs, ["neuron_id", "second_id"])
    if not n_classes:
        at = at.withColumn("class_index", F.lit(0))
    pdf = normal_pdf_col(F.col("distance"), F.lit(sigma)) if sigma > 0 else F.lit(0.0)
    rows = at.groupBy("neuron_id", "class_index").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("d"), F.sum(pdf).alias("pdf"), F.sum(F.col("apart").cast("long")).alias("apart"), F.min("id").alias("first")).collect()
    hits, error, density, far = np.zeros(k, np.int64), np.zeros(k), np.zeros(k), 0
    counts, first = np.zeros((k, n_classes), np.int64), np.full((k, n_classes), np.iinfo(np.int64).max)
    order = {v: i for i, v in enumerate(sorted({r["first"] for r in rows}))}
    for r in sorted(rows, key=lambda r: (r["neuron_id"], r["class_index"])):
        i = r["neuron_id"]
        hits[i] += r["n"]
        error[i] += r["d"]
        density[i] += r["pdf"]
        far += r["apart"]
        if n_classes:
            counts[i, r["class_index"]] = r["n"]
            first[i, r["class_index"]] = order[r["first"]]
    return Summary(hits, error, density / np.maximum(hits, 1), far / max(1, int(hits.sum())), counts, first)


def state_of(t: Trained, summary, s: Settings) -> MapState:
    """``summary``(grid, sigma) makes the final pass; dead neurons then go and the rest are labelled."""
    around = t.map.u_matrix(s.u_matrix)
    f: Summary = summary(t.map, float(around.mean()))
    dead = f.hits == 0 if s.remove_dead_neurons else np.zeros(len(t.map), bool)
    live, grid = ~dead, t.map.without(dead)
    shares = f.classes[live] / np.maximum(f.hits[live], 1)[:, None]
    labels = [int(np.lexsort((o, -c))[0]) if c.sum() else None for c, o in zip(f.classes[live], f.first[live])] if f.classes.shape[1] else [None] * int(live.sum())
    metrics = {"quantization_error": float(f.error.sum() / max(1, f.hits.sum())), "topographic_error": f.apart, "n_iter": t.n_iter, "converged": t.converged, "growing_threshold": t.threshold, "total_variance": t.variance, "n_features": t.n_features, "n_samples": t.n_samples}
    return MapState(grid.cells, grid.weights, grid.created, f.error[live], f.density[live], f.hits[live], around[live], labels, shares, [None] * int(live.sum()), metrics)


@dataclass
class Vertical:
    """Child maps: for neurons with an error above 1.5 thresholds and more samples than this, down to this depth."""

    min_samples: int = 100
    max_depth: int = 3


def parents(state: MapState, vertical: Vertical) -> list[int]:
    limit = VERTICAL_FACTOR * state.metrics["growing_threshold"]
    return [i for i in range(len(state.cells)) if state.error[i] > limit and state.hits[i] > vertical.min_samples]


def fit_local(x: np.ndarray, y: np.ndarray | None, n_classes: int, s: Settings, vertical: Vertical | None, depth: int = 0) -> list[MapState]:
    """A map over one array, and its child maps after it; children number into the list."""
    state = state_of(train(LocalSamples(x, y, n_classes), s), lambda grid, sigma: summarise_local(x, y, n_classes, grid, s, sigma), s)
    maps = [state]
    if vertical and depth < vertical.max_depth:
        best = nearest_rows(x, state.weights, 1, s.metric)[0][:, 0]
        for i in parents(state, vertical):
            mine = best == i
            if mine.sum() < len(x):  # a child that is its own parent would never end
                attach(maps, 0, i, fit_local(x[mine], None if y is None else y[mine], n_classes, s, vertical, depth + 1))
    return maps


def attach(maps: list[MapState], parent: int, neuron: int, child: list[MapState]) -> None:
    base = len(maps)
    maps[parent].children[neuron] = base
    maps += [replace(m, children=[None if c is None else c + base for c in m.children]) for m in child]


def features_column(df: DataFrame, name: str):
    """The features as array<double>, whether they come as an array of numbers or as a vector."""
    return (vector_to_array(F.col(name)) if isinstance(df.schema[name].dataType, VectorUDT) else F.col(name)).cast("array<double>")


class FittedMaps:
    """Maps (the first is the root) and, for classifiers, the classes in order."""

    def __init__(self, spark: SparkSession, maps: list[MapState], settings: Settings, classes: list | None = None, probability_mode: str = "mixture"):
        self.spark, self.maps, self.settings, self.classes, self.probability_mode = spark, maps, settings, classes, probability_mode

    @classmethod
    def of_codebook(cls, spark: SparkSession, cells: list[tuple[int, int]], weights: np.ndarray, settings: Settings | None = None) -> FittedMaps:
        """A map of given prototypes, for what needs no training: nearest neurons, errors, mixtures."""
        k = len(cells)
        zero = np.zeros(k)
        return cls(spark, [MapState(list(cells), np.asarray(weights, float), [0] * k, zero, zero, np.zeros(k, np.int64), zero, [None] * k, np.zeros((k, 0)), [None] * k, {})], settings or Settings())

    @property
    def root(self) -> MapState:
        return self.maps[0]

    @property
    def metrics(self) -> dict:
        return self.root.metrics

    def nodes(self, map_id: int | None = None) -> DataFrame:
        """The neurons of all maps, or of one."""
        rows = [
            (m, i, *map(int, s.cells[i]), s.weights[i].tolist(), int(s.created[i]), float(s.error[i]), float(s.density[i]), int(s.hits[i]), float(s.average_distance[i]), s.labels[i], s.probabilities[i].tolist(), s.children[i])
            for m, s in enumerate(self.maps) if map_id in (None, m) for i in range(len(s.cells))
        ]
        return self.spark.createDataFrame(rows, NEURONS)

    def edges(self) -> DataFrame:
        rows = [(m, a, b) for m, s in enumerate(self.maps) for a, b in s.grid().edges()]
        return self.spark.createDataFrame(rows, "map_id int, src int, dst int")

    def _map_rows(self, df: DataFrame, features: str, run, added: list[tuple[str, pa.DataType, str]], drop_features: bool = False) -> DataFrame:
        """All columns of ``df`` and what ``run``(matrix) returns for each batch, column by column."""
        ship_package(df.sparkSession)
        kept = [c for c in df.columns if not (drop_features and c == features)]
        source = df.withColumn("__x", features_column(df, features)).select(*(F.col(c) for c in kept), "__x")
        schema = T.StructType([*df.select(*kept).schema.fields, *(T.StructField(n, T._parse_datatype_string(ddl)) for n, _, ddl in added)])
        if any(isinstance(f.dataType, T.UserDefinedType) for f in schema):
            raise ValueError("drop vector columns first: Arrow has no vectors")

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                if b.num_rows:
                    new = run(matrix(b.column(b.num_columns - 1)))
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(list(v) if isinstance(v, np.ndarray) and v.ndim > 1 else v, t) for v, (_, t, _) in zip(new, added))], names=[*kept, *(n for n, _, _ in added)])

        return source.mapInArrow(batches, schema)

    def assign(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds map_id, neuron_id and distance: the nearest neuron, followed through child maps to a leaf."""
        maps, metric = self.maps, self.settings.metric

        def run(x: np.ndarray):
            return descend(maps, x, metric)

        return self._map_rows(df, features, run, [("map_id", pa.int32(), "int"), ("neuron_id", pa.int32(), "int"), ("distance", pa.float64(), "double")])

    def project(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds coefficients: the non-negative mixture of the root's prototypes that is nearest to the sample, both at unit length."""
        w = self.root.weights
        return self._map_rows(df, features, lambda x: [codes(x, w)], [("coefficients", pa.list_(pa.float64()), "array<double>")])

    def predict_proba(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds probabilities, in the order of the classes: of the mixture, or of the leaf neuron where there are child maps or the mixture is zero."""
        if self.classes is None:
            raise ValueError("only a classifier has class probabilities")
        maps, metric, mixture = self.maps, self.settings.metric, self.probability_mode == "mixture" and len(self.maps) == 1

        def run(x: np.ndarray):
            m, i, _ = descend(maps, x, metric)
            p = np.stack([maps[a].probabilities[b] for a, b in zip(m, i)])
            if mixture:
                mixed = codes(x, maps[0].weights) @ maps[0].probabilities
                total = mixed.sum(1, keepdims=True)
                p = np.where(total > 0, mixed / np.where(total > 0, total, 1), p)
            return [p]

        return self._map_rows(df, features, run, [("probabilities", pa.list_(pa.float64()), "array<double>")])

    def predict(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds prediction: the class of largest probability (the first on ties), or for clusterers the root's neuron."""
        if self.classes is None:
            w, metric = self.root.weights, self.settings.metric
            return self._map_rows(df, features, lambda x: [nearest_rows(x, w, 1, metric)[0][:, 0]], [("prediction", pa.int32(), "int")])
        out = self.predict_proba(df, features)
        best = F.array_position("probabilities", F.array_max("probabilities"))
        return out.withColumn("prediction", F.element_at(F.array(*map(F.lit, self.classes)), best.cast("int")))

    def _two(self, df: DataFrame, features: str) -> DataFrame:
        return assign(df.select(features_column(df, features).alias("features")), self.root.weights, 2, self.settings.metric)

    def quantization_error(self, df: DataFrame, features: str = "features") -> float:
        return self._two(df, features).agg(F.avg("distance")).first()[0]

    def topographic_error(self, df: DataFrame, features: str = "features") -> float:
        return topology.topographic_error(self._two(df, features), self.nodes(0), self.settings.topology_neighborhood).first()[0]

    def topographic_function(self, df: DataFrame, features: str = "features") -> DataFrame:
        """k, positive and negative, by the connectivity that the samples' two nearest neurons make."""
        pairs, n, furthest = self._pairs(df, features)
        return topology.topographic_function(pairs, n, furthest)

    def phi(self, df: DataFrame, ks: list[int], features: str = "features") -> DataFrame:
        return topology.phi(self._pairs(df, features)[0], ks)

    def _pairs(self, df: DataFrame, features: str):
        neurons = self.nodes(0)
        n = len(self.root.cells)
        grid = topology.neuron_pairs(neurons)
        pairs = topology.connectivity(grid, topology.hops(topology.delaunay_edges(self._two(df, features)), n))
        return pairs, n, grid.agg(F.max("chebyshev")).first()[0]

    def nearest_samples(self, df: DataFrame, features: str = "features", key: str = "id") -> DataFrame:
        """neuron_id, sample_id, distance of the sample nearest to each of the root's prototypes."""
        return nearest_samples(assign(df.select(F.col(key).alias("id"), features_column(df, features).alias("features")), self.root.weights, 1, self.settings.metric))

    def save(self, path: str) -> None:
        """neurons and edges as Parquet, everything else as one JSON line."""
        self.nodes().write.mode("overwrite").parquet(f"{path}/neurons")
        self.edges().write.mode("overwrite").parquet(f"{path}/edges")
        meta = {"settings": asdict(self.settings), "classes": self.classes, "probability_mode": self.probability_mode, "metrics": [m.metrics for m in self.maps]}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedMaps:
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        rows: dict[int, list] = {}
        for r in spark.read.schema(NEURONS).parquet(f"{path}/neurons").orderBy("map_id", "neuron_id").collect():
            rows.setdefault(r["map_id"], []).append(r)
        maps = []
        for m, metrics in enumerate(meta["metrics"]):
            rs = rows[m]
            column = lambda name, rs=rs: np.array([r[name] for r in rs])
            maps.append(MapState([(r["x"], r["y"]) for r in rs], column("weight"), [r["epoch_created"] for r in rs], column("error"), column("density"), column("hit_count"), column("average_distance"), [r["label_index"] for r in rs], column("probabilities"), [r["child_id"] for r in rs], metrics))
        return cls(spark, maps, Settings(**meta["settings"]), meta["classes"], meta["probability_mode"])


def descend(maps: list[MapState], x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(map, neuron, distance) of each row's leaf neuron."""
    m, i, d = np.zeros(len(x), np.int32), np.zeros(len(x), np.int32), np.zeros(len(x))
    todo = [(0, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        ids, dist = nearest_rows(x[rows], maps[k].weights, 1, metric)
        m[rows], i[rows], d[rows] = k, ids[:, 0], dist[:, 0]
        for neuron, child in enumerate(maps[k].children):
            below = rows[ids[:, 0] == neuron]
            if child is not None and len(below):
                todo.append((child, below))
    return m, i, d
