"""spark.ml estimators over the training plan: a clusterer and a classifier."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somatlas.plans.model import FittedMaps, Vertical, attach, features_column, fit_local, parents, state_of, summarise_spark
from somatlas.plans.training import Settings, SparkSamples, train
from somatlas.runtime import ship_package

CHILD_CELLS = 4_000_000  # a child map of more samples x features is trained over the cluster, not in one task
MAX_CLASSES = 100_000  # classes, each of which is a number a neuron


def _optional_float(v):
    return None if v is None else float(v)


def _optional_int(v):
    return None if v is None else int(v)


def _param(name: str, doc: str, convert) -> Param:
    return Param(Params._dummy(), name, doc, convert)


_INT, _FLOAT, _STR, _BOOL = TypeConverters.toInt, TypeConverters.toFloat, TypeConverters.toString, TypeConverters.toBoolean


class MapParams(Params):
    """Hyper-parameters and column names; every one can be given to the constructor or to ``setParams``."""

    featuresCol = _param("featuresCol", "array or vector column", _STR)
    idCol = _param("idCol", "column that identifies and orders the samples", _STR)
    labelCol = _param("labelCol", "class labels", _STR)
    predictionCol = _param("predictionCol", "output column", _STR)
    probabilityCol = _param("probabilityCol", "output column of class probabilities", _STR)
    nIter = _param("nIter", "epochs at most", _INT)
    convergenceIter = _param("convergenceIter", "the map grows in every so-many-th epoch", _INT)
    spreadingFactor = _param("spreadingFactor", "above 0: larger means a lower growing threshold and a larger map", _FLOAT)
    sigmaStart = _param("sigmaStart", "neighbourhood width at the start; None follows the map's size", _optional_float)
    sigmaEnd = _param("sigmaEnd", "neighbourhood width at the end; None follows the map's size", _optional_float)
    verticalGrowth = _param("verticalGrowth", "train child maps under neurons with a large error", _BOOL)
    decayFunction = _param("decayFunction", "exponential or linear", _STR)
    learningRate = _param("learningRate", "rate of the exponential decay", _FLOAT)
    verbose = _param("verbose", "print the map's size when training ends", _BOOL)
    coarseTrainingFrac = _param("coarseTrainingFrac", "share of the epochs in which the map may grow", _FLOAT)
    seed = _param("seed", "of the draw of the first four prototypes", _optional_int)
    convergenceThreshold = _param("convergenceThreshold", "training ends below this total change of weights", _FLOAT)
    maxNeurons = _param("maxNeurons", "no growth from this size on", _INT)
    metric = _param("metric", "euclidean, sqeuclidean, manhattan, cosine or chebyshev", _STR)
    thresholdMethod = _param("thresholdMethod", "se or classical", _STR)
    growthCriterion = _param("growthCriterion", "quantization_error or entropy", _STR)
    minSamplesVerticalGrowth = _param("minSamplesVerticalGrowth", "a child map needs more samples than this", _INT)
    maxDepth = _param("maxDepth", "levels of child maps at most", _INT)
    sampleWeighting = _param("sampleWeighting", "exponential or none", _STR)
    topologyNeighborhood = _param("topologyNeighborhood", "8 or 4 grid neighbours in the topographic error", _INT)
    uMatrix = _param("uMatrix", "local or global", _STR)
    interiorBlocksGrowth = _param("interiorBlocksGrowth", "an inner neuron above the threshold ends the growth pass", _BOOL)
    removeDeadNeurons = _param("removeDeadNeurons", "neurons without samples leave the fitted map", _BOOL)
    probabilityMode = _param("probabilityMode", "mixture or bmu", _STR)
    cacheSamples = _param("cacheSamples", "store the samples in the executors while training over the cluster; by default each epoch reads them again", _BOOL)
    localCells = _param("localCells", "samples x features up to which training gathers the samples in the driver's memory", _INT)

    def __init__(self, **given):
        super().__init__()
        self._setDefault(
            featuresCol="features", idCol="id", labelCol="label", predictionCol="prediction", probabilityCol="probabilities", nIter=200, convergenceIter=1, spreadingFactor=0.5, sigmaStart=None, sigmaEnd=None, verticalGrowth=False,
            decayFunction="exponential", learningRate=0.02, verbose=False, coarseTrainingFrac=0.5, seed=None, convergenceThreshold=1e-5, maxNeurons=100, metric="euclidean", thresholdMethod="se", growthCriterion="quantization_error",
            minSamplesVerticalGrowth=100, maxDepth=3, sampleWeighting="exponential", topologyNeighborhood=8, uMatrix="local", interiorBlocksGrowth=False, removeDeadNeurons=True, probabilityMode="mixture", cacheSamples=False, localCells=4_000_000,
        )
        self.setParams(**given)

    def setParams(self, **given):
        for k, v in given.items():
            if not self.hasParam(k):
                raise ValueError(f"no parameter {k!r}")
            self.set(self.getParam(k), v)
        return self

    def value(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def settings(self) -> Settings:
        v = self.value
        return Settings(
            v("nIter"), v("convergenceIter"), v("spreadingFactor"), v("sigmaStart"), v("sigmaEnd"), v("decayFunction"), v("learningRate"), v("coarseTrainingFrac"), v("seed"), v("convergenceThreshold"),
            v("maxNeurons"), v("metric"), v("thresholdMethod"), v("growthCriterion"), v("sampleWeighting"), v("topologyNeighborhood"), v("uMatrix"), v("interiorBlocksGrowth"), v("removeDeadNeurons"),
        )


class _MapEstimator(Estimator, MapParams, DefaultParamsReadable, DefaultParamsWritable):
    labelled = False

    def _samples(self, df: DataFrame) -> tuple[DataFrame, list | None]:
        """id, features (array<double>) and class_index, and the classes in order. Raises ValueError on null ids, features or labels."""
        columns = {"id": F.col(self.value("idCol")), "features": features_column(df, self.value("featuresCol"))}
        if self.labelled:
            columns["label"] = F.col(self.value("labelCol"))
        out = df.select(*(c.alias(n) for n, c in columns.items()))
        broken = F.count_if(F.col("id").isNull() | F.col("features").isNull() | (F.col("label").isNull() if self.labelled else F.lit(False)))
        sizes = out.agg(broken.alias("broken"), F.min(F.size("features")).alias("least"), F.max(F.size("features")).alias("most"), F.count(F.lit(1)).alias("n")).first()
        if sizes["broken"]:
            raise ValueError(f"{sizes['broken']} rows have a null id, feature vector or label")
        if sizes["least"] != sizes["most"]:
            raise ValueError("feature vectors differ in length")
        if sizes["n"] < 4:
            raise ValueError(f"at least 4 samples are needed; got {sizes['n']}")
        self._cells = sizes["n"] * sizes["most"]
        if not self.labelled:
            return out, None
        classes = [r[0] for r in out.select("label").distinct().orderBy("label").limit(MAX_CLASSES + 1).collect()]
        if len(classes) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes")
        index = df.sparkSession.createDataFrame(list(zip(classes, range(len(classes)))), f"label {out.schema['label'].dataType.simpleString()}, class_index int")
        return out.join(F.broadcast(index), "label").select("id", "features", "class_index"), classes

    def _fit(self, df: DataFrame):
        s = self.settings()
        s.check(self.labelled)
        spark = df.sparkSession
        ship_package(spark)
        samples, classes = self._samples(df)
        n_classes = len(classes or ())
        vertical = Vertical(self.value("minSamplesVerticalGrowth"), self.value("maxDepth")) if self.value("verticalGrowth") else None
        if self._cells <= self.value("localCells"):
            x, y = _gather(samples.orderBy("id").toPandas(), n_classes)
            maps = fit_local(x, y, n_classes, s, vertical)
        else:
            maps = self._fit_spark(samples, n_classes, s, vertical)
        fitted = FittedMaps(spark, maps, s, classes, "bmu" if vertical else self.value("probabilityMode"))
        if self.value("verbose"):
            print(f"{len(maps)} maps, {len(fitted.root.cells)} neurons in the first, {fitted.metrics}")
        return self._copyValues(GrowingMapModel(fitted))

    def _fit_spark(self, samples: DataFrame, n_classes: int, s: Settings, vertical: Vertical | None, depth: int = 0) -> list:
        data = SparkSamples(samples, n_classes, self.value("cacheSamples"))
        try:
            state = state_of(train(data, s), lambda grid, sigma: summarise_spark(data.df, n_classes, grid, s, sigma), s)
            maps = [state]
            if vertical and depth < vertical.max_depth:
                self._grow_down(maps, data.df, n_classes, s, vertical, depth)
            return maps
        finally:
            data.close()

    def _grow_down(self, maps: list, samples: DataFrame, n_classes: int, s: Settings, vertical: Vertical, depth: int) -> None:
        """Child maps: those of bounded size side by side, one group a task; larger ones over the cluster, one by one."""
        state = maps[0]
        wanted = parents(state, vertical)
        small = [i for i in wanted if state.hits[i] * state.metrics["n_features"] <= CHILD_CELLS]
        at = FittedMaps(samples.sparkSession, [state], s).assign(samples)

        def fit_child(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            x, y = _gather(group.sort_values("id"), n_classes)
            return pd.DataFrame({"neuron_id": [key[0]], "maps": [pickle.dumps(fit_local(x, y, n_classes, s, vertical, depth + 1))]})

        if small:
            for r in sorted(at.where(F.col("neuron_id").isin(small)).groupBy("neuron_id").applyInPandas(fit_child, "neuron_id int, maps binary").collect()):
                attach(maps, 0, r["neuron_id"], pickle.loads(r["maps"]))
        for i in wanted:
            if i not in small and state.hits[i] < state.metrics["n_samples"]:
                attach(maps, 0, i, self._fit_spark(at.where(F.col("neuron_id") == i).select(*samples.columns), n_classes, s, vertical, depth + 1))

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Fit, then add the mixture coefficients."""
        return self.fit(df).project(df)


def _gather(rows: pd.DataFrame, n_classes: int) -> tuple[np.ndarray, np.ndarray | None]:
    x = np.stack(rows["features"].to_numpy()).astype(float)
    if not np.isfinite(x).all():
        raise ValueError("features must be finite numbers")
    return x, rows["class_index"].to_numpy(np.int64) if n_classes else None


class GrowingMapClusterer(_MapEstimator):
    """Unsupervised: ``transform`` adds the number of the nearest neuron."""


class GrowingMapClassifier(_MapEstimator):
    """Supervised: ``transform`` adds class probabilities and the predicted label."""

    labelled = True


class _ModelWriter(MLWriter):
    def __init__(self, instance: GrowingMapModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.save_maps(f"{path}/maps")


class _ModelReader(MLReader):
    def load(self, path: str) -> GrowingMapModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = GrowingMapModel.load_maps(self.sparkSession, f"{path}/maps")
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


class GrowingMapModel(Model, MapParams, MLReadable, MLWritable):
    """A fitted map. ``maps`` holds it; the methods below work on DataFrames of samples. It is saved alone or as a pipeline's stage."""

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()

    def __init__(self, maps: FittedMaps | None = None):
        super().__init__()
        self.maps = maps

    @property
    def classes(self) -> list | None:
        return self.maps.classes

    @property
    def metrics(self) -> dict:
        """quantization_error, topographic_error, n_iter, converged, growing_threshold, total_variance, n_features, n_samples."""
        return self.maps.metrics

    @property
    def weights(self) -> np.ndarray:
        return self.maps.root.weights

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.maps.predict(df, self.value("featuresCol")).withColumnRenamed("prediction", self.value("predictionCol"))
        return out.withColumnRenamed("probabilities", self.value("probabilityCol")) if self.classes else out

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self.maps.predict_proba(df, self.value("featuresCol")).withColumnRenamed("probabilities", self.value("probabilityCol"))

    def project(self, df: DataFrame) -> DataFrame:
        return self.maps.project(df, self.value("featuresCol"))

    def assign(self, df: DataFrame) -> DataFrame:
        return self.maps.assign(df, self.value("featuresCol"))

    def score(self, df: DataFrame) -> float:
        """Accuracy."""
        label = self.value("labelCol")
        return self.transform(df).agg(F.avg((F.col(self.value("predictionCol")) == F.col(label)).cast("double"))).first()[0]

    def nodes(self) -> DataFrame:
        return self.maps.nodes()

    def edges(self) -> DataFrame:
        return self.maps.edges()

    def quantization_error(self, df: DataFrame) -> float:
        return self.maps.quantization_error(df, self.value("featuresCol"))

    def topographic_error(self, df: DataFrame) -> float:
        return self.maps.topographic_error(df, self.value("featuresCol"))

    def topographic_function(self, df: DataFrame) -> DataFrame:
        return self.maps.topographic_function(df, self.value("featuresCol"))

    def phi(self, df: DataFrame, ks: list[int]) -> DataFrame:
        return self.maps.phi(df, ks, self.value("featuresCol"))

    def nearest_samples(self, df: DataFrame) -> DataFrame:
        return self.maps.nearest_samples(df, self.value("featuresCol"), self.value("idCol"))

    def save_maps(self, path: str) -> None:
        self.maps.save(path)

    @classmethod
    def load_maps(cls, spark, path: str) -> GrowingMapModel:
        return cls(FittedMaps.load(spark, path))
