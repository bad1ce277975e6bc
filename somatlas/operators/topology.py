"""The grid: edges, hops, U-matrix, topographic error and function, connectivity in input space. All of the map's size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from somatlas.functions.distance import distance
from somatlas.functions.kernels import VERTICAL_FACTOR


def grid_edges(neurons: DataFrame) -> DataFrame:
    """src, dst of neighbours on the grid, both directions: four equi-joins in one."""
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    ends = neurons.select(F.col("neuron_id").alias("src"), "x", "y", F.explode(steps).alias("s")).select("src", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    return ends.join(F.broadcast(neurons.select(F.col("neuron_id").alias("dst"), "x", "y")), ["x", "y"]).select("src", "dst")


def neuron_pairs(neurons: DataFrame) -> DataFrame:
    """i, j and the grid's Euclidean, Manhattan and Chebyshev distances."""
    a = neurons.select(F.col("neuron_id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    b = neurons.select(F.col("neuron_id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    dx, dy = F.abs(F.col("xi") - F.col("xj")), F.abs(F.col("yi") - F.col("yj"))
    return a.crossJoin(F.broadcast(b)).select("i", "j", F.sqrt((dx * dx + dy * dy).cast("double")).alias("euclidean"), (dx + dy).cast("long").alias("manhattan"), F.greatest(dx, dy).cast("long").alias("chebyshev"))


def hop_matrix(n: int, edges: list[tuple[int, int]]) -> np.ndarray:
    """Shortest paths in hops between all neurons, inf where there is none: breadth-first from all at once."""
    adjacency = np.zeros((n, n), bool)
    for a, b in edges:
        adjacency[a, b] = adjacency[b, a] = True
    hops, front, seen, step = np.full((n, n), np.inf), np.eye(n, dtype=bool), np.eye(n, dtype=bool), 0
    while front.any():
        hops[front] = step
        front = (front.astype(np.int64) @ adjacency > 0) & ~seen
        seen |= front
        step += 1
    return hops


def hops(edges: DataFrame, n: int) -> DataFrame:
    """i, j, hops for all pairs of neurons that a way connects. The map's edges come to the driver; samples don't."""
    m = hop_matrix(n, [(r["src"], r["dst"]) for r in edges.collect()])
    rows = [(int(i), int(j), int(m[i, j])) for i, j in np.argwhere(np.isfinite(m))]
    return edges.sparkSession.createDataFrame(rows, "i int, j int, hops int")


def u_matrix(neurons: DataFrame, edges: DataFrame, scope: str = "local") -> DataFrame:
    """neuron_id, average_distance: in input space, to the grid neighbours ("local") or to all ends of all edges ("global"); null without any."""
    me = neurons.select("neuron_id", "weight")
    other = neurons.select(F.col("neuron_id").alias("dst"), F.col("weight").alias("w2"))
    if scope == "local":
        pairs = me.join(edges.withColumnRenamed("src", "neuron_id"), "neuron_id", "left").join(F.broadcast(other), "dst", "left")
        return pairs.groupBy("neuron_id").agg(F.avg(distance(F.col("weight"), F.col("w2"))).alias("average_distance"))
    degree = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("degree"))
    pairs = me.crossJoin(F.broadcast(other.join(degree, "dst")))
    return pairs.groupBy("neuron_id").agg((F.sum(F.col("degree") * distance(F.col("weight"), F.col("w2"))) / F.sum("degree")).alias("average_distance"))


def _grid(neurons: DataFrame, n: int) -> DataFrame:
    return F.broadcast(neurons.select(F.col("neuron_id").alias("neuron_id" if n == 1 else "second_id"), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}")))


def topographic_error(top2: DataFrame, neurons: DataFrame, neighbours: int = 8) -> DataFrame:
    """topographic_error: the share of samples whose two nearest neurons are no neighbours on the grid (8: diagonals are)."""
    at = top2.join(_grid(neurons, 1), "neuron_id").join(_grid(neurons, 2), "second_id")
    dx, dy = F.abs(F.col("x1") - F.col("x2")), F.abs(F.col("y1") - F.col("y2"))
    apart = F.greatest(dx, dy) > 1 if neighbours == 8 else dx + dy > 1
    return at.agg(F.avg(apart.cast("double")).alias("topographic_error"))


def delaunay_edges(top2: DataFrame) -> DataFrame:
    """src < dst: neurons that are the two nearest of some sample; deduplicated in each task first."""
    return top2.select(F.least("neuron_id", "second_id").alias("src"), F.greatest("neuron_id", "second_id").alias("dst")).distinct()


def connectivity(pairs: DataFrame, delaunay_hops: DataFrame) -> DataFrame:
    """The grid distances of each pair with its hops over the Delaunay edges (null: no way)."""
    return pairs.join(F.broadcast(delaunay_hops), ["i", "j"], "left").where("i <> j")


def _phi(k: Column) -> Column:
    far = F.count_if((F.col("chebyshev") > k) & (F.col("hops") == 1))
    near = F.count_if((F.col("euclidean") == 1) & (F.col("hops").isNull() | (F.col("hops") > -k)))
    return F.when(k > 0, far).otherwise(near)


def phi(pairs: DataFrame, ks: list[int]) -> DataFrame:
    """k, phi: topology violations at range k; k > 0 counts pairs joined in input space but more than k apart on the grid, k < 0 grid neighbours more than -k apart in input space, 0 is phi(1) + phi(-1)."""
    want = sorted({*ks, *((1, -1) if 0 in ks else ())})
    k = pairs.sparkSession.createDataFrame([(x,) for x in want], "k int")
    each = pairs.crossJoin(F.broadcast(k)).groupBy("k").agg(_phi(F.col("k")).alias("phi"))
    zero = each.where("k in (1, -1)").agg(F.lit(0).alias("k"), F.sum("phi").alias("phi"))
    return each.where(F.col("k").isin([x for x in ks if x])).unionByName(zero if 0 in ks else zero.limit(0))


def topographic_function(pairs: DataFrame, n_neurons: int, max_chebyshev: int) -> DataFrame:
    """k, positive, negative: phi(k) and phi(-k) over the number of neurons, for k = 0 .. max_chebyshev - 1."""
    ks = list(range(max_chebyshev))
    p = phi(pairs, sorted({*ks, *(-k for k in ks)}))
    a = p.where("k >= 0").select("k", (F.col("phi") / n_neurons).alias("positive"))
    b = p.where("k <= 0").select((-F.col("k")).alias("k"), (F.col("phi") / n_neurons).alias("negative"))
    return a.join(b, "k")


def degrees(neurons: DataFrame, edges: DataFrame) -> DataFrame:
    return neurons.join(edges.groupBy(F.col("src").alias("neuron_id")).agg(F.count(F.lit(1)).alias("degree")), "neuron_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def boundary_neurons(neurons: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(neurons, edges).where("degree < 4")


def distribute_errors(errors: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """neuron_id, error after an inner neuron above the threshold has given half of its error to its boundary neighbours in equal parts.

    ``errors`` has neuron_id, error and degree. Givers have degree 4 and takers less, so one step is all.
    """
    giver = errors.where(f"degree = 4 and error > {threshold!r}").select(F.col("neuron_id").alias("src"), (F.col("error") / 2).alias("half"))
    takers = errors.where("degree < 4").select(F.col("neuron_id").alias("dst"))
    links = giver.join(edges, "src").join(takers, "dst")
    n = links.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    gain = links.join(n, "src").groupBy(F.col("dst").alias("neuron_id")).agg(F.sum(F.col("half") / F.col("n")).alias("gain"))
    out = errors.join(gain, "neuron_id", "left").join(giver.select(F.col("src").alias("neuron_id"), "half"), "neuron_id", "left")
    return out.select("neuron_id", "degree", (F.coalesce("half", "error") + F.coalesce("gain", F.lit(0.0))).alias("error"))


def growth_candidates(errors: DataFrame, threshold: float) -> DataFrame:
    """growth_order, neuron_id, error: boundary neurons above the threshold, largest error first, ties to the lower id."""
    order = F.row_number().over(Window.orderBy(F.col("error").desc(), "neuron_id"))  # at most the map's size
    return errors.where((F.col("degree") < 4) & (F.col("error") > threshold)).select(order.alias("growth_order"), "neuron_id", "error")


def vertical_candidates(totals: DataFrame, threshold: float, min_samples: int) -> DataFrame:
    """neuron_id, error, hit_count of the neurons that get a child map: error above 1.5 thresholds, more samples than ``min_samples``."""
    return totals.where((F.col("error") > VERTICAL_FACTOR * threshold) & (F.col("hit_count") > min_samples)).select("neuron_id", "error", "hit_count")


def remove_dead(neurons: DataFrame, totals: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The map without neurons that have no sample, renumbered in order, and its edges."""
    live = neurons.join(totals.where("hit_count > 0").select("neuron_id"), "neuron_id", "left_semi")
    live = live.withColumn("new_id", F.row_number().over(Window.orderBy("neuron_id")) - 1)
    ids = live.select("neuron_id", "new_id")
    kept = edges.join(ids.select(F.col("neuron_id").alias("src"), F.col("new_id").alias("a")), "src").join(ids.select(F.col("neuron_id").alias("dst"), F.col("new_id").alias("b")), "dst")
    return live.drop("neuron_id").withColumnRenamed("new_id", "neuron_id"), kept.select(F.col("a").alias("src"), F.col("b").alias("dst"))
