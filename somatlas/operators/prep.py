"""Preparation of samples: scaling, encoding, imputing, splitting, assembling. All as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from somatlas.functions.distance import norm
from somatlas.operators.aggregates import feature_moments
from somatlas.runtime import Scratch, ordered_rank

MAX_DONORS = 1 << 20  # values of all donors that are sent to every task


def l2_normalize(features: Column) -> Column:
    """Unit length; a zero vector stays."""
    size = norm(features)
    return F.transform(features, lambda v: F.when(size > 0, v / size).otherwise(v))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _by_moments(samples: DataFrame, scale) -> DataFrame:
    """Features by ``scale``(value, moments of the feature); the moments are one row as wide as a sample, from one pass."""
    m = free_name(samples, "moments")
    row = feature_moments(samples).agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "var_pop", "lo", "hi"))).alias(m))
    return samples.crossJoin(F.broadcast(row)).withColumn("features", F.zip_with("features", m, scale)).drop(m)


def standardize(samples: DataFrame, center: bool = True) -> DataFrame:
    """Features over their population deviation, less their mean if ``center``; constant features are divided by 1."""
    return _by_moments(samples, lambda v, s: (v - (s["mean"] if center else F.lit(0.0))) / F.when(s["var_pop"] > 0, F.sqrt(s["var_pop"])).otherwise(1.0))


def min_max(samples: DataFrame) -> DataFrame:
    """Features to 0..1 of their range; constant ones become 0."""
    return _by_moments(samples, lambda v, s: F.when(s["hi"] > s["lo"], (v - s["lo"]) / (s["hi"] - s["lo"])).otherwise(0.0))


def frequent_categories(df: DataFrame, column: str, max_categories: int = 10) -> DataFrame:
    """category, slot: the most frequent values (ties in order) in slots from 0; if there are more than ``max_categories``, the last slot is for all others.

    Each task keeps its first ``max_categories`` + 1 values; no task sorts all of them.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), "category").limit(max_categories + 1)
    ranked = top.withColumn("slot", F.row_number().over(Window.orderBy(F.col("n").desc(), "category")) - 1).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    return ranked.where((F.col("total") <= max_categories) | (F.col("slot") < max_categories - 1)).select("category", "slot")


def one_hot(df: DataFrame, column: str, max_categories: int = 10) -> DataFrame:
    """Adds <column>_slot: the category's slot, or the slot for infrequent and unknown values. The slots are at most ``max_categories`` rows."""
    slot, n, category = (free_name(df, x) for x in ("slot", "n_slots", "category"))
    slots = frequent_categories(df, column, max_categories).select(F.col("category").alias(category), F.col("slot").alias(slot))
    rows = slots.agg(F.count(F.lit(1)).alias(n))
    out = df.join(F.broadcast(slots), df[column] == slots[category], "left").crossJoin(F.broadcast(rows))
    return out.withColumn(f"{column}_slot", F.coalesce(slot, F.col(n)).cast("int")).drop(slot, n, category)


def assemble(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    """Numeric, array and vector-free columns side by side as one array<double>."""
    parts = [F.col(c).cast("array<double>") if df.schema[c].dataType.typeName() == "array" else F.array(F.col(c).cast("double")) for c in columns]
    return df.withColumn(name, F.concat(*parts))


def replace_infinite(df: DataFrame, columns: Sequence[str], value: float | None = None) -> DataFrame:
    """Infinite and NaN values become ``value`` (null by default)."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({c: F.when(bad(F.col(c)), F.lit(value)).otherwise(F.col(c)) for c in columns})


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become the column's mean; <column>_missing is 1.0 where there was one."""
    means = F.broadcast(df.agg(*(F.avg(c).alias(f"__{c}") for c in columns)))
    out = df.crossJoin(means).withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in columns})
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")) for c in columns}).drop(*(f"__{c}" for c in columns))


def impute_nearest(df: DataFrame, key: str, columns: Sequence[str], donors: DataFrame, k: int = 5) -> DataFrame:
    """Nulls become the mean of the k nearest donors' values, by the distance over the columns that both have.

    ``donors`` is a table of bounded size (a sample, or prototypes) and is
    sent to every task; ``df`` does not move. More than MAX_DONORS values
    raise an error.
    """
    rows = donors.count()
    if rows * len(columns) > MAX_DONORS:
        raise ValueError(f"{rows} donors of {len(columns)} columns are more than {MAX_DONORS} values: give a sample or a map's prototypes")
    pool = F.broadcast(donors.agg(F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in columns))).alias("__pool")))
    n = len(columns)

    def gap(d: Column) -> Column:
        squares = F.array(*(F.pow(F.col(c) - d[c], 2) for c in columns))
        known = F.filter(squares, lambda v: v.isNotNull())
        return F.when(F.size(known) > 0, F.sqrt(F.aggregate(known, F.lit(0.0), lambda s, v: s + v) * n / F.size(known)))

    out = df.crossJoin(pool)
    filled = {}
    for c in columns:
        near = F.slice(F.array_sort(F.filter(F.transform("__pool", lambda d: F.struct(gap(d).alias("g"), d[c].alias("v"))), lambda x: x["g"].isNotNull() & x["v"].isNotNull())), 1, k)
        filled[c] = F.coalesce(F.col(c).cast("double"), F.aggregate(near, F.lit(0.0), lambda s, x: s + x["v"]) / F.nullif(F.size(near), F.lit(0)))
    return out.select(*(c for c in df.columns if c not in columns), *(e.alias(c) for c, e in filled.items()), *(F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in columns))


def stratified_split(df: DataFrame, stratum: str, key: str, test_share: float, seed: int = 0) -> DataFrame:
    """Adds is_test: in each stratum the share of rows that come first by a hash of the key, rounded up.

    Rows are ranked over all strata by a range exchange, so a stratum with
    most of the rows is no task of its own; a row for each stratum then tells
    where it begins and how many of its rows are for testing.
    """
    scratch = Scratch(df.sparkSession, "split")
    rank = free_name(df, "__rank")
    ranked = ordered_rank(scratch, df, [F.col(stratum), F.xxhash64(F.lit(seed), F.col(key)), F.col(key)], "ranked", rank=rank)
    s, n, low = (free_name(df, x) for x in ("stratum", "rows", "low"))
    sizes = ranked.groupBy(F.col(stratum).alias(s)).agg(F.count(F.lit(1)).alias(n), F.min(rank).alias(low))
    out = ranked.join(sizes, F.col(stratum).eqNullSafe(F.col(s)))
    return out.withColumn("is_test", F.col(rank) - F.col(low) < F.ceil(F.col(n) * test_share)).drop(rank, s, n, low)


def map_values(column: Column, values: Mapping, default=None) -> Column:
    """Values by a table; others become ``default``."""
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(table[column], F.lit(default))


def pivot(df: DataFrame, row: str, column: str, value: str, columns: Sequence) -> DataFrame:
    """Long to wide with the first value of each cell; ``columns`` are given, which saves a pass and fixes the schema."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.first(value))


def prototype_long(neurons: DataFrame, names: Sequence[str]) -> DataFrame:
    """neuron_id, feature, value."""
    table = F.array(*map(F.lit, names))
    return neurons.select("neuron_id", F.posexplode("weight").alias("dim", "value")).select("neuron_id", F.element_at(table, F.col("dim") + 1).alias("feature"), "value")
