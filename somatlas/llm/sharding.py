"""Weighted rendezvous hashing of stable record keys.

Each (key, shard) pair gets a uniform number u from the first 52 bits of
md5("<shard>:<key>"); the shard with the largest ``-weight / ln(u)`` owns the
key. A shard's numbers don't depend on how many shards there are, so one more
shard only takes keys into itself, and a shard gets its weight's share of keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somatlas.runtime import Scratch, ordered_rank

SCALE = float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number (int, position in ``weights``) that owns ``key``; the lowest number wins a tie.

    A null key is a key of its own. Weights of zero or less own nothing.
    """
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))
    live = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("rendezvous() needs a shard of positive weight")

    def score(i: int, w: float) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{i}:"), text)), 1, 13), 16, 10).cast("double")
        return F.lit(-w) / F.log((bits + 1.0) / (SCALE + 1.0))

    best = F.array_max(F.array(*(F.struct(score(i, w).alias("s"), F.lit(-i).alias("i")) for i, w in live)))
    return (-best["i"]).cast("int")


def shard_records(docs: DataFrame, scratch: Scratch, n_shards: int = 16, weights: Sequence[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row in a shard by its key; one row out for each row in.

    Returns key, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot
    (the row's place in its shard, by key, checksum and size) and grown_shard
    (the shard if there were one more, of weight 1). Rows with one key share a
    shard, that being what a stable key means; their slots are dealt by a range
    exchange that splits ties, so a key with a third of all rows is no task of
    its own. Null text counts as empty, a null key as a key; empty tables give
    no rows; other columns are ignored.
    """
    weights = list(weights or [1.0] * n_shards)
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, 1.0]).alias("grown_shard"),
    )
    slim = scratch.save(slim, "slim")
    ranked = ordered_rank(scratch, slim, [F.col(c) for c in ("shard", key, "text_crc32", "size")], "ranked")
    first = ranked.groupBy("shard").agg(F.min("__rank").alias("__first"))  # a row for each shard
    return ranked.join(F.broadcast(first), "shard").select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__rank") - F.col("__first")).alias("slot"), "grown_shard"
    )
