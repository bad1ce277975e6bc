"""Packing by cutting-stock column generation over the histogram of lengths.

Full lengths of a document are sequences of their own; what is left of it is a
remainder shorter than a sequence. Remainders fall into classes of ``UNIT``
tokens, rounded up, and a pattern says how many of each class share a
sequence. A linear program over the histogram picks patterns (Gilmore and
Gomory): its prices go to an unbounded knapsack, solved by dynamic
programming, whose best pattern enters the basis until none pays. Uses are
rounded down, patterns take remainders by their rank in the class, and the
documents left over fill, cut where needed, the room that rounding left.

The histogram has at most ``length`` rows, which bounds what the driver sees.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from somatlas.llm.tokens import id_dtype, tokenize
from somatlas.runtime import Scratch, ordered_rank

LENGTH = 2048
UNIT = 16
BLOCK = 1024  # ranks whose running total is one task's


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable counts of the sizes that fit the room."""
    value, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fit = np.flatnonzero(sizes <= c)
        value[c] = value[c - 1]
        if len(fit):
            got = prices[fit] + value[c - sizes[fit]]
            k = int(got.argmax())
            if got[k] > value[c] + 1e-12:
                value[c], choice[c] = got[k], fit[k]
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(value[room]), counts


def choose_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[int, np.ndarray]]:
    """(uses, counts) of patterns, uses rounded down from the linear program's.

    min sum(x), P x = demand, x >= 0. The start basis repeats one class a
    pattern; each round the knapsack prices all patterns and the best enters,
    until none pays. The demand is shifted a little while the basis is chosen,
    each class by another amount, so no round leaves the sum as it is and the
    rounds come to an end.
    """
    m = len(sizes)
    if not m:
        return []
    d = demand / demand.sum()
    shifted = d + 1e-8 * (1 + np.arange(m) / m) / m
    basis = np.diag((room // sizes).astype(float))
    while True:
        prices = np.linalg.solve(basis.T, np.ones(m))
        value, counts = best_pattern(prices, sizes, room)
        if value <= 1 + 1e-9:
            break
        x, step = np.linalg.solve(basis, shifted), np.linalg.solve(basis, counts.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-11, np.maximum(x, 0) / step, np.inf)
        k = int(ratio.argmin())
        if not np.isfinite(ratio[k]):
            break
        basis[:, k] = counts
    x = np.linalg.solve(basis, d) * demand.sum()
    left, out = demand.astype(np.int64).copy(), []
    for k in np.argsort(-(basis.T @ sizes), kind="stable"):
        counts = basis[:, k].astype(np.int64)
        used = counts > 0
        uses = min(int(np.floor(max(0.0, x[k]) + 1e-6)), int((left[used] // counts[used]).min()))
        if uses:
            left -= uses * counts
            out.append((uses, counts))
    return out


def _blocks(low: str, high: str) -> str:
    return f"sequence({low} div {LENGTH}, ({high} - 1) div {LENGTH})"


def plan_pieces(lengths: DataFrame, scratch: Scratch, length: int = LENGTH, ties: Sequence[str] = ()) -> DataFrame:
    """Pieces (uid, start, n, sequence_id, offset) of a table (uid, n_tokens); uid must be unique.

    Every token of a document is in one piece and only the last sequence can
    be padded. Documents without tokens have no piece. Documents of one length
    are ranked by the columns ``ties``, and by uid only where those are equal
    too: with a key and a checksum there, the order of the rows doesn't matter.
    """
    spark: SparkSession = scratch.spark
    docs = lengths.where("n_tokens > 0").select("uid", *ties, (F.col("n_tokens") % length).cast("int").alias("r"), F.expr(f"n_tokens div {length}").alias("full"))
    histogram = docs.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).collect()
    n_full = sum(h["full"] for h in histogram)
    tokens = sum(h["r"] * h["n"] for h in histogram)
    classes: dict[int, int] = {}
    for h in histogram:
        if h["r"]:
            classes[-(-h["r"] // UNIT)] = classes.get(-(-h["r"] // UNIT), 0) + h["n"]
    sizes = np.array(sorted(classes), np.int64)
    patterns = choose_patterns(sizes, np.array([classes[s] for s in sizes.tolist()], np.int64), length // UNIT)

    # Whole patterns, at most as many as the remainders' tokens fill, get sequence numbers and ranges of ranks.
    starts = dict(zip(sizes.tolist(), np.concatenate([[0], np.cumsum([classes[s] for s in sizes.tolist()])]).tolist()))
    taken, n_pattern, rows = dict.fromkeys(classes, 0), 0, []
    for uses, counts in patterns:
        uses = min(uses, tokens // length - n_pattern)
        for k in np.flatnonzero(counts) if uses > 0 else ():
            c, a = int(sizes[k]), int(counts[k])
            low = starts[c] + taken[c]
            rows.append((c, low, low + uses * a, a, n_pattern))
            taken[c] += uses * a
        n_pattern += max(0, uses)
    extra_base = n_pattern + n_full

    rest = docs.where("r > 0").withColumn("class", F.expr(f"(r + {UNIT - 1}) div {UNIT}"))
    ranked = ordered_rank(scratch, rest, [F.col("class"), -F.col("r"), *map(F.col, ties), F.col("uid")], "ranked")
    table = F.broadcast(spark.createDataFrame(rows, "class long, low long, high long, times long, base long"))  # patterns x classes, at most LENGTH / UNIT each
    dealt = ranked.join(table, (ranked["class"] == table["class"]) & ranked["__rank"].between(table["low"], table["high"] - 1), "left")
    dealt = scratch.save(dealt.select("uid", "r", "full", "__rank", F.expr("base + (__rank - low) div times").alias("sequence_id")), "dealt")

    inside = Window.partitionBy("sequence_id").orderBy(F.col("r").desc(), "__rank")  # at most LENGTH / UNIT documents
    placed = dealt.where("sequence_id is not null").withColumn("offset", F.sum("r").over(inside) - F.col("r"))
    out = placed.select("uid", (F.col("full") * length).alias("start"), F.col("r").cast("long").alias("n"), "sequence_id", "offset")

    whole = docs.where("full > 0").select("uid", *ties, F.explode(F.expr("sequence(0L, full - 1)")).alias("piece"))
    whole = ordered_rank(scratch, whole, [*map(F.col, ties), F.col("uid"), F.col("piece")], "whole", rank="place")
    out = out.unionByName(whole.select("uid", (F.col("piece") * length).alias("start"), F.lit(length).cast("long").alias("n"), (F.col("place") + n_pattern).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))

    # The room in the patterns' sequences and the documents left over are intervals on one line.
    room = dealt.where("sequence_id is not null").groupBy("sequence_id").agg(F.sum("r").alias("used")).where(F.col("used") < length)
    room = running_total(scratch, scratch.save(room, "used").withColumn("w", length - F.col("used")), [F.col("sequence_id")], "w", "room").select("sequence_id", "used", F.col("before").alias("s0"), (F.col("before") + F.col("w")).alias("s1"))
    total_room = room.agg(F.max("s1")).first()[0] or 0
    fill = running_total(scratch, dealt.where("sequence_id is null").select("uid", "r", "full", "__rank", F.col("r").cast("long").alias("w")), [F.col("__rank")], "w", "fill")
    fill = fill.select("uid", "full", F.col("before").alias("f0"), (F.col("before") + F.col("w")).alias("f1"))
    cut = fill.where(F.col("f0") < total_room).withColumn("block", F.explode(F.expr(_blocks("f0", "f1"))))
    cut = cut.join(room.withColumn("block", F.explode(F.expr(_blocks("s0", "s1")))), "block").withColumns({"a": F.greatest("s0", "f0"), "b": F.least("s1", "f1")})
    cut = cut.where(f"a < b and block = a div {LENGTH}")
    out = out.unionByName(cut.select("uid", (F.col("full") * length + F.col("a") - F.col("f0")).alias("start"), (F.col("b") - F.col("a")).alias("n"), "sequence_id", (F.col("used") + F.col("a") - F.col("s0")).alias("offset")))
    over = fill.where(F.col("f1") > total_room).withColumns({"g0": F.greatest(F.col("f0"), F.lit(total_room)) - total_room, "g1": F.col("f1") - total_room})
    over = over.withColumn("q", F.explode(F.expr(f"sequence(g0 div {length}, (g1 - 1) div {length})"))).withColumns({"a": F.greatest(F.col("g0"), F.col("q") * length), "b": F.least(F.col("g1"), (F.col("q") + 1) * length)})
    return out.unionByName(over.select("uid", (F.col("full") * length + F.col("a") + total_room - F.col("f0")).alias("start"), (F.col("b") - F.col("a")).alias("n"), (F.col("q") + extra_base).alias("sequence_id"), (F.col("a") % length).alias("offset")))


def running_total(scratch: Scratch, df: DataFrame, order: list, weight: str, name: str) -> DataFrame:
    """Add ``before``: the sum of ``weight`` over all rows before this one in the order given.

    The sums are taken in blocks of ranks, and in blocks of blocks; what is
    left for one task is a row for each BLOCK * BLOCK rows.
    """
    ranked = ordered_rank(scratch, df, order, name, rank="__r").withColumn("__block", F.expr(f"__r div {BLOCK}"))
    sums = ranked.groupBy("__block").agg(F.sum(weight).alias("__sum")).withColumn("__over", F.expr(f"__block div {BLOCK}"))
    before = lambda part, by, value: F.coalesce(F.sum(value).over(Window.partitionBy(part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = sums.groupBy("__over").agg(F.sum("__sum").alias("__osum")).select("__over", before(F.lit(0), "__over", "__osum").alias("__obase"))
    sums = sums.withColumn("__base", before("__over", "__block", "__sum")).join(over, "__over").select("__block", (F.col("__base") + F.col("__obase")).alias("__base"))
    out = ranked.withColumn("before", before("__block", "__r", weight)).join(sums, "__block")
    return out.withColumn("before", F.col("before") + F.col("__base")).drop("__block", "__base", "__r")


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_pieces(tokens: DataFrame, pieces: DataFrame, dtype: str, with_ids: bool = False) -> DataFrame:
    """Cut the documents' ids by the plan; one row for each piece. ``with_ids`` adds the ids themselves, four bytes each.

    A document meets its plan once, whatever the number of its pieces.
    """
    plan = pieces.groupBy("uid").agg(F.collect_list(F.struct("start", "n", "sequence_id", "offset")).alias("plan"))
    rows = tokens.join(plan, "uid").select("doc_id", "n_tokens", "ids", F.col("plan.start").alias("a"), F.col("plan.n").alias("b"), F.col("plan.sequence_id").alias("c"), F.col("plan.offset").alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, bodies = [], []
            for doc_id, n, ids, a, b, c, d in zip(*batch.columns):
                x = np.frombuffer(ids.as_buffer(), dtype)
                for start, length, sequence, offset in zip(a.as_py(), b.as_py(), c.as_py(), d.as_py()):
                    body = x[start : start + length].astype("<u4").tobytes()
                    out.append((doc_id.as_py(), start, length, zlib.crc32(body), n.as_py(), sequence, offset))
                    bodies.append(body if with_ids else None)
            if out:
                cols, schema = [pa.array(v, f.type) for v, f in zip(zip(*out), PIECES)], PIECES
                if with_ids:
                    cols, schema = [*cols, pa.array(bodies, pa.binary())], schema.append(pa.field("ids", pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return rows.mapInArrow(run, PIECES_DDL + ", ids binary" * with_ids)


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str, length: int = LENGTH, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of ``length`` tokens; one row for each piece.

    Null text counts as empty and packs the end id alone; a null doc_id is
    kept; repeated rows are packed as often as they occur; an empty table
    gives no pieces; other columns are ignored. The pieces depend on the rows,
    not on their order or partitions.
    """
    tokens = scratch.save(tokenize(docs, tokenizer, end_id).withColumns({"uid": F.monotonically_increasing_id(), "mark": F.xxhash64("ids")}), "tokens")
    pieces = plan_pieces(tokens.select("uid", "n_tokens", "doc_id", "mark"), scratch, length, ("doc_id", "mark"))
    return cut_pieces(tokens, pieces, id_dtype(tokenizer), with_ids)
