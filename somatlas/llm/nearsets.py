"""SimHash near-dedup at a Jaccard similarity: documents whose sets of five-word shingles share at least 4/5, as components.

Two searches give candidate pairs. The first is op7's: 64-bit fingerprints of
the five-word shingles, compared bit-sliced, at 2 or fewer differing bits. At
4/5 fingerprints differ in up to 17 bits, which no banding can look for, so
the second makes the result whole: in any one order of all shingles, two sets
that similar share one of the first ``n - ceil(4n/5) + 1`` shingles of each
(prefix filter), so they meet in the bucket of that shingle. The order is by
how many sampled documents hold a shingle, then by hash: the sample keeps
buckets small and cannot change what is found.

A set's parity sketch has a bit for each residue of its hashes, set if an odd
number of them has it. Two sketches never differ in more bits than there are
shingles that only one set has, so a pair whose sketches differ in too many is
given up without its sets, and no link is lost. What is left is checked on the
whole sets: first the nearest candidate of each set, then only pairs that are
not in one component yet. The rows of a large bucket are compared in cells of
two blocks, where no pair becomes a row: first each row gives the nearest one
of another component, and what is still apart after those have been checked
meets again with whole sets and gives the links that join it. Equal sets are
one node, so copies cost no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somatlas.llm.simhash import SEED, components, links_between, majority, shingle_hashes
from somatlas.runtime import Scratch, ordered_rank

SHINGLE = 5
SIMILARITY = (4, 5)
SAMPLE = 8192  # documents, about, whose shingles are counted for the order
COMMON = 1 << 18  # shingles at most that the order puts last
NEXT = 8  # how many of the sets after it, in a bucket, a set is compared to at once
CHUNK = 1 << 16  # rows that are looked at together
BLOCK = 2048  # rows of a large bucket that are compared to as many others in one go
PAIRS = 1 << 16  # rows of a batch
TEXTS = 512  # texts whose sets are in memory together
FILTER_BITS = 1 << 25  # at most, of the filter that names rows
CELL_BITS = 1 << 13  # at most, of the sketches that the rows of large buckets carry
MEMBERS = 1 << 20  # of all sets of a block whose rows carry whole sets
LINKED = 256  # sets that another one is compared to at once


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    return np.unique(shingle_hashes(text, size))


def sketch(s: np.ndarray) -> bytes:
    """The set's parity sketch; it has a power of two bits, at least twice as many as the set has members."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketches_apart(a: bytes, b: bytes) -> int:
    """In how many bits two sketches differ, the larger one folded: at most the number of members that only one set has."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    if len(x) < len(y):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def shorter_sketch(s: bytes, bits: int = CELL_BITS) -> bytes:
    """The sketch folded to at most ``bits`` bits: it still never differs from another in more bits than there are members that only one set has."""
    x = np.frombuffer(s, np.uint64)
    return s if len(x) <= bits // 64 else np.bitwise_xor.reduce(x.reshape(-1, bits // 64), axis=0).tobytes()


def prefix_of(s: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """The set's first shingles in the order by (count, hash); ``common`` is sorted and has ``counts``, all others count 0."""
    if not len(s):
        return s
    p, q = similarity
    n = len(s) - -(-p * len(s) // q) + 1
    if not len(common):
        return s[:n]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    return s[np.argsort(np.where(common[at] == s, counts[at], 0), kind="stable")[:n]]


def some_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of TEXTS rows, so that no task holds the sets of a whole batch."""
    for b in batches:
        for at in range(0, b.num_rows, TEXTS):
            yield b.slice(at, TEXTS)


def common_shingles(keyed: DataFrame, n: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than one document of a bounded sample holds, sorted, and in how many; at most COMMON. ``keyed`` has f, r and text, and about ``n`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), size).view(np.int64))], names=["token"])

    picked = keyed.where(F.pmod(F.xxhash64("f", "r"), F.lit(max(1, n // SAMPLE))) == 0).select("text")
    found = picked.mapInArrow(run, "token long").groupBy("token").count().where("count > 1").orderBy(F.desc("count"), "token").limit(COMMON).toArrow()
    tokens, counts = np.asarray(found.column(0).combine_chunks()).view(np.uint64), np.asarray(found.column(1).combine_chunks())
    at = np.argsort(tokens)
    return tokens[at], counts[at]


def possible(n: np.ndarray, place: np.ndarray, i, j, similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """Whether i and j can be similar if the shingle of their bucket is the first they share."""
    p, q = similarity
    return np.minimum(n[i] - place[i], n[j] - place[j]) * (p + q) >= p * (n[i] + n[j])


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK) -> Iterator[list[np.ndarray]]:
    """The columns of about ``rows`` rows at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield [np.asarray(c.combine_chunks()) for c in pa.Table.from_batches(held).columns]
            held = []
    if sum(x.num_rows for x in held):
        yield [np.asarray(c.combine_chunks()) for c in pa.Table.from_batches(held).columns]


def _first_pairs(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows (token, n, id, place), sorted. kind 0: ids a and b to be compared; kind 1: a row of a bucket that may have more pairs than those.

    A bucket that the chunk's or the task's end may have cut is one of these.
    """
    for token, n, ids, place in chunks(batches):
        start = np.concatenate([[True], token[1:] != token[:-1]])
        first = np.maximum.accumulate(np.where(start, np.arange(len(token)), 0))
        sizes = np.diff(np.append(np.flatnonzero(start), len(token)))
        large = np.repeat(sizes > NEXT + 1, sizes) | (token == token[0]) | (token == token[-1])
        row = np.arange(len(token))
        steps = [(row[k:][first[k:] == first[:-k]], k) for k in range(1, NEXT + 1) if k < len(row)]
        i = np.concatenate([row[:0], *(r for r, _ in steps), row[row > first + NEXT]])
        j = np.concatenate([row[:0], *(r - k for r, k in steps), first[row > first + NEXT]])
        ok = possible(n, place, i, j, similarity)
        pairs, rows = int(ok.sum()), int(large.sum())
        a, b = np.maximum(ids[i[ok]], ids[j[ok]]), np.minimum(ids[i[ok]], ids[j[ok]])
        zero = np.zeros(pairs, np.int64)
        cols = [np.repeat([0, 1], [pairs, rows]).astype(np.int32), np.concatenate([zero, token[large]]), np.concatenate([zero, n[large]]), np.concatenate([a, ids[large]]), np.concatenate([b, place[large]])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "token", "n", "a", "b"])


def _cells(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """The columns after the first of one cell at a time, of rows sorted by cell; about ``rows`` rows are read at once."""
    open_: list[list[np.ndarray]] = []
    for cols in chunks(batches, rows):
        cols = [np.concatenate(x) for x in zip(*open_, cols)]
        ends = (np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1).tolist()
        for at, end in zip([0, *ends], ends):
            yield [c[at:end] for c in cols[1:]]
        open_ = [[c[ends[-1] if ends else 0 :] for c in cols]]
    if open_:
        yield open_[0][1:]


def _near_in_cell(side, n, place, root, sketches, similarity: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row i of a cell the rows j before it that it must be compared to and that their sketches don't rule out, and in how many bits those differ.

    A cell has at most two blocks of rows, sorted by n. A block that meets
    itself has one side only. ``root`` is read again for each i, so that pairs
    whose components the caller joins meanwhile are left out.
    """
    p, q = similarity
    cut = int(np.searchsorted(side, 1))
    one = cut in (0, len(side))
    words, at = np.array([len(s) // 8 for s in sketches]), np.empty(len(sketches), np.int64)
    tables = {}
    for w in np.unique(words).tolist():
        rows = np.flatnonzero(words == w)
        at[rows] = np.arange(len(rows))
        tables[w] = np.frombuffer(b"".join(sketches[rows]), np.uint64).reshape(-1, w)
    for i in range(1 if one else 0, len(side) if one else cut):
        low, end = (0, i) if one else (cut, len(side))
        low += int(np.searchsorted(n[low:end], -(-p * n[i] // q)))
        end = low + int(np.searchsorted(n[low:end], q * n[i] // p, "right"))
        j = np.arange(low, end)
        j = j[(root[j] != root[i]) & possible(n, place, i, j, similarity)]
        gap = np.empty(len(j), np.int64)
        for w in np.unique(words[j]).tolist():
            of, c = words[j] == w, min(w, int(words[i]))
            mine = np.bitwise_xor.reduce(tables[int(words[i])][at[i]].reshape(-1, c), axis=0)
            theirs = np.bitwise_xor.reduce(tables[w][at[j[of]]].reshape(int(of.sum()), -1, c), axis=1)
            gap[of] = np.bitwise_count(theirs ^ mine).sum(1)
        ok = gap * (p + q) <= (n[i] + n[j]) * (q - p)
        if ok.any():
            yield i, j[ok], gap[ok]


def _batch(held: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=names)


def _cell_pairs(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, side, n, id, place, root, token, sketch), sorted by the first three: all pairs of a cell that can be similar and are of two components."""
    held, count = [], 0
    for side, n, ids, place, root, _, sketches in _cells(batches, 4 * BLOCK):
        for i, j, _ in _near_in_cell(side, n, place, root, sketches, similarity):
            held.append((np.maximum(ids[j], ids[i]), np.minimum(ids[j], ids[i])))
            count += len(j)
            if count >= PAIRS:
                yield _batch(held, ["a", "b"])
                held, count = [], 0
    if held:
        yield _batch(held, ["a", "b"])


NEAREST = "token long, n long, id long, place long, other long, gap long"


def _cell_nearest(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The rows of ``_cell_pairs`` that are in one of its pairs, each once in a cell, with the nearest that they are paired with."""
    for side, n, ids, place, root, token, sketches in _cells(batches, 4 * BLOCK):
        least, other = np.full(len(n), np.iinfo(np.int64).max), np.empty(len(n), np.int64)
        for i, j, gap in _near_in_cell(side, n, place, root, sketches, similarity):
            k = int(gap.argmin())
            if gap[k] < least[i]:
                least[i], other[i] = gap[k], ids[j[k]]
            closer = gap < least[j]
            least[j[closer]], other[j[closer]] = gap[closer], ids[i]
        of = least < np.iinfo(np.int64).max
        if of.any():
            yield _batch([tuple(c[of] for c in (token, n, ids, place, other, least))], ["token", "n", "id", "place", "other", "gap"])


def _cell_links(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, side, n, id, place, root, token, set), sorted by the first three: similar pairs, compared by the whole sets, that join what all similar pairs of a cell join.

    A pair joins two components that nothing in the cell has joined before, so
    a cell gives fewer pairs than it has rows.
    """
    p, q = similarity
    for side, n, ids, place, root, _, sets in _cells(batches, 1):
        root, sets = root.copy(), [s.view(np.uint64) for s in sets]
        sketches, held = np.empty(len(sets), object), []
        for k, s in enumerate(sets):
            sketches[k] = sketch(s)
        for i, j, _ in _near_in_cell(side, n, place, root, sketches, similarity):
            while len(j):
                now, j = j[:LINKED], j[LINKED:]
                both = np.concatenate([sets[k] for k in now.tolist()])
                hit = sets[i][np.minimum(np.searchsorted(sets[i], both), n[i] - 1)] == both
                shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(n[now]) - n[now])
                now = now[shared * (p + q) >= p * (n[i] + n[now])]
                roots, at = np.unique(root[now], return_index=True)
                if len(roots):
                    held.append((np.maximum(ids[now[at]], ids[i]), np.minimum(ids[now[at]], ids[i])))
                    root[np.isin(root, roots)] = root[i]
                    j = j[root[j] != root[i]]
        if held:
            yield _batch(held, ["a", "b"])


def cell_sketches(nodes: DataFrame) -> DataFrame:
    """id and sketch of the nodes, the sketch of at most CELL_BITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shorter_sketch(s.as_py()) for s in b.column(1)], pa.binary())], names=["id", "sketch"])

    return nodes.select("id", "sketch").mapInArrow(run, "id long, sketch binary")


def in_cells(large: DataFrame, scratch: Scratch, similarity: tuple[int, int], block: int, members: int | None = None) -> DataFrame:
    """The rows (token, n, id, place, root) as rows (cell, side, n, id, place, root, token): two rows of a token meet in a cell unless they are of one component or their sizes are too far apart.

    All rows are ranked by (token, root, n) and cut into blocks; two blocks of
    a token meet in a cell. So no task gets more of a bucket than two blocks.
    With ``members`` rows of sizes of as many bits are ranked together, and
    the sets of a block have at most so many members in all, if it has not one.
    """
    p, q = similarity
    kind, rows = F.lit(0), F.lit(block)
    if members:
        kind = F.length(F.bin("n"))
        rows = F.greatest(F.lit(1), F.least(F.lit(block), F.expr(f"{members} div shiftleft(1L, kind)")))
    kinds = scratch.save(large.withColumn("kind", kind), "large")
    ranked = ordered_rank(scratch, kinds, [F.col(c) for c in ("kind", "token", "root", "n", "id")], "ranked")
    ranked = ranked.withColumn("block", F.expr("shiftleft(bigint(kind), 48)") + F.floor(F.col("__rank") / rows))
    blocks = ranked.groupBy("token", "block").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    blocks = scratch.save(blocks.withColumn("one", F.col("r0") == F.col("r1")), "blocks")
    x, y = (blocks.select("token", *(F.col(c).alias(f"{c}_{k}") for c in ("block", "r0", "n0", "n1", "one"))) for k in "xy")
    apart = ~(F.col("one_x") & F.col("one_y") & (F.col("r0_x") == F.col("r0_y")))
    near = (q * F.col("n1_x") >= p * F.col("n0_y")) & (q * F.col("n1_y") >= p * F.col("n0_x"))
    cells = x.join(y, "token").where((F.col("block_x") <= F.col("block_y")) & apart & near)
    cell = F.xxhash64("token", "block_x", "block_y").alias("cell")
    sides = F.when(F.col("block_x") == F.col("block_y"), F.array(F.struct(F.lit(0).alias("side"), F.col("block_x").alias("block")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("block_x").alias("block")), F.struct(F.lit(1).alias("side"), F.col("block_y").alias("block")))
    )
    cells = scratch.save(cells.select("token", cell, F.explode(sides).alias("s")).select("token", "cell", "s.side", "s.block"), "cells")
    return ranked.join(cells, ["token", "block"]).select("cell", "side", "n", "id", "place", "root", "token")


def _by_cell(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("cell").sortWithinPartitions("cell", "side", "n", "id")


def _with_sketches(dealt: DataFrame, sketches: DataFrame | None) -> DataFrame:
    return dealt.join(sketches, "id").select(*dealt.columns, "sketch") if sketches is not None else dealt.withColumn("sketch", F.lit(bytes(8)))


def other_pairs(large: DataFrame, scratch: Scratch, similarity: tuple[int, int], block: int = BLOCK, sketches: DataFrame | None = None) -> DataFrame:
    """All pairs (a, b) of rows (token, n, id, place, root) with one token and two roots that can be similar, as far as ``sketches`` (id, sketch) tell.

    Their number grows with the square of a bucket. The stage takes
    ``nearest_others`` and ``other_links``, which give no row for each pair.
    """
    dealt = _with_sketches(in_cells(large, scratch, similarity, block), sketches)
    return _by_cell(dealt).mapInArrow(lambda it: _cell_pairs(it, similarity), "a long, b long").distinct()


def nearest_others(large: DataFrame, scratch: Scratch, similarity: tuple[int, int], block: int = BLOCK, sketches: DataFrame | None = None) -> DataFrame:
    """Of the rows (token, n, id, place, root) those in one of the ``other_pairs``, in each cell with the nearest ``other`` that it is paired with there, and the gap."""
    dealt = _with_sketches(in_cells(large, scratch, similarity, block), sketches)
    return _by_cell(dealt).mapInArrow(lambda it: _cell_nearest(it, similarity), NEAREST)


def other_links(large: DataFrame, scratch: Scratch, similarity: tuple[int, int], sets: DataFrame, block: int = BLOCK, members: int = MEMBERS) -> DataFrame:
    """Pairs (a, b) of rows (token, n, id, place, root) whose whole ``sets`` (id, s) are similar: they join all that the similar ones among the ``other_pairs`` join."""
    dealt = in_cells(large, scratch, similarity, block, members)
    dealt = dealt.join(sets, "id").select(*dealt.columns, "s")
    return _by_cell(dealt).mapInArrow(lambda it: _cell_links(it, similarity), "a long, b long")


def prune(pairs: DataFrame, nodes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """a, b and gap (in how many bits their sketches differ) of the pairs whose sizes and sketches allow the similarity."""
    p, q = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gap = np.array([sketches_apart(x.as_py(), y.as_py()) for x, y in zip(b.column(2), b.column(3))], np.int64)
            ok = pa.array(gap * (p + q) <= np.asarray(b.column(4)) * (q - p))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gap)], names=["a", "b", "gap"]).filter(ok)

    x, y = (nodes.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"k{k}")) for k in "ab")
    both = pairs.join(x, "a").join(y, "b").where((q * F.col("na") >= p * F.col("nb")) & (q * F.col("nb") >= p * F.col("na")))
    return both.select("a", "b", "ka", "kb", (F.col("na") + F.col("nb")).alias("n")).mapInArrow(run, "a long, b long, gap long")


def row_filter(keys: DataFrame) -> tuple[DataFrame, Column]:
    """One row ``bits`` of at most FILTER_BITS bits, and the condition on (f, r, bits) that holds for all rows (f, r) of ``keys`` and few others.

    It says which texts need not move; who may stay out is decided by a join.
    """
    spark = keys.sparkSession
    bits = min(FILTER_BITS, 1 << max(10, (16 * keys.count()).bit_length()))
    pos = F.pmod(F.xxhash64("f", "r"), F.lit(bits))
    words = keys.select(pos.alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(p % 64)))").alias("v")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(words.column(0).combine_chunks())] = np.asarray(words.column(1).combine_chunks())
    row = spark.createDataFrame(pa.table({"bits": pa.array([out], pa.list_(pa.int64()))}))
    place = f"pmod(xxhash64(f, r), {bits}L)"
    return F.broadcast(row), F.expr(f"(shiftright(bits[int({place} div 64)], int({place} % 64)) & 1L) = 1L")


def sets_of(wanted: DataFrame, nodes: DataFrame, keyed: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """id and s, the whole set, of the nodes in ``wanted`` (id, each once). No other text is made into a set."""
    places = scratch.save(nodes.join(wanted, "id", "left_semi").select("id", F.col("first.f").alias("f"), F.col("first.r").alias("r")), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some_texts(batches):
            sets = pa.array([shingles(t.as_py(), size).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), sets], names=["id", "s"])

    bits, named = row_filter(places)
    texts = keyed.select("f", "r", "text").join(bits, named).join(places.hint("shuffle_hash"), ["f", "r"]).select("id", "text")
    return scratch.save(texts.mapInArrow(run, "id long, s array<long>"), "sets")


def similar(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame, scratch: Scratch, size: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Only texts that are in a pair are made into sets."""
    p, q = similarity
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = sets_of(wanted, nodes, keyed, scratch, size)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    links = scratch.save(both.where(shared * (p + q) >= p * (F.size("sa") + F.size("sb"))).select("a", "b"), "similar")
    scratch.drop(sets)
    return links


def _scans_one_table(df: DataFrame) -> bool:
    """Whether every row of ``df`` is a row of files, once."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return "Relation" in node.nodeName()


def with_row_key(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc (all columns, as a struct), f and r: which row of which file it is. A DataFrame that isn't one of files is written first."""
    try:
        meta = docs.metadataColumn("_metadata")
        if _scans_one_table(docs):
            return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"), F.xxhash64(meta["file_path"]).alias("f"), meta["row_index"].alias("r"))
    except AnalysisException:
        pass
    return with_row_key(scratch.save(docs, "documents"), scratch)


def content(docs: DataFrame) -> Column:
    """A hash of the row's columns in ``doc`` but those with maps, which Spark can't hash."""
    return F.xxhash64(*(F.col(f"doc.`{f.name}`") for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))))


def keep_representatives(docs: DataFrame, scratch: Scratch, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows, with all their columns, that stand for their component: of each the one with the smallest doc_id (null last).

    Rows of one doc_id in one component are told apart by a hash of their
    columns, and where those are equal too any one of them is the same row. So
    repeated rows leave one, and the order of the rows doesn't matter. Texts
    without words, null among them, are one node. Columns may have any names;
    an empty table stays empty.
    """
    whole = with_row_key(docs, scratch)
    keyed = whole.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "f", "r", F.col("doc.text").alias("text"), content(docs).alias("h"))
    sc = docs.sparkSession.sparkContext
    order = sc.broadcast(common_shingles(keyed.select("f", "r", "text"), docs.count(), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some_texts(batches):
            sets = [shingles(t.as_py(), size) for t in b.column(4)]
            whole_hash = lambda make: pa.array(np.array([make(s) for s in sets], np.uint64).view(np.int64))
            prefix = pa.array([prefix_of(s, *order.value, similarity).view(np.int64) for s in sets], pa.list_(pa.int64()))
            new = [whole_hash(lambda s: xxhash.xxh64_intdigest(s.tobytes(), SEED)), whole_hash(majority), pa.array([len(s) for s in sets], pa.int64()), prefix, pa.array([sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *new], names=["doc_id", "f", "r", "h", "id", "fp", "n", "prefix", "sketch"])

    rows = keyed.select("doc_id", "f", "r", "h", "text").mapInArrow(run, "doc_id long, f long, r long, h long, id long, fp long, n long, prefix array<long>, sketch binary")
    rows = scratch.save(rows, "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), "h", "f", "r"))
    nodes = scratch.save(rows.groupBy("id").agg(first.alias("first"), *(F.first(c).alias(c) for c in ("fp", "n", "prefix", "sketch"))), "nodes")
    places = scratch.save(rows.select("f", "r"), "rows_at")
    scratch.drop(rows)

    # Candidates: bit-sliced fingerprints, then prefixes.
    fps = scratch.save(nodes.where("n > 0").groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("k")), "fingerprints")
    close = links_between(fps.select("fp"), scratch, direct=True)
    close = close.join(fps.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b")
    same = nodes.where("n > 0").select("fp", "id").join(fps.where("k > 1"), "fp").where("id <> low").select(F.col("id").alias("x"), F.col("low").alias("y"))
    close = close.select("x", "y").unionByName(same).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))

    exploded = nodes.select("n", "id", F.posexplode("prefix").alias("place", "token")).select("token", "n", "id", F.col("place").cast("long").alias("place"))
    dealt = exploded.repartitionByRange("token", "n", "id").sortWithinPartitions("token", "n", "id")
    found = scratch.save(dealt.mapInArrow(lambda it: _first_pairs(it, similarity), "kind int, token long, n long, a long, b long"), "first_pairs")
    tried = scratch.save(found.where("kind = 0").select("a", "b").unionByName(close).distinct(), "tried")
    pairs = scratch.save(prune(tried, nodes, similarity), "pairs")

    best = scratch.save(pairs.groupBy("a").agg(F.min_by("b", F.struct("gap", "b")).alias("b")), "best")
    links = similar(best, nodes, keyed, scratch, size, similarity)
    comps = scratch.save(components(links, scratch), "components")

    root = lambda k: comps.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    rest = pairs.select("a", "b").join(best, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left").where(apart).select("a", "b")
    large = found.where("kind = 1").select("token", "n", F.col("a").alias("id"), F.col("b").alias("place"))
    rooted = lambda rows: rows.join(root("id"), "id", "left").select("token", "n", "id", "place", F.coalesce("root_id", "id").alias("root"))
    nearest = scratch.save(nearest_others(rooted(large), scratch, similarity, sketches=cell_sketches(nodes)), "nearest")
    second = nearest.groupBy("id").agg(F.min_by("other", F.struct("gap", "other")).alias("other")).select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b"))
    others = scratch.save(rest.unionByName(second.distinct().join(tried, ["a", "b"], "left_anti")), "other_pairs")
    if not others.isEmpty():
        links = links.unionByName(similar(others, nodes, keyed, scratch, size, similarity))
        comps = scratch.save(components(links, scratch), "components")

    # Rows of large buckets that may still join two components: their whole sets are compared where they meet, and only links become rows.
    open_ = rooted(nearest.select("token", "n", "id", "place").distinct())
    several = open_.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("token")
    open_ = scratch.save(open_.join(several, "token", "left_semi"), "open")
    if not open_.isEmpty():
        sets = sets_of(open_.select("id").distinct(), nodes, keyed, scratch, size)
        links = links.unionByName(scratch.save(other_links(open_, scratch, similarity, sets), "other_links"))
        comps = scratch.save(components(links, scratch), "components")
        scratch.drop(sets)

    firsts = nodes.join(comps, nodes["id"] == comps["node"], "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first"))
    kept = scratch.save(firsts.select(F.col("first.f").alias("f"), F.col("first.r").alias("r")), "kept")
    gone = scratch.save(places.join(kept.hint("shuffle_hash"), ["f", "r"], "left_anti"), "gone")
    # Most rows are named by no bit of those that go, and stay where they are; only the others meet the table of what is kept.
    bits, named = row_filter(gone)
    sure = whole.join(bits, ~named).select("doc.*")
    return sure.unionByName(whole.join(bits, named).join(kept.hint("shuffle_hash"), ["f", "r"], "left_semi").select("doc.*"))
