"""SimHash near duplicates: every pair of fingerprints at 2 or fewer differing bits, as components.

Two fingerprints that differ in at most two bits agree on two of four 16-bit
bands, so they meet in one of six buckets keyed by two bands. Within a bucket
the other bits are compared bit-sliced: the bucket's bit planes stand upright,
64 fingerprints to a word, carry-save counters add up the planes' differences
for all lanes at once, and the work on a block of lanes stops when all of them
are beyond the radius. A bucket gives a link from each fingerprint to the
smallest of its component within the bucket, never all pairs. Buckets above
``split`` are dealt out again by two of four bands of the other 32 bits, where
no bucket can exceed 65,536 fingerprints; that keeps the search exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somatlas.runtime import Scratch

SEED = 42
RADIUS = 2
SPLIT = 8192
SMALL = 24  # buckets up to this size are compared pair by lane, many buckets at once
FEW = 8192  # links that are joined in one process; a job for each step would cost more than the steps
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
FULL = 0xFFFFFFFFFFFFFFFF


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """64-bit hashes of the word shingles in their order; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 of none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)].astype(">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 where there are no words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", shingle: int = 3) -> DataFrame:
    """The columns in ``keep`` and fp (the fingerprint as a signed long), one row for each row in, no shuffle."""
    kept = docs.select(*keep)
    slim = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(b.num_columns - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=[*b.schema.names[:-1], "fp"])

    return slim.mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def band_masks(bits: Sequence[int], bands: int = 4, agree: int = 2) -> list[int]:
    """Masks of every choice of ``agree`` of ``bands`` equal bands of the bit numbers given."""
    size = len(bits) // bands
    parts = [sum(1 << b for b in bits[i * size : (i + 1) * size]) for i in range(bands)]
    return [sum(c) for c in combinations(parts, agree)]


MASKS = band_masks(range(64))


def sub_masks(mask: int) -> list[int]:
    """For a bucket that ``mask`` keys: finer masks, by bands of the bits outside it."""
    return [mask | m for m in band_masks([b for b in range(64) if not mask >> b & 1])]


def planes_of(values: np.ndarray, bits: Sequence[int]) -> np.ndarray:
    """Vertical bit planes: planes[k, w] holds bit bits[k] of 64 values."""
    words = -(-len(values) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(values)] = values
    return np.stack([np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64) for b in bits])


def within_radius(differences: Iterator[np.ndarray], words: int, radius: int = RADIUS, every: int = 8) -> np.ndarray:
    """Lanes (bits of the words) with at most ``radius`` (0 to 3) set bits over the planes of differences.

    Two carry-save counter planes and one for what is beyond them; every few
    planes the lanes are looked at, and if none is left the rest is skipped.
    """
    ones, twos, beyond = (np.zeros(words, np.uint64) for _ in range(3))
    for k, d in enumerate(differences, 1):
        carry = ones & d
        ones ^= d
        over = twos & carry
        twos ^= carry
        beyond |= over
        if radius < 3:
            beyond |= (ones & twos) if radius == 2 else twos if radius == 1 else twos | ones
        if k % every == 0 and (beyond == np.uint64(FULL)).all():
            break
    return ~beyond


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    """Numbers below n of the set bits."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


def bucket_links(values: np.ndarray, bits: Sequence[int], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For sorted distinct values that agree outside ``bits``: the smallest value of each one's component, and a value near it through which it was reached."""
    n, planes = len(values), planes_of(values, bits)
    words = planes.shape[1]
    zero, full = np.uint64(0), np.uint64(FULL)
    open_ = np.zeros(words * 64, np.uint8)
    open_[:n] = 1
    open_ = np.packbits(open_, bitorder="little").view(np.uint64)
    root, through = np.empty(n, np.int64), np.arange(n)
    for first in range(n):
        if not int(open_[first >> 6]) >> (first & 63) & 1:
            continue
        queue = [first]
        open_[first >> 6] &= np.uint64(FULL ^ (1 << (first & 63)))
        while queue:
            i = queue.pop()
            root[i] = first
            at = np.flatnonzero(open_)  # only blocks with lanes that are still open
            if not len(at):
                continue
            near = within_radius((p[at] ^ (full if int(values[i]) >> b & 1 else zero) for p, b in zip(planes, bits)), len(at), radius) & open_[at]
            if near.any():
                open_[at] &= ~near
                hit = lanes(near, len(at) * 64)
                hit = at[hit >> 6] * 64 + (hit & 63)
                through[hit] = i
                queue += hit.tolist()
    return values[root], values[through]


def bucket_roots(values: np.ndarray, bits: Sequence[int], radius: int = RADIUS) -> np.ndarray:
    return bucket_links(values, bits, radius)[0]


def small_links(values: np.ndarray, run: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller) in many small buckets; ``run`` numbers the bucket of each value, values ascend in it.

    Lanes are pairs: the step k compares each value to the k-th after it in its
    bucket. A value is linked to the smallest value near it and to the nearest
    one before it on its list, which joins all that the pairs join.
    """
    big, small = [], []
    for k in range(1, SMALL):
        i = np.flatnonzero(run[k:] == run[:-k]) if k < len(run) else np.empty(0, np.int64)
        if not len(i):
            break
        difference = values[i] ^ values[i + k]
        planes = planes_of(difference, range(64))
        near = lanes(within_radius(iter(planes), planes.shape[1], radius), len(i))
        big.append(values[i[near] + k])
        small.append(values[i[near]])
    if not big:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(big), np.concatenate(small)


LINKS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _links(batches: Iterator[pa.RecordBatch], masks: Sequence[int], split: int, direct: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (t, key, fp), t an index in ``masks``. kind 0: fp a and another one b of its component, near it if ``direct``; kind 1: fp a of a bucket of mask b that is too large."""

    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=LINKS)

    def done(t: np.ndarray, fp: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.append(starts, len(fp)))
        few = (sizes > 1) & (sizes <= SMALL)
        if few.any():
            a, b = small_links(fp[np.repeat(few, sizes)], np.repeat(np.arange(len(sizes)), sizes)[np.repeat(few, sizes)])
            if len(a):
                yield out(0, a, b)
        for r in np.flatnonzero(sizes > SMALL):
            v = fp[starts[r] : starts[r] + sizes[r]]
            mask = masks[int(t[starts[r]])]
            if split and sizes[r] > split:
                yield out(1, v, np.full(len(v), mask, np.uint64))
                continue
            other = bucket_links(v, [b for b in range(64) if not mask >> b & 1])[direct]
            if (other != v).any():
                yield out(0, v[other != v], other[other != v])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    passing = None  # the bucket that is being handed on
    for b in batches:
        t, key, fp = (np.asarray(b.column(i)) for i in range(3))
        fp = fp.view(np.uint64)
        if passing is not None:
            n = int(((t == passing[0]) & (key == passing[1])).argmin()) if not ((t == passing[0]) & (key == passing[1])).all() else len(t)
            if n:
                yield out(1, fp[:n], np.full(n, masks[passing[0]], np.uint64))
            if n == len(t):
                continue
            t, key, fp, passing = t[n:], key[n:], fp[n:], None
        held.append((t, key, fp))
        t, key, fp = (np.concatenate(x) for x in zip(*held))
        starts = np.concatenate([[0], np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1])
        last = int(starts[-1])
        if len(starts) > 1:
            yield from done(t[:last], fp[:last], starts[:-1])
        held = [(t[last:], key[last:], fp[last:])]
        if split and len(fp) - last > split:
            passing = (int(t[last]), int(key[last]))
            yield out(1, fp[last:], np.full(len(fp) - last, masks[passing[0]], np.uint64))
            held = []
    if held and len(held[0][2]):
        t, key, fp = held[0]
        yield from done(t, fp, np.array([0]))


def _search(distinct: DataFrame, masks: Sequence[int], split: int, direct: bool) -> DataFrame:
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks))))
    rows = distinct.select("fp", cells.alias("c")).select("c.t", "c.key", "fp")
    # As unsigned numbers the values of a bucket must ascend: the sign bit is flipped for the order.
    rows = rows.repartition("t", "key").sortWithinPartitions("t", "key", F.col("fp").bitwiseXOR(F.lit(_signed(1 << 63))))
    return rows.mapInArrow(lambda it: _links(it, masks, split, direct), "kind int, a long, b long")


def links_between(distinct: DataFrame, scratch: Scratch, split: int = SPLIT, direct: bool = False) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints (column fp) at 2 or fewer differing bits, directly or in steps.

    With ``direct`` a and b themselves differ in 2 or fewer bits; otherwise b
    may be the smallest of a component.
    """
    found = scratch.save(_search(distinct, MASKS, split, direct), "links")
    links = found.where("kind = 0").select("a", "b")
    large = [r["b"] for r in found.where("kind = 1").select("b").distinct().collect()]  # at most as many as there are masks
    for m in large:
        again = _search(found.where((F.col("kind") == 1) & (F.col("b") == m)).select(F.col("a").alias("fp")).distinct(), sub_masks(m & FULL), 0, direct)
        links = links.unionByName(again.select("a", "b"))
    return scratch.save(links.distinct(), "distinct_links")


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links, sorted, and of each the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        i, j = root(i), root(j)
        up[max(i, j)] = min(i, j)
    return nodes, nodes[[root(i) for i in range(len(nodes))]] if len(nodes) else nodes


def components(links: DataFrame, scratch: Scratch, few: int = FEW) -> DataFrame:
    """(node, root) of every node that has a link, root being the smallest of its component. ``links`` is a table: it is counted first.

    Up to ``few`` links are joined on the driver. More of them take alternating
    large-star and small-star steps (Kiveris et al., 2014) until
    the set of links stays the same. All sets stay tables. A node with very
    many links is pre-aggregated for its minimum; the minima are a table of
    their own, so that the join that follows can be split at such a node.
    """
    edges, seen = links.where("a <> b"), None
    if links.count() <= few:
        found = edges.select("a", "b").toArrow()
        nodes, roots = joined(*(c.to_numpy() for c in found.columns))
        return links.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(roots, pa.int64())}))

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = e.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        low = scratch.save(low, "minima")
        joined = e.join(low, "a")
        if large:
            new = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            new = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return new.where("a <> b").distinct()

    while True:
        after = scratch.save(star(star(edges, True), False), "edges")
        mark = after.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first()
        edges, same, seen = after, mark == seen, mark
        if same:
            break
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links can reach) of every row.

    Null and wordless texts have fingerprint 0 and are linked like any other;
    equal fingerprints are one node, so copies cost no pairs; a null doc_id is
    no smallest one unless all of the component are null. Repeated rows stay;
    other columns are ignored; an empty table gives no rows.
    """
    fps = scratch.save(fingerprints(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))), "fingerprints")
    distinct = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    comps = scratch.save(components(links_between(distinct.select("fp"), scratch), scratch), "components")
    linked = comps.join(distinct, comps["node"] == distinct["fp"]).select("node", "root", "low")
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = linked.join(lows, "root").select(F.col("node").alias("fp"), "component_id")
    ids = distinct.join(ids, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    ids = scratch.save(ids, "ids")  # read from a table, so that the join below can be split at a fingerprint with many copies
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")
