"""Benchmark decontamination by suffix arrays over the training text.

Each task cuts its documents into shards of about half a million words and builds a
suffix array of each: words become numbers of the benchmark's vocabulary, runs
of known words too short for any window are left out (they can't match), and
the rest is sorted by prefix doubling. Every suffix of the benchmark is then
binary-searched in the shard; the range it finds is all places where its
window stands. Documents never move, so no key or copy makes a task large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from somatlas.runtime import Scratch

WINDOW = 13
SHARD_WORDS = 1 << 19
MAX_BROADCAST = 4 << 20  # bytes of benchmark text for one pass over the documents
AT_ONCE = 1 << 16  # windows, or matches, that are looked at together
# Word bytes: digits, letters (made lower case) and whatever is not ASCII; all others are blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Benchmark:
    """Items as word numbers (from 1), and the distinct windows of their suffixes, as arrays.

    ``starts`` has the places where windows begin, ordered by window and then
    by what follows it; those of window g are starts[first[g] : first[g + 1]].
    Windows that stand in the same items are of one class.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.names = sorted({n for n, _ in items})
        name = {n: i for i, n in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        rows = [(name[n], np.array([number(w, len(self.vocabulary) + 1) for w in words_of(t)], np.int32)) for n, t in items]
        rows = [(n, ids) for n, ids in rows if len(ids)]
        zero = np.zeros(1, np.int32)
        text = np.concatenate([zero, *(x for _, ids in rows for x in (ids, zero)), np.zeros(window, np.int32)])
        lengths = np.array([len(ids) for _, ids in rows], np.int64)
        ends = np.cumsum(lengths + 1)
        item = np.zeros(len(text), np.int32)
        size = np.zeros(len(text), np.int8)  # of the window that begins at each place, 0 where there is none
        for (n, ids), end in zip(rows, ends):
            k = min(window, len(ids))
            item[end - len(ids) : end] = n
            size[end - len(ids) : end - k + 1] = k
        order = suffix_array(text, len(text))
        order = order[size[order] > 0]
        order = order[np.argsort(size[order], kind="stable")]
        same = size[order[1:]] == size[order[:-1]]
        for k in range(window):
            same &= (text[order[1:] + k] == text[order[:-1] + k]) | (size[order[1:]] <= k)
        self.text, self.item, self.depth, self.starts = text, item, window, order.astype(np.int32)
        self.first = np.append(np.flatnonzero(np.append(len(order) > 0, ~same)), len(order)) if len(order) else np.zeros(1, np.int64)
        begin = self.first[:-1]
        self.sizes = size[order[begin]].astype(np.int64)
        self.least = int(self.sizes.min()) if len(self.sizes) else 0
        before = text[order - 1]
        low, high = (f.reduceat(before, begin) if len(begin) else before for f in (np.minimum, np.maximum))
        self.before = np.where(low == high, low, -1)  # the word before the window wherever it stands, -1 if there are several
        self._classes(np.repeat(np.arange(len(begin)), np.diff(self.first)), item[order])

    def _classes(self, group: np.ndarray, item: np.ndarray) -> None:
        pairs = np.unique(group * max(1, len(self.names)) + item)
        group, item = pairs // max(1, len(self.names)), (pairs % max(1, len(self.names))).astype(np.int32)
        cut = np.append(np.flatnonzero(np.append(len(group) > 0, group[1:] != group[:-1])), len(group)) if len(group) else np.zeros(1, np.int64)
        found: dict[bytes, int] = {}
        self.cls = np.array([found.setdefault(item[a:b].tobytes(), len(found)) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], np.int64)
        self.class_items = [np.frombuffer(x, np.int32) for x in found]

    def windows(self) -> np.ndarray:
        """The windows' words, filled up with 0; made where they are searched."""
        at = self.starts[self.first[:-1]].astype(np.int64)[:, None] + np.arange(self.depth)
        return np.where(np.arange(self.depth) < self.sizes[:, None], self.text[at], 0)

    def items_of(self, classes: np.ndarray) -> list[str]:
        return [self.names[i] for i in np.unique(np.concatenate([self.class_items[c] for c in classes]))] if len(classes) else []


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``text``, ordered by at least their first ``depth`` numbers, by prefix doubling."""
    rank, width = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while width < depth:
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - width)] = rank[width:] + 1
        values, new = np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)
        rank, width = new, width * 2
        if len(values) == len(rank):
            break
    return np.argsort(rank, kind="stable")


def search(text: np.ndarray, order: np.ndarray, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the range [low, high) of ``order`` whose suffixes begin with it: two binary searches for many at once."""
    if len(windows) > AT_ONCE:
        parts = [search(text, order, windows[i : i + AT_ONCE], sizes[i : i + AT_ONCE]) for i in range(0, len(windows), AT_ONCE)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    depth = windows.shape[1]
    padded = np.concatenate([text, np.zeros(depth, text.dtype)])

    def bound(after_equal: bool) -> np.ndarray:
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(order), np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) // 2
            there = padded[order[mid][:, None] + np.arange(depth)]
            differs = (there != windows[open_]) & (np.arange(depth) < sizes[open_][:, None])
            at = differs.argmax(1)
            row = np.arange(len(open_))
            less = np.where(differs[row, at], there[row, at] < windows[open_][row, at], after_equal)
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)

    return bound(False), bound(True)


class Shard:
    """Documents as one text of word numbers, reduced to runs that can hold a window."""

    def __init__(self, docs: list[list[bytes]], bench: Benchmark):
        self.n_words = np.array([len(d) for d in docs], np.int64)
        get = bench.vocabulary.get
        ids = np.fromiter((i for d in docs for i in (*map(get, d, repeat(0)), 0)), np.int32, int(self.n_words.sum()) + len(docs))
        doc = np.repeat(np.arange(len(docs)), self.n_words + 1)
        known = np.concatenate([[0], (ids > 0).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(known))
        begin, end = edges[0::2], edges[1::2]
        long = end - begin >= max(1, bench.least)
        begin, end = begin[long], end[long]
        keep = np.zeros(len(ids) + 1, np.int8)
        np.add.at(keep, begin, 1)
        np.add.at(keep, end + 1, -1)  # the word after a run, unknown or a border, stays as one
        keep = np.cumsum(keep[:-1]) > 0
        self.at = np.flatnonzero(keep)
        self.text, self.doc = ids[keep], doc[keep]
        self.word = self.at - np.concatenate([[0], np.cumsum(self.n_words + 1)])[self.doc]
        order = suffix_array(self.text, bench.depth) if len(self.text) else np.empty(0, np.int64)
        order = order[self.text[order] > 0]
        low, high = search(self.text, order, bench.windows(), bench.sizes)
        n = high - low
        self.window = np.repeat(np.arange(len(n)), n)
        self.place = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]

    def hit(self, bench: Benchmark) -> np.ndarray:
        """Which words of the reduced text stand in an occurrence of a window."""
        line = np.zeros(len(self.text) + 1, np.int64)
        np.add.at(line, self.place, 1)
        np.add.at(line, self.place + bench.sizes[self.window], -1)
        return np.cumsum(line[:-1]) > 0

    def classes(self, bench: Benchmark) -> list[np.ndarray]:
        """For each document the classes of the windows it holds, distinct and sorted."""
        m = max(1, len(bench.class_items))
        pairs = np.unique(self.doc[self.place] * m + bench.cls[self.window])
        return np.split(pairs % m, np.cumsum(np.bincount(pairs // m, minlength=len(self.n_words)))[:-1]) if len(self.n_words) else []

    def longest(self, bench: Benchmark) -> np.ndarray:
        """For each document the words of its longest match; a match is a window that goes on as in one of its items.

        The places of a window are sorted by what follows, so those that go on
        like the document are a range that each further word narrows: a match
        costs one row, in however many items it stands. What only goes on from
        the word before it is no longer than the match that began there.
        """
        at = np.flatnonzero((bench.before[self.window] != self.text[self.place - 1]) | (self.text[self.place - 1] == 0) | (self.place == 0))
        p, g = self.place[at], self.window[at]
        low, high, size = bench.first[g].copy(), bench.first[g + 1].copy(), bench.sizes[g].copy()
        text, going = np.append(self.text, 0), np.arange(len(p))
        while len(going):
            x = text[np.minimum(p[going] + size[going], len(text) - 1)]
            going, x = going[x > 0], x[x > 0]
            a, b = (self._narrow(bench, low[going], high[going], size[going], x, after) for after in (False, True))
            on = a < b
            going = going[on]
            low[going], high[going] = a[on], b[on]
            size[going] += 1
        out = np.zeros(len(self.n_words), np.int64)
        np.maximum.at(out, self.doc[p], size)
        return out

    @staticmethod
    def _narrow(bench: Benchmark, low: np.ndarray, high: np.ndarray, depth: np.ndarray, x: np.ndarray, after: bool) -> np.ndarray:
        """The first of each range's places whose word at ``depth`` is x (beyond x if ``after``) or larger."""
        low, high = low.copy(), high.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            there = bench.text[bench.starts[mid] + depth[open_]]
            less = there <= x[open_] if after else there < x[open_]
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        return low

    def all_matches(self, bench: Benchmark) -> Iterator[np.ndarray]:
        """Rows (document, item, word in the document, words): every match with every item, as long as it goes on to both sides; some at a time."""
        count = bench.first[self.window + 1] - bench.first[self.window]
        cuts = np.searchsorted(np.cumsum(count), np.arange(AT_ONCE, int(count.sum()) + AT_ONCE, AT_ONCE)) + 1 if len(count) else []
        text = np.append(self.text, 0)
        for a, b in zip([0, *cuts[:-1]], cuts):
            n = count[a:b]
            p, g = np.repeat(self.place[a:b], n), np.repeat(self.window[a:b], n)
            q = bench.starts[np.repeat(bench.first[self.window[a:b]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64)
            new = (p == 0) | (text[p - 1] == 0) | (text[p - 1] != bench.text[q - 1])
            p, q, size = p[new], q[new], bench.sizes[g[new]]
            going = np.arange(len(p))
            while len(going):
                x = text[np.minimum(p[going] + size[going], len(text) - 1)]
                going = going[(x == bench.text[q[going] + size[going]]) & (x > 0)]
                size[going] += 1
            yield np.stack([self.doc[p], bench.item[q], self.word[p], size], 1)


REPORT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest_match", pa.int64())])
REPORT_DDL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long"


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def is_contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def shards(batches: Iterator[pa.RecordBatch], text_at: int, limit: int = SHARD_WORDS) -> Iterator[tuple[list[pa.RecordBatch], list[list[bytes]]]]:
    """Slices of the batches with their documents' words, about ``limit`` words at a time; a document is never split."""
    rows, words, n = [], [], 0
    for b in batches:
        start = 0
        for i, t in enumerate(b.column(text_at)):
            words.append(words_of(t.as_py()))
            n += len(words[-1])
            if n >= limit:
                rows.append(b.slice(start, i + 1 - start))
                yield rows, words
                rows, words, n, start = [], [], 0, i + 1
        if start < b.num_rows:
            rows.append(b.slice(start))
    if rows:
        yield rows, words


def load_benchmark(items: DataFrame, limit: int = MAX_BROADCAST) -> tuple[int, DataFrame]:
    """The distinct items in groups of about ``limit`` bytes at most (an item is never split); one group if they are small."""
    slim = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text")).where("octet_length(text) > 0").distinct()
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(-(-size // limit)) or 1
    return n, slim.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n)))


def _bench(rows: list[Row]) -> Benchmark:
    return Benchmark(sorted(((r["item"], r["text"]) for r in rows), key=lambda r: (r[0], r[1] or "")))


def report(docs: DataFrame, items: DataFrame, scratch: Scratch, limit: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and longest_match (words) of every row.

    ``items`` has item_id and text; rows of one item_id are one item, a null
    item_id has an empty name. The benchmark goes to the tasks whole if it has
    at most ``limit`` bytes; a larger one goes in parts, one pass over the
    documents for each, and a document's findings are then merged. A line of
    k items and m documents costs k + m rows. Null, empty
    and wordless texts have no words and are not contaminated, and such items
    no windows. Repeated rows are repeated; other columns are ignored.
    """
    n, parts = load_benchmark(items, limit)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    if n == 1:
        bench = docs.sparkSession.sparkContext.broadcast(_bench(parts.collect()))
        return slim.mapInArrow(lambda it: _report(it, bench.value), REPORT_DDL)
    slim = scratch.save(slim.withColumn("uid", F.monotonically_increasing_id()), "documents")
    found = None
    for part in range(n):
        bench = docs.sparkSession.sparkContext.broadcast(_bench(parts.where(F.col("part") == part).collect()))
        one = slim.mapInArrow(lambda it, bench=bench: _spans(it, bench.value), "uid long, doc_id long, n_words long, spans array<struct<a: long, b: long>>, key string, items array<string>, longest long")
        one = scratch.save(one, f"part{part}")
        found = one if found is None else found.unionByName(one)
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    merged = found.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), spans.alias("spans"), F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"), F.max("longest").alias("longest_match"))
    merged = scratch.save(merged, "merged")
    # Documents with the same items share the keys of their sets; each combination of sets is put together once.
    sets = found.where("items is not null").groupBy("key").agg(F.first("items").alias("items"))
    lists = merged.select("keys").distinct().select("keys", F.explode(F.split("keys", ",")).alias("key")).join(sets, "key").select("keys", F.explode("items").alias("item")).distinct()
    lists = lists.groupBy("keys").agg(F.array_sort(F.collect_list("item")).alias("items")).select("keys", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    n_hit = F.expr("aggregate(spans, named_struct('n', 0L, 'end', 0L), (s, x) -> named_struct('n', s.n + greatest(0L, x.b - greatest(x.a, s.end)), 'end', greatest(s.end, x.b)), s -> s.n)")
    merged = merged.withColumn("n_hit", n_hit).join(lists, "keys", "left")
    return merged.select("doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.lit(digest([]))).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), "longest_match")


def _report(batches: Iterator[pa.RecordBatch], bench: Benchmark) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, tuple[int, str]] = {b"": (0, digest([]))}  # of each set of classes that occurs
    for rows, words in shards(batches, 1):
        shard = Shard(words, bench)
        n_hit = np.bincount(shard.doc[shard.hit(bench)], minlength=len(words))
        found = []
        for c in shard.classes(bench):
            if c.tobytes() not in known:
                names = bench.items_of(c)
                known[c.tobytes()] = len(names), digest(names)
            found.append(known[c.tobytes()])
        keys = pa.chunked_array([r.column(0) for r in rows]).combine_chunks()
        cols = [keys, *(pa.array(x, pa.int64()) for x in (shard.n_words, n_hit, [n for n, _ in found])), pa.array([x for _, x in found]), pa.array(is_contaminated(n_hit, shard.n_words)), pa.array(shard.longest(bench))]
        yield pa.RecordBatch.from_arrays(cols, schema=REPORT)


def _spans(batches: Iterator[pa.RecordBatch], bench: Benchmark) -> Iterator[pa.RecordBatch]:
    """As ``_report`` for a part of the benchmark: spans of words that are hit, and a key of the items, which come along once a task."""
    known: dict[bytes, str | None] = {b"": None}
    for rows, words in shards(batches, 1):
        shard = Shard(words, bench)
        edge = np.diff(np.concatenate([[0], shard.hit(bench).astype(np.int8), [0]]))
        spans: list[list[dict]] = [[] for _ in words]
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            spans[shard.doc[a]].append({"a": int(shard.word[a]), "b": int(shard.word[a] + b - a)})
        items, names = [], []
        for c in shard.classes(bench):
            new = c.tobytes() not in known
            names.append(bench.items_of(c) if new else None)
            if new:
                known[c.tobytes()] = hashlib.sha256("\0".join(names[-1]).encode()).hexdigest()
            items.append(known[c.tobytes()])
        keys, uids = (pa.chunked_array([r.column(k) for r in rows]).combine_chunks() for k in (0, 2))
        cols = [uids, keys, pa.array(shard.n_words), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(items, pa.string()), pa.array(names, pa.list_(pa.string())), pa.array(shard.longest(bench))]
        yield pa.RecordBatch.from_arrays(cols, names=["uid", "doc_id", "n_words", "spans", "key", "items", "longest"])


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every verbatim match of a window, as long as it goes on: doc_id, item_id, doc_word (from 0) and n_words."""
    n, parts = load_benchmark(items)
    slim, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), None
    for part in range(n):
        bench = docs.sparkSession.sparkContext.broadcast(_bench(parts.where(F.col("part") == part).collect()))

        def run(batches: Iterator[pa.RecordBatch], bench=bench) -> Iterator[pa.RecordBatch]:
            for rows, words in shards(batches, 1):
                keys = pa.chunked_array([r.column(0) for r in rows]).combine_chunks()
                for found in Shard(words, bench.value).all_matches(bench.value):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(found[:, 0])), pa.array([bench.value.names[i] for i in found[:, 1]], pa.string()), pa.array(found[:, 2]), pa.array(found[:, 3])], names=["doc_id", "item_id", "doc_word", "n_words"])

        one = slim.mapInArrow(run, "doc_id long, item_id string, doc_word long, n_words long")
        out = one if out is None else out.unionByName(one)
    return out


def keep_uncontaminated(docs: DataFrame, items: DataFrame, scratch: Scratch, limit: int = MAX_BROADCAST) -> DataFrame:
    """The rows, with all their columns, whatever their names, that are not contaminated. Only words that are hit are counted here."""
    n, parts = load_benchmark(items, limit)
    if n > 1:
        keyed = scratch.save(docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("uid")), "keyed")
        bad = report(keyed.select(F.col("uid").alias("doc_id"), F.col("doc.text").alias("text")), items, scratch, limit).where("contaminated")
        return keyed.join(bad.select(F.col("doc_id").alias("uid")), "uid", "left_anti").select("doc.*")
    bench, at = docs.sparkSession.sparkContext.broadcast(_bench(parts.collect())), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words in shards(batches, at):
            shard = Shard(words, bench.value)
            good = ~is_contaminated(np.bincount(shard.doc[shard.hit(bench.value)], minlength=len(words)), shard.n_words)
            start = 0
            for r in rows:
                yield r.filter(pa.array(good[start : start + r.num_rows]))
                start += r.num_rows

    return docs.mapInArrow(run, docs.schema)
