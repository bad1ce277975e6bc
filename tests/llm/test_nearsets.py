"""Near duplicates by shingle sets against all pairs."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from somatlas.llm import nearsets
from somatlas.runtime import Scratch, table
from tests.conftest import DATA
from tests.llm.common import DOCS, odd_documents

WORDS = [f"w{i}" for i in range(3000)]


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    return not a and not b or 5 * len(a & b) >= 4 * len(a | b)


def kept_by_all_pairs(rows):
    """Numbers of the rows that stay: of each component the smallest doc_id."""
    sets, at = [shingle_set(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if alike(sets[i], sets[j]):
            p, q = find(i), find(j)
            at[max(p, q)] = min(p, q)
    best = {}
    for i, r in enumerate(rows):
        k = (r[0] is None, r[0] or 0)
        best[find(i)] = min(best.get(find(i), k), k)
    return sorted(best.values())


def keys(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect())


def planted():
    """Texts with copies at similarities around 0.8 to 0.97, a large group of near copies, and a line that all texts end with."""
    rng, out = random.Random(1), []

    def changed(words, at):
        return " ".join("new%d" % rng.randrange(10**9) if i in at else w for i, w in enumerate(words))

    for n in (30, 60, 120, 400):
        for changes in range(1, 14):
            words = rng.choices(WORDS, k=n)
            out += [" ".join(words), changed(words, {i * n // changes for i in range(changes)})]
    words = rng.choices(WORDS, k=90)
    out += [changed(words, {rng.randrange(90)}) for _ in range(60)]
    line = " all rights are with the people who made this page and nobody else"
    out = [t + line * (i % 3 > 0) for i, t in enumerate(out)]
    rng.shuffle(out)
    return [(i, t, "en", "x", len(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize("common", [nearsets.COMMON, 0])
def test_stage_finds_all_planted_pairs(spark, monkeypatch, common):
    monkeypatch.setattr(nearsets, "COMMON", common)
    rows = planted()
    docs = Scratch(spark, "test").save(spark.createDataFrame(rows, DOCS))
    got = keys(dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, DATA))
    assert got == kept_by_all_pairs(rows) and len(got) < len(rows) - 70


def test_stage_on_the_drivers_documents(spark):
    docs = table(spark, DATA, "documents")
    got = keys(dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, DATA))
    assert got == kept_by_all_pairs([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(300):
        whole = rng.integers(0, 2**64, rng.integers(1, 900), dtype=np.uint64)
        a, b = (np.unique(whole[rng.random(len(whole)) < share]) for share in rng.random(2))
        got, want = nearsets.sketches_apart(nearsets.sketch(a), nearsets.sketch(b)), len(np.setxor1d(a, b))
        assert got <= want and (got - want) % 2 == 0
        assert nearsets.sketches_apart(nearsets.sketch(a), nearsets.sketch(a)) == 0


@pytest.mark.parametrize("block", [4, nearsets.BLOCK])
def test_large_buckets_are_compared_whole(spark, monkeypatch, block):
    """Buckets beyond what is compared at once, cut by chunks and blocks."""
    monkeypatch.setattr(nearsets, "CHUNK", 16)
    monkeypatch.setattr(nearsets, "NEXT", 1)
    monkeypatch.setattr(nearsets, "SIMILARITY", (4, 5))
    scratch, rng = Scratch(spark, "test"), random.Random(3)
    rows = [(rng.choice([1, 1, 2, 3]), rng.randrange(20, 60), i, rng.randrange(0, 6), i // 5 if i % 3 else i) for i in range(150)]
    large = spark.createDataFrame(rows, "token long, n long, id long, place long, root long")
    got = {(r["a"], r["b"]) for r in nearsets.other_pairs(large, scratch, (4, 5), block).collect()}
    want = set()
    for x, y in combinations(rows, 2):
        if x[0] == y[0] and x[4] != y[4] and 9 * min(x[1] - x[3], y[1] - y[3]) >= 4 * (x[1] + y[1]) and 5 * min(x[1], y[1]) >= 4 * max(x[1], y[1]):
            want.add((max(x[2], y[2]), min(x[2], y[2])))
    assert got == want and len(want) > 100


@pytest.mark.parametrize("from_files", [True, False])
def test_odd_rows(spark, from_files):
    df, rows = odd_documents(spark)
    names = ("__file", "__row", "__uid", "_metadata", "doc", "f", "bits", "h")
    df = df.withColumns({n: F.concat(F.lit(n), F.coalesce("text", F.lit("")).substr(1, 3)) for n in names})
    scratch = Scratch(spark, "test")
    docs = scratch.save(df) if from_files else df
    got = nearsets.keep_representatives(docs, scratch)
    assert got.columns == docs.columns and keys(got) == kept_by_all_pairs(rows)
    assert Counter(map(tuple, got.collect())) <= Counter(map(tuple, df.collect()))
    assert nearsets.keep_representatives(docs.where("1 = 0"), scratch).count() == 0


def test_rows_of_one_number_do_not_depend_on_their_order(spark):
    rows = [(i % 3, f"{' '.join(map(str, range(40)))} x{i % 4}", "en", f"s{i}", i) for i in range(30)]
    got = set()
    for order in (rows, rows[::-1], rows[7:] + rows[:7]):
        scratch = Scratch(spark, "test")
        kept = nearsets.keep_representatives(scratch.save(spark.createDataFrame(order, DOCS).repartition(3)), scratch)
        got.add(tuple(sorted(map(tuple, kept.collect()))))
    assert len(got) == 1


@pytest.mark.parametrize("bits", [64, nearsets.CELL_BITS])
def test_sketches_in_cells_lose_no_similar_pair(spark, monkeypatch, bits):
    rng, sets = np.random.default_rng(5), []
    for n in (30, 70, 300):
        for _ in range(8):
            whole = rng.integers(0, 2**64, n, dtype=np.uint64)
            sets += [np.unique(whole), np.unique(np.append(whole[: n - n // 12], rng.integers(0, 2**64, n // 12, dtype=np.uint64)))]
    folded = [nearsets.shorter_sketch(nearsets.sketch(s), bits) for s in sets]
    assert max(map(len, folded)) <= max(8, bits // 8)
    large = spark.createDataFrame([(1, len(s), i, 0, i) for i, s in enumerate(sets)], "token long, n long, id long, place long, root long")
    sketches = spark.createDataFrame([(i, bytearray(s)) for i, s in enumerate(folded)], "id long, sketch binary")
    pairs = nearsets.other_pairs(large, Scratch(spark, "test"), (4, 5), 8, sketches)
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    similar = {(j, i) for i, j in combinations(range(len(sets)), 2) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    gaps = {(j, i): nearsets.sketches_apart(folded[i], folded[j]) for i, j in combinations(range(len(sets)), 2)}
    sizes = {(j, i): (len(sets[j]), len(sets[i])) for j, i in gaps}
    assert len(similar) >= 20 and similar <= got
    assert got == {k for k, g in gaps.items() if 9 * g <= sum(sizes[k]) and 5 * min(sizes[k]) >= 4 * max(sizes[k])}


def near_group(texts):
    """A group in whose large buckets a quarter of all pairs may be similar by their sketches and are not, and one link from each of some texts to another."""
    rng = random.Random(7)
    base, out = [rng.choice(WORDS) + str(i) for i in range(400)], []
    for k in range(texts):
        at = set(rng.sample(range(8, 392, 12), 4 + k % 2))  # two texts of 4 changes have 80 other shingles, of 4 and 5 changes 90: 88 are allowed
        out.append(" ".join("new%d" % rng.randrange(10**9) if i in at else w for i, w in enumerate(base)))
    out += [t + " tail%d" % k for k, t in enumerate(out[1:40:2])]
    return [(i, t, "en", "x", len(t)) for i, t in enumerate(out)]


def test_a_group_of_near_copies_makes_no_row_for_each_pair(spark, monkeypatch):
    made, save = {}, Scratch.save

    def counted(self, df, name="t", **options):
        out = save(self, df, name, **options)
        made[name] = made.get(name, 0) + (out.count() if name in ("other_pairs", "nearest", "other_links") else 0)
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    rows = near_group(240)
    docs = Scratch(spark, "test").save(spark.createDataFrame(rows, DOCS))
    got = keys(nearsets.keep_representatives(docs, Scratch(spark, "test")))
    assert got == kept_by_all_pairs(rows)
    assert made["other_pairs"] < 10 * len(rows)  # one for each pair would be more than 50 for each row


def in_pairs(links, n):
    """The smallest number that each number is joined to."""
    at = list(range(n))
    for a, b in links:
        p, q = at[a], at[b]
        at = [min(p, q) if x in (p, q) else x for x in at]
    return at


@pytest.mark.parametrize("block,members", [(2048, 1 << 20), (8, 1 << 20), (2048, 1000)])
def test_cells_join_what_all_pairs_join(spark, block, members):
    rng, sets = np.random.default_rng(11), []
    for n in (40, 90, 300):
        for _ in range(6):
            whole = rng.integers(0, 2**64, n, dtype=np.uint64)
            for share in (0, 30, 16, 14, 12, 9):  # the last ones are too far from some of the others
                gone = n // share if share else 0
                sets.append(np.unique(np.append(whole[: n - gone], rng.integers(0, 2**64, gone, dtype=np.uint64))))
    scratch, roots = Scratch(spark, "test"), [i - 1 if i % 12 == 1 else i for i in range(len(sets))]
    large = spark.createDataFrame([(i % 2 if t else 7, len(s), i, 0, roots[i]) for i, s in enumerate(sets) for t in (0, 1)], "token long, n long, id long, place long, root long")
    folded = [nearsets.shorter_sketch(nearsets.sketch(s), 128) for s in sets]
    sketches = spark.createDataFrame([(i, bytearray(s)) for i, s in enumerate(folded)], "id long, sketch binary")
    whole = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in enumerate(sets)], "id long, s array<long>")
    pairs = {(r["a"], r["b"]) for r in nearsets.other_pairs(large, scratch, (4, 5), block, sketches).collect()}
    near = nearsets.nearest_others(large, scratch, (4, 5), block, sketches).collect()
    assert {r["id"] for r in near} == {x for pair in pairs for x in pair}
    assert {(max(r["id"], r["other"]), min(r["id"], r["other"])) for r in near} <= pairs
    gap = lambda a, b: nearsets.sketches_apart(folded[a], folded[b])
    best = {x: min(gap(*pair) for pair in pairs if x in pair) for pair in pairs for x in pair}
    assert all(r["gap"] == gap(r["id"], r["other"]) for r in near) and best == {i: min(r["gap"] for r in near if r["id"] == i) for i in best}
    links = [(r["a"], r["b"]) for r in nearsets.other_links(large, scratch, (4, 5), whole, block, members).collect()]
    alike = {(a, b) for a, b in pairs if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    before = list(enumerate(roots))
    assert set(links) <= alike < pairs and len(alike) > 60
    assert in_pairs([*links, *before], len(sets)) == in_pairs([*alike, *before], len(sets))
    if block == 2048 and members > 1000:
        assert len(links) < 2 * len(sets)
