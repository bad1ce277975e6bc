"""Languages of many scripts, and many languages."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from somatlas.llm import langid, learning
from tests.llm.common import DOCS

SCRIPTS = {"ru": 0x430, "el": 0x3B1, "hy": 0x561, "ka": 0x10D0, "he": 0x5D0, "hi": 0x915, "th": 0xE01, "am": 0x1200, "zh": 0x4E00, "ko": 0xAC00, "got": 0x10330}


def words(rng, letters, n=40):
    return " ".join("".join(rng.choices(letters, k=rng.randrange(2, 7))) for _ in range(n))


def test_rare_scripts_keep_their_letters(spark):
    rng, rows = random.Random(3), []
    wide = [chr(c) for c in range(0xC0, 0x180) if chr(c).isalpha()]  # letters that most texts share and that rank first
    for _ in range(600):
        rows.append((len(rows), words(rng, wide, 120), "la", "x", 1))
    for lang, first in SCRIPTS.items():
        letters = [chr(c) for c in range(first, first + 20) if chr(c).isalpha()]
        rows += [(len(rows) + i, words(rng, letters), lang, "x", 1) for i in range(45)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {r["doc_id"]: r for r in langid.predict_documents(docs).collect()}
    for lang in SCRIPTS:
        mine = [got[r[0]] for r in rows if r[2] == lang]
        assert sum(r["lang_pred"] == lang and r["score"] >= langid.MIN_SCORE for r in mine) > 0.9 * len(mine), lang
    assert langid.keep_identified(docs).count() > 0.95 * len(rows)


@pytest.mark.parametrize("dense", [langid.DENSE, 0])
def test_lookups_agree(monkeypatch, dense):
    monkeypatch.setattr(langid, "DENSE", dense)
    v = langid.Vectors(["a", "_a", "ab", "ab_", "é", "\U00010330", "_\U00010330\U00010331"])
    letters, at, n = v.counts("Ab ab é1 \U00010330\U00010331 x")
    assert letters and dict(zip(at.tolist(), n.tolist())) == {0: 2, 1: 2, 2: 2, 3: 2, 4: 1, 5: 1, 6: 1}


def test_more_than_64_languages_are_all_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "ALL_EXAMPLES", 900)
    rng, rows = random.Random(4), []
    letters = [chr(c) for c in range(0x61, 0x7B)]
    for k in range(80):
        mine = rng.sample(letters, 7)
        rows += [(len(rows) + i, words(rng, mine), f"l{k:02d}", "x", 1) for i in range(30 - k // 8)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    picked = learning.bounded_sample(docs.select("doc_id", "lang"), "lang", "doc_id", 1200, None, 900).groupBy("lang").count().collect()
    assert len(picked) == 80 and {r["count"] for r in picked} == {11}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict_documents(docs).collect()}
    right = [got[r[0]] == r[2] for r in rows]
    assert set(got.values()) == {r[2] for r in rows} and sum(right) > 0.8 * len(right)


def test_two_languages_beyond_the_basic_plane(spark):
    rng, rows = random.Random(5), []
    for lang, first in (("got", 0x10330), ("phn", 0x10900)):
        letters = [chr(c) for c in range(first, first + 20) if chr(c).isalpha()]
        rows += [(len(rows) + i, words(rng, letters), lang, "x", 1) for i in range(60)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(got[r[0]] == r[2] for r in rows) > 0.95 * len(rows)


def test_long_texts_are_learned_from_in_all_their_parts(spark):
    rng = random.Random(6)
    low, high = [chr(c) for c in range(0x61, 0x6E)], [chr(c) for c in range(0x6E, 0x7B)]
    filler = words(rng, [chr(c) for c in range(0x3B1, 0x3C9)], 4000)
    rows = [(i, f"{filler} " * 4 + words(rng, (low, high)[i % 2], 4000), ("a", "b")[i % 2], "x", 1) for i in range(24)]
    assert min(len(r[1]) for r in rows) > learning.EXCERPT
    rows += [(100 + i, words(rng, (low, high)[i % 2]), None, "x", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    picked = docs.where("lang is not null").select("doc_id", "lang")
    assert {len(r["text"]) for r in learning.sampled_texts(docs, picked, "lang").collect()} == {learning.EXCERPT + learning.PIECES - 1}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict_documents(docs).collect()}
    assert sum(got[100 + i] == "ab"[i % 2] for i in range(40)) >= 38


def test_repeated_rows_do_not_shrink_the_sample(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    for times in (1, 60):
        many = rows.join(spark.range(times).select(F.lit(1)))
        assert {r["count"] for r in learning.bounded_sample(many, "toxic", "doc_id", 50).groupBy("toxic").count().collect()} == {50}


def plain_counts(text, vocabulary):
    """Terms of a text by a loop over words and lengths."""
    found = Counter()
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        w = f"_{w}_"
        found.update(w[i : i + k] for k in (1, 2, 3) for i in range(len(w) - k + 1))
    return {vocabulary.index(t): n for t, n in found.items() if t in vocabulary}


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_counts_against_a_plain_loop(monkeypatch, chunk):
    monkeypatch.setattr(langid, "CHUNK", chunk)
    rng = random.Random(7)
    letters = "abcdeé ßж\U00010330 ..,1_\n"
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 90))) for _ in range(300)]
    terms = sorted({t for x in texts for t in langid.terms_in(x)})
    v = langid.Vectors(rng.sample(terms, len(terms) // 2))
    for t in texts:
        letters_, at, n = v.counts(t)
        assert dict(zip(at.tolist(), n.tolist())) == plain_counts(t, v.vocabulary) and letters_ == any(c.isalpha() for c in t)


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(8)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4)) for _ in range(60)]
    y = rng.integers(0, 3, 60)
    z, n, w = ([[0.0] * 3 for _ in range(12)] for _ in range(3))

    def weight(i, c):
        if abs(z[i][c]) <= langid.L1:
            return 0.0
        return -(z[i][c] - math.copysign(langid.L1, z[i][c])) / ((langid.BETA + math.sqrt(n[i][c])) / langid.ALPHA + langid.L2)

    for _ in range(langid.EPOCHS):
        for (at, x), k in zip(rows, y.tolist()):
            w = {i: [weight(i, c) for c in range(3)] for i in at.tolist()}
            scores = [sum(w[i][c] * v for i, v in zip(at.tolist(), x.tolist())) for c in range(3)]
            e = [math.exp(s - max(scores)) for s in scores]
            for i, v in zip(at.tolist(), x.tolist()):
                for c in range(3):
                    g = (e[c] / sum(e) - (c == k)) * v
                    sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / langid.ALPHA
                    z[i][c] += g - sigma * w[i][c]
                    n[i][c] += g * g
    got = langid.ftrl(rows, y, 12, 3)
    assert np.allclose(got, [[weight(i, c) for c in range(3)] for i in range(12)], atol=1e-12) and (got == 0).any()


def test_document_frequencies_against_a_plain_loop(spark):
    rng = random.Random(9)
    texts = [words(rng, "abc", rng.randrange(0, 5)) for _ in range(80)] + [None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    terms = ["a", "ab", "_a", "bca", "c_"]
    got, n = learning.document_frequencies(docs, lambda: langid.Vectors(terms), len(terms))
    assert n == len(texts) and got.tolist() == [sum(i in plain_counts(t or "", terms) for t in texts) for i in range(len(terms))]


def test_level():
    assert learning.level([5, 100], 50, 1000) == 50
    assert learning.level([5, 100, 100], 50, 45) == 20
    assert learning.level([5] * 10, 50, 3) == 1
