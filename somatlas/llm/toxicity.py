"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and character n-grams of words; the vocabulary is the terms
that tell the two labels apart in a bounded sample of labelled rows (chi
square), and a length term that every text has, so that the cosine compares
rates of terms and not just which there are. Document frequencies are counted
over all documents. The examples lie in a block-max inverted index: for each term and block of examples the largest
impact, so a block whose bound cannot reach the k-th best similarity so far is
not opened; the neighbours are the exact ones. They vote with a weight that falls
with their distance, and a logistic curve fitted on leave-one-out votes turns the
vote into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somatlas.llm.learning import bounded_sample, document_frequencies, grams, held_out, sampled_texts, words_of

EXAMPLES = 1500  # of each label at most
TERMS = 1024
MIN_CHI2 = 24.0
NEIGHBOURS = 15
BLOCK = 64
FIRST_BLOCKS = 4
THRESHOLD = 0.7
LENGTH_WEIGHT, LENGTH_BASE = 0.1, 50  # the length term's frequency: this share of the words, and of so many more
NEAR = 0.02  # distance at which a vote counts half as much as at none
SIZES = range(4, 6)


def terms_of(word: str) -> list[str]:
    """The word and its n-grams, between border marks."""
    return list({f"<{word}>", *grams(word, SIZES)})


def choose_terms(texts: Iterable[str], labels: np.ndarray, limit: int = TERMS, least: float = MIN_CHI2) -> list[str]:
    """The terms of largest chi square between presence and label; ties in the order of the terms."""
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    if not n1 or not n0:
        return []
    in1, in0 = Counter(), Counter()
    for text, y in zip(texts, labels):
        (in1 if y else in0).update({t for w in set(words_of(text)) for t in terms_of(w)})
    n, scored = n1 + n0, []
    for t in {*in1, *in0}:
        a, b = in1[t], in0[t]
        if a + b >= 3 and a + b < n:
            chi2 = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / (n1 * n0 * (a + b) * (n - a - b))
            if chi2 >= least:
                scored.append((-chi2, t))
    return [t for _, t in sorted(scored)[:limit]]


class Vectors:
    """Texts to (term numbers, term frequencies) over a vocabulary; the length term comes after it."""

    def __init__(self, vocabulary: list[str]):
        self.vocabulary, self.automaton = vocabulary, ahocorasick.Automaton()
        for i, t in enumerate(vocabulary):
            self.automaton.add_word(t, i)
        if vocabulary:
            self.automaton.make_automaton()

    def __reduce__(self):
        return Vectors, (self.vocabulary,)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = words_of(text)
        found = Counter(i for _, i in self.automaton.iter(f"<{'><'.join(words)}>")) if self.vocabulary else {}
        at = sorted(found)
        return np.array([*at, len(self.vocabulary)]), np.array([*(float(found[t]) for t in at), LENGTH_WEIGHT * (len(words) + LENGTH_BASE)])


class NearestExamples:
    """Block-max inverted index over unit TF-IDF vectors of the examples.

    Postings (slot, impact) are sorted by term and block; ``begin`` tells where
    those of a term and block begin, ``largest`` their largest impact.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray):
        self.idf = idf
        rows = [self.unit(*v) for v in vectors]
        # Similar examples share blocks: they are ordered by their weightiest term.
        self.order = np.array(sorted(range(len(rows)), key=lambda i: (int(rows[i][0][rows[i][1].argmax()]) if len(rows[i][0]) else -1, i)), np.int64)
        self.blocks = -(-len(rows) // BLOCK)
        term = np.concatenate([np.empty(0, np.int64), *(rows[i][0] for i in self.order)])
        slot = np.repeat(np.arange(len(rows)), [len(rows[i][0]) for i in self.order])
        impact = np.concatenate([np.empty(0), *(rows[i][1] for i in self.order)])
        sort = np.lexsort((slot, term))
        term, self.slot, self.impact = term[sort], slot[sort], impact[sort]
        self.begin = np.searchsorted(term * self.blocks + self.slot // BLOCK, np.arange(len(idf) * self.blocks + 1))
        self.largest = np.zeros((len(idf), self.blocks))
        np.maximum.at(self.largest, (term, self.slot // BLOCK), self.impact)

    def unit(self, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = tf * self.idf[at]
        norm = math.sqrt(float(w @ w))
        return (at, w / norm) if norm else (at[:0], w[:0])

    def nearest(self, at: np.ndarray, tf: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, similarities) of the k nearest with a similarity above 0, example ``but`` left out; ties to the lower number."""
        at, w = self.unit(at, tf)
        bound = w @ self.largest[at]
        blocks = np.argsort(-bound, kind="stable")
        blocks = blocks[bound[blocks] > 0]
        ids, sims, kth = np.empty(0, np.int64), np.empty(0), 0.0
        # The most promising blocks give a k-th similarity; all blocks that can still reach it are then opened together.
        for opened in (blocks[:FIRST_BLOCKS], blocks[FIRST_BLOCKS:]):
            opened = opened[bound[opened] >= kth - 2e-9]
            if not len(opened):
                break
            cell = (at[:, None] * self.blocks + opened[None, :]).ravel()
            first, n = self.begin[cell], self.begin[cell + 1] - self.begin[cell]
            posting = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            s = np.bincount(self.slot[posting], np.repeat(np.repeat(w, len(opened)), n) * self.impact[posting], len(self.order))
            near = np.flatnonzero((s > 0) & (s >= kth - 2e-9))
            i = self.order[near]
            ids, sims = np.concatenate([ids, i[i != but]]), np.concatenate([sims, s[near][i != but]])
            best = np.lexsort((ids, -np.round(sims, 9)))[:k]
            ids, sims = ids[best], sims[best]
            kth = float(sims[-1]) if len(ids) == k else 0.0
        return ids, sims


class Scorer:
    """Vectors, index and calibration; ``score`` is the probability of label 1.

    Examples with one vector are one entry of the index. An entry fills as many
    of the k places as it has examples; the last one is cut to the places left
    and votes with its mean, so that no order of the examples decides which of
    many equally near ones vote.
    """

    def __init__(self, keys: list, texts: list[str], labels: np.ndarray, totals: dict[int, int], vectors: Vectors, idf: np.ndarray):
        self.vectors, self.plain = vectors, None
        n = Counter(labels.tolist())
        weight = np.array([totals.get(int(y), 0) / n[int(y)] for y in labels])  # the sample has labels in other shares than the table
        weight /= weight.sum() or 1.0
        found: dict[tuple, int] = {}
        rows, group = [], []
        for t in texts:
            at, tf = vectors(t)
            key = (at.tobytes(), np.round(tf / tf[-1], 9).tobytes())
            if key not in found:
                found[key] = len(rows)
                rows.append((at, tf))
            group.append(found[key])
        self.index = NearestExamples(rows, idf)
        self.count = np.bincount(group, minlength=len(rows)).astype(float)
        self.weight = np.bincount(group, weight, minlength=len(rows))
        self.toxic = np.bincount(group, weight * labels, minlength=len(rows))
        self.keys = [None] * len(rows)
        for g, key in reversed(list(zip(group, keys))):
            self.keys[g] = key
        votes = np.array([self.left_out(g, rows[g], w, w * y) for g, w, y in zip(group, weight, labels)])
        self.curve = calibrate(votes, labels.astype(float), weight)

    def vote(self, ids: np.ndarray, sims: np.ndarray) -> float:
        """The neighbours' mean label, weighted by their examples and nearness."""
        n = self.count[ids]
        near = np.clip(NEIGHBOURS - (np.cumsum(n) - n), 0, n) / n / (NEAR + np.maximum(0.0, 1.0 - sims))
        total = float(near @ self.weight[ids])
        return float(near @ self.toxic[ids]) / total if total > 0 else 0.0

    def left_out(self, g: int, row: tuple, weight: float, toxic: float) -> float:
        """The vote on an example by all others."""
        ids, sims = self.index.nearest(*row, but=g if self.count[g] == 1 else -1)
        kept = self.count[g], self.weight[g], self.toxic[g]
        self.count[g], self.weight[g], self.toxic[g] = kept[0] - 1, kept[1] - weight, kept[2] - toxic
        v = self.vote(ids, sims)
        self.count[g], self.weight[g], self.toxic[g] = kept
        return v

    def score(self, text: str | None) -> tuple[float, list[tuple]]:
        at, tf = self.vectors(text)
        if len(at) == 1:  # only the length term: one vector, whatever the length
            if self.plain is None:
                self.plain = self.judge(at, tf)
            return self.plain
        return self.judge(at, tf)

    def judge(self, at: np.ndarray, tf: np.ndarray) -> tuple[float, list[tuple]]:
        ids, sims = self.index.nearest(at, tf)
        a, b = self.curve
        p = 1 / (1 + math.exp(-max(-500.0, min(500.0, a * self.vote(ids, sims) + b))))
        return p, [(self.keys[i], round(float(x), 9), round(float(self.toxic[i] / self.weight[i]), 9)) for i, x in zip(ids[:5].tolist(), sims)]


def calibrate(votes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of the logistic curve 1 / (1 + exp(-(a v + b))), fitted by Newton steps that are halved until the weighted loss falls.

    The labels are drawn in a little (Platt, 1999), so separable votes have a
    finite curve too. a is at least 1, so a larger vote is never a lower score;
    where it would be less, b alone is fitted.
    """
    if not len(votes):
        return 1.0, 0.0
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = weight / weight.sum()

    def fit(x: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        beta = np.zeros(x.shape[1])

        def loss(b: np.ndarray) -> float:
            z = x @ b + fixed
            return float(w @ (np.logaddexp(0, z) - target * z))

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ beta + fixed, -500, 500)))
            grad = x.T @ (w * (p - target))
            step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(len(beta)), grad)
            size = 1.0
            while size > 1e-6 and loss(beta - size * step) > loss(beta):
                size /= 2
            beta = beta - size * step
            if size * np.abs(step).max() < 1e-9 or size <= 1e-6:
                break
        return beta

    one = np.ones((len(votes), 1))
    a, b = fit(np.hstack([votes[:, None], one]), np.zeros(len(votes)))
    return (float(a), float(b)) if a >= 1 else (1.0, float(fit(one, votes)[0]))


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Scorer | None:
    """Learn from the labelled documents that are not held out; None if there are none.

    ``labels`` has doc_id and toxic (0 or 1; others are left out). The
    examples are a bounded sample; totals and document frequencies are not.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rows = sampled_texts(docs, bounded_sample(known, "toxic", "doc_id", examples), "toxic").collect()  # at most 2 x examples
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"]))
    if not rows:
        return None
    y = np.array([r["toxic"] for r in rows], np.int64)
    vocabulary = choose_terms((r["text"] for r in rows), y)
    df, n = document_frequencies(docs.select("text"), lambda: Vectors(vocabulary), len(vocabulary))
    idf = np.append(np.log((1 + n) / (1 + df)) + 1, 1.0)
    return Scorer([r["doc_id"] for r in rows], [r["text"] for r in rows], y, totals, Vectors(vocabulary), idf)


EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.float64())]))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.7 on) and evidence of every row.

    Evidence is the nearest examples with their similarity and mean label (an
    example stands for all that have its vector).

    Null, empty and wordless texts are scored as texts without any term of
    the vocabulary, by the examples that have none either; without labels
    every score is 0. Equal texts have equal scores. Repeated rows are
    repeated; a null doc_id is not held out.
    """
    scorer = train(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded by EXAMPLES x TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            out = [m.score(t.as_py()) if m else (0.0, []) for t in b.column(2)]
            p = [x for x, _ in out]
            evidence = pa.array([[dict(zip(("doc_id", "similarity", "label"), e)) for e in es] for _, es in out], EVIDENCE)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array([int(x >= THRESHOLD) for x in p], pa.int32()), evidence], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id: long, similarity: double, label: double>>")


def keep_harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with all their columns, that are not predicted to be toxic."""
    scorer = train(docs, labels)
    if scorer is None:
        return docs
    model, at = docs.sparkSession.sparkContext.broadcast(scorer), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.value.score(t.as_py())[0] < THRESHOLD for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
