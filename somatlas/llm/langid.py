"""Language by sparse multinomial logistic regression on TF-IDF of character n-grams.

The n-grams are taken within words, border marks included; the vocabulary is
the most frequent ones of a bounded sample of labelled texts, some of them kept
for each language, and their document frequencies are counted over all documents. Every language that has
labelled texts is learned; the more there are, the fewer texts of each. The weights are learned
with the follow-the-regularised-leader rule (FTRL-proximal) under an
elastic-net penalty, which leaves most of them at zero; a temperature fitted
on a fifth of the sample then turns scores into probabilities.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from heapq import nsmallest
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somatlas.llm.learning import bounded_sample, document_frequencies, held_out, sampled_texts, words_of

EXAMPLES = 1200  # of each language at most
ALL_EXAMPLES = 64 * EXAMPLES  # of all languages; with more languages each has fewer
TERMS = 8192
DENSE = 1 << 24  # places at most of a table that n-grams are looked up in directly
SIZES = range(1, 4)
BORDER = "_"
CHUNK = 1 << 20  # characters that are looked at together
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.002, 3
UNDETERMINED = "und"
MIN_SCORE = 0.4


class Vectors:
    """Texts to (term numbers, counts). Terms are n-grams of letters, lower case, with "_" for what stands before and after a word.

    Letters become small numbers and n-grams numbers of base ``base``, so a
    text's n-grams are found by a few array operations over all of it: in a
    table of all numbers while that is small, else among the terms' sorted ones.
    """

    def __init__(self, vocabulary: list[str]):
        self.vocabulary, self.n = vocabulary, len(vocabulary)
        letters = sorted({c for t in vocabulary for c in t if c != BORDER})
        self.base = len(letters) + 2  # 0 a border, 1 a letter that no term has
        place = {c: i + 2 for i, c in enumerate(letters)} | {BORDER: 0}
        self.letter, self.high = letter_table(), {}
        for c in letters:
            if ord(c) < len(self.letter):
                self.letter[ord(c)] = place[c]
            else:
                self.high[ord(c)] = place[c]
        codes: list[dict[int, int]] = [{} for _ in SIZES]
        for i, t in enumerate(vocabulary):
            code = 0
            for c in t:
                code = code * self.base + place[c]
            codes[len(t) - 1][code] = i
        self.find = [lookup(c, self.base**k) for k, c in zip(SIZES, codes)]

    def __reduce__(self):
        return Vectors, (self.vocabulary,)

    def letters(self, text: str) -> np.ndarray:
        """Letter numbers, borders around."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.zeros(len(points) + 2, np.int64 if self.base ** max(SIZES) >= 1 << 31 else np.int32)
        if len(points) and points.max() >= len(self.letter):
            high = points >= len(self.letter)
            out[1:-1][high] = [self.high.get(p) or chr(p).isalpha() for p in points[high].tolist()]
            points = np.where(high, 32, points)
            out[1:-1] += self.letter[points]
        else:
            out[1:-1] = self.letter[points]
        return out

    def counts(self, text: str) -> tuple[bool, np.ndarray, np.ndarray]:
        """Whether there is a letter, term numbers and counts."""
        total, any_letter = np.zeros(self.n, np.int64), False
        for at in range(0, max(1, len(text)), CHUNK):
            # a chunk brings the two characters before it along, for the n-grams over its edge
            x = self.letters(text[max(0, at - 2) : at + CHUNK])
            new = min(2, at)
            x = x[(1 if at else 0) : (len(x) - 1 if at + CHUNK < len(text) else len(x))]
            any_letter |= bool(x.any())
            found = []
            for k, find in zip(SIZES, self.find):
                code = x[: len(x) - k + 1]
                for j in range(1, k):
                    code = code * self.base + x[j : len(x) - k + 1 + j]
                found.append(find(code[max(0, new - k + 1) :]))
            ids = np.concatenate(found)
            total += np.bincount(ids[ids >= 0], minlength=self.n)
        at = np.flatnonzero(total)
        return any_letter, at, total[at]

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self.counts(text or "")[1:]


def lookup(terms: dict[int, int], size: int) -> Callable[[np.ndarray], np.ndarray]:
    """From arrays of n-gram numbers below ``size`` to those of their terms, -1 where there is none."""
    if size <= DENSE:
        table = np.full(size, -1, np.int16)
        table[list(terms)] = list(terms.values())
        return table.__getitem__
    codes = np.array([*sorted(terms), size], np.int64)
    found = np.array([*(terms[c] for c in sorted(terms)), -1], np.int16)

    def search(x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(codes, x)
        return np.where(codes[at] == x, found[at], np.int16(-1))

    return search


_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """1 for the letters of the basic plane, 0 for all else."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(1 << 16)], np.int32))
    return _letters[0].copy()


def terms_in(text: str) -> set[str]:
    """The terms of a text: n-grams of letters with at least one letter, borders only at their ends."""
    return {g for w in set(words_of(text)) if w.isalpha() for k in SIZES for g in windows(f"{BORDER}{w}{BORDER}", k) if g != BORDER}


def windows(w: str, k: int) -> list[str]:
    return [w[i : i + k] for i in range(len(w) - k + 1)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_terms: int, n_classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (n_terms, n_classes) after passes over the rows in their order; each coordinate has a rate of its own."""
    z, n = np.zeros((n_terms, n_classes)), np.zeros((n_terms, n_classes))

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for (at, x), k in zip(rows, y):
            w = weights(at)
            p = softmax(x @ w)
            p[k] -= 1
            g = x[:, None] * p[None, :]
            n_at = n[at]
            z[at] += g - (np.sqrt(n_at + g * g) - np.sqrt(n_at)) / ALPHA * w
            n[at] = n_at + g * g
    return weights(slice(None))


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The t of least loss of softmax(scores / t), by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        return -float(np.log(softmax(scores / math.exp(log_t))[np.arange(len(y)), y] + 1e-12).mean())

    a, b, ratio = -3.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


class Model:
    def __init__(self, vectors: Vectors, idf: np.ndarray, texts: list[str], labels: list[str]):
        self.vectors, self.idf, self.languages = vectors, idf, sorted(set(labels))
        y = np.array([self.languages.index(x) for x in labels])
        rows = [self.row(*vectors(t)) for t in texts]
        check = np.arange(len(rows)) % 5 == 4
        fit = [i for i in range(len(rows)) if not check[i]] or list(range(len(rows)))
        self.weights = ftrl([rows[i] for i in fit], y[fit], len(idf) + 1, len(self.languages))
        held = [i for i in range(len(rows)) if check[i]]
        self.t = temperature(np.array([x @ self.weights[at] for at, x in (rows[i] for i in held)]).reshape(len(held), -1), y[held])

    def row(self, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vector and a constant."""
        x = np.log1p(tf) * self.idf[at]
        norm = math.sqrt(float(x @ x)) or 1.0
        return np.append(at, len(self.idf)), np.append(x / norm, 0.1)

    def predict(self, text: str | None) -> tuple[str, float]:
        letters, at, tf = self.vectors.counts(text or "")
        if not letters:
            return UNDETERMINED, 0.0
        at, x = self.row(at, tf)
        p = softmax(x @ self.weights[at] / self.t)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def train(docs: DataFrame, examples: int = EXAMPLES) -> Model | None:
    """Learn from text and non-null lang of the documents that are not held out; None if there are none."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang")
    rows = sampled_texts(docs, bounded_sample(known, "lang", "doc_id", examples, None, ALL_EXAMPLES), "lang").collect()  # at most ALL_EXAMPLES, or one a language
    rows.sort(key=lambda r: (hash_order(r["doc_id"]), r["lang"]))
    if not rows:
        return None
    vocabulary = choose_terms((r["lang"], r["text"]) for r in sorted(rows, key=lambda r: r["lang"]))
    found, n = document_frequencies(docs.select("text"), lambda: Vectors(vocabulary), len(vocabulary))
    return Model(Vectors(vocabulary), np.log((1 + n) / (1 + found)) + 1, [r["text"] for r in rows], [r["lang"] for r in rows])


def choose_terms(examples: Iterable[tuple[str, str]], limit: int = TERMS) -> list[str]:
    """The terms of most of the examples, which are sorted by language: half of the places are for the languages' own most frequent ones.

    So a script that one rare language has keeps its letters, and what it has in common with no other.
    """
    df: Counter = Counter()
    own: list[list[str]] = []
    for _, texts in groupby(examples, lambda x: x[0]):
        here: Counter = Counter()
        for _, t in texts:
            here.update(terms_in(t))
        own.append([t for t, _ in nsmallest(limit // 2, here.items(), lambda x: (-x[1], x[0]))])
        df.update(here)
    share = max(1, limit // 2 // max(1, len(own)))
    chosen = {t for terms in own for t in terms[:share]}
    ranked = [t for t, _ in sorted(df.items(), key=lambda x: (-x[1], x[0]))]
    for t in ranked:
        if len(chosen) >= limit:
            break
        chosen.add(t)
    return [t for t in ranked if t in chosen]


def hash_order(key: int) -> int:
    """A fixed shuffle of the examples, so that no order of the documents is learned."""
    return (key * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64)


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    Null texts and texts without a letter are ``und`` with score 0; without
    any labelled row all are. Equal texts get equal predictions; repeated rows
    are repeated; a null doc_id is not held out.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs))  # TERMS numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            out = [m.predict(t.as_py()) if m else (UNDETERMINED, 0.0) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return slim.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """The rows, with all their columns, whose language is determined with at least this score."""
    model, at = docs.sparkSession.sparkContext.broadcast(train(docs)), docs.columns.index("text")

    def keep(text: str | None) -> bool:
        lang, score = model.value.predict(text) if model.value else (UNDETERMINED, 0.0)
        return lang != UNDETERMINED and score >= least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([keep(t.as_py()) for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
