"""What the two trained operators share: who may be learned from, bounded samples, words and their n-grams."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LETTERS = re.compile(r"[^\W\d_]+")
EXCERPT = 1 << 16  # characters, about, of a longer example that are learned from: evenly spread pieces of it
PIECES = 16


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its number as text is 1 modulo 3."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def bounded_sample(rows: DataFrame, label: str, key: str, cap: int, max_labels: int | None = 64, total: int | None = None) -> DataFrame:
    """At most ``cap`` keys of each of the ``max_labels`` most frequent labels: the first by a hash of the key.

    ``rows`` is columns of keys and labels alone; repeated rows count once. A
    label's number of distinct keys, by a sketch, tells which share of the
    hash's range holds about four times ``cap`` of them; only those are made
    distinct and ranked, so a label with most of the rows costs no more than
    another.
    Without ``max_labels`` all labels are taken, and ``cap`` is lowered, to 1 at
    least, until all of them together have at most ``total`` rows.
    """
    counts = rows.groupBy(label).agg(F.approx_count_distinct(key).alias("count")).orderBy(F.desc("count"), label)
    counts = (counts if max_labels is None else counts.limit(max_labels)).collect()
    if total is not None:
        cap = level([r["count"] for r in counts], cap, total)
    at = F.xxhash64(F.col(key), F.lit("sample"))
    place = (F.shiftrightunsigned(at, 11)).cast("double") / float(1 << 53)
    shares = [(r[0], min(1.0, 4.0 * max(cap, 50) / r["count"])) for r in counts]
    share = F.lit(-1.0)
    if len(shares) > 64:  # a row a label, not an expression a label
        table = rows.sparkSession.createDataFrame(shares, rows.select(F.col(label).alias("__label")).schema.add("__share", "double"))
        rows = rows.join(F.broadcast(table), F.col(label) == F.col("__label")).where(place <= F.col("__share")).select(*rows.columns)
        shares, place = [], F.lit(-1.0)
    for value, x in shares:
        share = F.when(F.col(label) == value, x).otherwise(share)
    order = Window.partitionBy(label).orderBy(at, F.col(key))
    return rows.where(place <= share).distinct().withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= cap).drop("__n")


def level(counts: list[int], cap: int, total: int) -> int:
    """The largest number up to ``cap``, 1 at least, at which labels of these counts give at most ``total`` rows."""
    low, high = 1, max(1, cap)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(min(n, middle) for n in counts) <= total else (low, middle - 1)
    return low


def excerpt(text: Column) -> Column:
    """The text, or of one that is longer than EXCERPT evenly spread pieces that are about that long together."""
    step, size = F.expr(f"(char_length(text) - {EXCERPT // PIECES}) / {PIECES - 1}"), EXCERPT // PIECES
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substr(text, F.floor(step * i).cast("int") + 1, F.lit(size)))
    return F.when(F.char_length(text) <= EXCERPT, text).otherwise(F.array_join(pieces, " "))


def sampled_texts(docs: DataFrame, picked: DataFrame, label: str) -> DataFrame:
    """doc_id, label and text of the picked keys; of several texts of one key, the smallest. Long ones are excerpts, which bounds the sample's size.

    ``picked`` is a bounded sample, which is what is broadcast.
    """
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", label, excerpt(F.col("text")).alias("text"))
    return texts.groupBy("doc_id", label).agg(F.min("text").alias("text"))


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def grams(word: str, sizes: range) -> list[str]:
    """Character n-grams of the word between border marks."""
    w = f"<{word}>"
    return [w[i : i + n] for n in sizes for i in range(len(w) - n + 1)]


def document_frequencies(docs: DataFrame, vectors_of: Callable, n_terms: int) -> tuple[np.ndarray, int]:
    """In how many of all documents each term of a bounded vocabulary occurs, and the number of documents.

    ``docs`` is a column of texts; ``vectors_of``() makes, in each task, what
    turns a text into (term numbers, frequencies).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, df, n = vectors_of(), np.zeros(n_terms + 1, np.int64), 0
        for b in batches:
            for text in b.column(0):
                df[vectors(text.as_py())[0]] += 1
            n += b.num_rows
        df[n_terms] = n  # a length term, if there is one, counts for nothing
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], names=["term", "n"])

    out = np.zeros(n_terms + 1, np.int64)
    for r in docs.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out[:n_terms], int(out[n_terms])
