"""Rows that every operator must cope with, and brute-force versions of the operators."""

import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = "lorem ipsum dolor sit amet " * 30_000


def odd_documents(spark, clash=True):
    """Nulls in every column, empty, blank, very long and repeated texts, repeated rows, and extra columns with names that operators use."""
    rows = [
        (0, "The quick brown fox jumps over the lazy dog", "en", "a", 1),
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 1),
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 1),
        (1, "another text under the same number", None, None, None),
        (2, None, "en", "a", None),
        (3, "", None, "a", 0),
        (4, " \t\n ", "fr", "a", 3),
        (5, "été à l’école \U0001f600 İstanbul", "fr", "b", 9),
        (6, LONG, "la", "b", len(LONG)),
        (None, "a row without a number", None, None, 5),
        (None, None, None, None, None),
        (7, "12345 !!! ###", "xx", "c", 3),
        (-9, "x", "en", "c", 1),
        (8, "\x00\x01 <|endoftext|> </turn> ### a: b\\e", "en", "c", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        names = ("uid", "score", "shard", "fp", "ids", "n_tokens", "neuron_id", "part", "node", "root", "block", "rank", "before", "w", "r", "class")
        df = df.withColumns({n: F.lit("x") for n in names})
    return df, rows


def crc(b):
    return zlib.crc32(b)


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(LOWER).encode())
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups(fps, radius=2):
    """The smallest member of each fingerprint's component, by all pairs."""
    u = sorted(set(fps))
    parent = {x: x for x in u}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(u, np.uint64)
    for x in u:
        for y in a[np.bitwise_count(a ^ np.uint64(x)) <= radius]:
            p, q = find(x), find(int(y))
            parent[max(p, q)] = min(p, q)
    return {x: find(x) for x in u}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, window=13):
    """(n_words, n_hit, items) of each text; items is a list of (item, text)."""
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        size = min(window, len(w))
        for j in range(len(w) - size + 1) if w else ():
            windows[tuple(w[j : j + size])].add("" if item is None else str(item))
    out = []
    for text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if (x := tuple(w[j : j + size])) in windows:
                    hit.update(range(j, j + size))
                    found |= windows[x]
        out.append((len(w), len(hit), found))
    return out


def check_packing(rows, lengths, length=2048):
    """Pieces cover every document once, fill sequences from 0 without gaps, and only one sequence is not full."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] > 0
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, pieces in by_doc.items():
        ends = sorted(pieces)
        assert sum(n for _, n in ends) == sum(lengths[doc]), doc
        if len(lengths[doc]) == 1:
            at = 0
            for start, n in ends:
                assert start == at
                at += n
    assert set(by_doc) == set(lengths)
    short = 0
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
        short += at < length
    assert short <= 1
