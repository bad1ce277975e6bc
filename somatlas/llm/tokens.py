"""Texts to token ids by a tokenizers file, with the words' ids kept between texts.

The library encodes a word in one go whatever stands around it, and nearly all
of its time goes into finding words and tracking offsets that nobody reads. So
for texts of plain characters the words are found here and each distinct word
is encoded by the library once; all other texts go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

MAX_WORDS = 400_000

# Characters for which lower case, NFC and word borders need no Unicode tables: ASCII and the Latin letters up to U+017F.
PLAIN = re.compile("[\t\n\r\\x20-\\x7EÀ-ÖØ-öø-įı-ſ]*\\Z")
# The pre-tokenizer's own pattern for those characters (a fixed value of the tokenizer file).
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ſ]+|[0-9]|[^\\s a-z0-9À-ſ]+")
FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The letters that byte-level models write bytes as: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class Encoder:
    """ids(text): little-endian ids as bytes of ``dtype``, without the end id."""

    def __init__(self, path: str):
        import json

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": FILE_PATTERN}
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.letters = byte_letters()
        self.words = _Words(self)

    def ids(self, text: str) -> bytes:
        if self.by_word and PLAIN.match(text) and not any(s in text for s in self.special):
            out = b"".join(map(self.words.__getitem__, WORDS.findall(text.lower())))
            if len(self.words) > MAX_WORDS:
                self.words.clear()
            return out
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


class _Words(dict):
    def __init__(self, encoder: Encoder):
        self.model, self.letters, self.dtype = encoder.tokenizer.model, encoder.letters, encoder.dtype

    def __missing__(self, word: str) -> bytes:
        spelled = word.encode().decode("latin-1").translate(self.letters)
        out = self[word] = np.array([t.id for t in self.model.tokenize(spelled)], self.dtype).tobytes()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenize(docs, path: str, end_id: int | None = 1, key: str = "doc_id", text: str = "text"):
    """key, n_tokens (with the end id) and ids (little-endian, two bytes each if the vocabulary allows) of every row.

    One pass without a shuffle. Null text counts as empty; null keys stay null;
    repeated rows are repeated; other columns are ignored. ``path`` must be
    readable by the executors, as the tokenizer files of an image are.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        enc = encoder(path)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        width = int(enc.dtype[-1])
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = [enc.ids(t.as_py() or "") + end for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_dtype(path: str) -> str:
    return encoder(path).dtype
