"""Token ids in independent zstandard frames with a trailing seek table.

A file is: data frames, a skippable frame with the documents' index, and a
skippable frame with the seek table of the public "zstd seekable format"
(compressed size, plain size and XXH64 checksum of each frame, then a footer).
Any zstandard reader can decompress the whole file; ``SeekableFile`` reads the
two tables from the end and decompresses just the frames of the documents that
are asked for. A document lies in one frame.

Files are rows of a table (part, number, first_doc, last_doc, data): Spark's
own writer commits them, so a lost executor or a repeated task leaves no half
file, and any store that Spark writes to will do. Each file is a row group of
its own, so a reader that asks for some documents is handed only the files
whose numbers may hold them, and decompresses only their frames.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from somatlas.llm.tokens import id_dtype, tokenize
from somatlas.runtime import Scratch

# Fixed values of the zstd seekable format.
SEEK_FRAME, SEEK_FOOTER, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX_FRAME, INDEX_MAGIC = 0x184D2A50, b"DOCINDX1"

FRAME_IDS = 1 << 15  # a frame ends with the document that reaches this
FILE_IDS = 1 << 22
ROW_GROUP = 1 << 20  # bytes from which a row group ends, so each file has its own
PUSHED = 64  # documents that are asked for by a condition each, which the scan can use
INDEX = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u4")])


def write_file(docs: Iterable[tuple[int | None, bytes]], dtype: str, level: int = 3, frame_ids: int = FRAME_IDS) -> bytes:
    """A file of (doc_id, ids as bytes of ``dtype``) in the order given."""
    width, packer = int(dtype[-1]), zstandard.ZstdCompressor(level=level, write_checksum=True)
    out, table, index, frame, at = [], [], [], [], 0

    def close() -> None:
        nonlocal frame, at
        plain = b"".join(frame)
        packed = packer.compress(plain)
        out.append(packed)
        table.append(struct.pack("<III", len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        frame, at = [], 0

    for doc_id, ids in docs:
        index.append((doc_id is None, doc_id or 0, len(table), at, len(ids) // width))
        frame.append(ids)
        at += len(ids) // width
        if at >= frame_ids:
            close()
    if frame:
        close()
    body = INDEX_MAGIC + struct.pack("<B", width) + np.array(index, INDEX).tobytes()
    out.append(struct.pack("<II", INDEX_FRAME, len(body)) + body)
    seek = b"".join(table) + struct.pack("<IBI", len(table), CHECKSUMS, SEEK_FOOTER)
    out.append(struct.pack("<II", SEEK_FRAME, len(seek)) + seek)
    return b"".join(out)


class SeekableFile:
    """Random access to the documents of one file; every frame that is read is checked."""

    def __init__(self, data: bytes):
        self.data = data
        n, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEK_FOOTER or not flags & CHECKSUMS:
            raise ValueError("no seek table at the end")
        size = 12 * n + 9
        if struct.unpack("<II", data[-size - 8 : -size]) != (SEEK_FRAME, size):
            raise ValueError("the seek table's frame is damaged")
        self.table = np.frombuffer(data[-size:-9], "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        at = int(self.starts[-1])
        magic, length = struct.unpack_from("<II", data, at)
        body = data[at + 8 : at + 8 + length]
        if magic != INDEX_FRAME or body[:8] != INDEX_MAGIC:
            raise ValueError("the documents' index is damaged")
        self.dtype = f"<u{body[8]}"
        self.index = np.frombuffer(body[9:], INDEX)
        self._last: tuple[int, np.ndarray] = (-1, np.empty(0))
        self.bytes_read = 0  # compressed bytes of the frames that were opened

    def frame(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            plain = zstandard.ZstdDecompressor().decompress(self.data[self.starts[k] : self.starts[k + 1]], max_output_size=int(self.table[k, 1]))
            if len(plain) != self.table[k, 1] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} has another checksum")
            self._last = (k, np.frombuffer(plain, self.dtype))
            self.bytes_read += int(self.table[k, 0])
        return self._last[1]

    def __len__(self) -> int:
        return len(self.index)

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        x = self.index[i]
        return (None if x["null"] else int(x["doc_id"])), self.frame(int(x["frame"]))[int(x["at"]) : int(x["at"]) + int(x["n"])]

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document with this number; only their frames are decompressed."""
        return [self.document(int(i))[1] for i in np.flatnonzero((self.index["doc_id"] == doc_id) & (self.index["null"] == 0))]


FILES = "part int, number int, n_docs long, n_ids long, first_doc long, last_doc long, data binary"
_FILES = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("data", pa.binary())])
_READ = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def ascending(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, dealt and sorted by doc_id, nulls first.

    Rows of one doc_id are ordered by a hash of their texts. The range exchange
    splits ties by a row number, so a repeated doc_id is no task of its own.
    """
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sort = [F.col("doc_id").asc_nulls_first(), F.col("__h"), F.col("__uid")]
    dealt = slim.withColumns({"__h": F.xxhash64("text"), "__uid": F.monotonically_increasing_id()})
    return dealt.repartitionByRange(*sort).sortWithinPartitions(*sort).select("doc_id", "text")


def write_files(tokens: DataFrame, scratch: Scratch, dtype: str, file_ids: int = FILE_IDS) -> DataFrame:
    """The files of a table (doc_id, n_tokens, ids) that is dealt and sorted already; documents keep their order over (part, number)."""
    width = int(dtype[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, rows, n = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            keys = [r[0] for r in rows if r[0] is not None]
            values = [part, number, len(rows), n, min(keys, default=None), max(keys, default=None), write_file(rows, dtype)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _FILES)], schema=_FILES)

        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), b.column(1)):
                rows.append((key, ids.as_py()))
                n += len(rows[-1][1]) // width
                if n >= file_ids:
                    yield row()
                    number, rows, n = number + 1, [], 0
        if rows:
            yield row()

    # The size of a row group is looked at from the first row on, as files are large.
    return scratch.save(tokens.select("doc_id", "ids").mapInArrow(run, FILES), "files", **{"parquet.block.size": str(ROW_GROUP), "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1"})


def read_documents(files: DataFrame, doc_ids: Iterable[int]) -> DataFrame:
    """The documents with these numbers: doc_id, n_tokens, ids (four bytes each) and frame_bytes, the compressed bytes that were opened for its file's documents.

    The files are pruned by their first and last doc_id, by the scan where the
    list is short, and in each file only the frames of the documents asked for
    are decompressed. Numbers that no document has give no row.
    """
    wanted = np.unique(np.array([int(i) for i in doc_ids], np.int64))
    if not len(wanted):
        return files.sparkSession.createDataFrame([], "doc_id long, n_tokens long, ids binary, frame_bytes long")
    may = (F.col("first_doc") <= int(wanted[-1])) & (F.col("last_doc") >= int(wanted[0]))
    if len(wanted) <= PUSHED:
        may &= reduce(or_, ((F.col("first_doc") <= int(i)) & (F.col("last_doc") >= int(i)) for i in wanted))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("frame_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                f = SeekableFile(data.as_py())
                at = np.flatnonzero(np.isin(f.index["doc_id"], wanted) & (f.index["null"] == 0))
                docs = [f.document(int(i)) for i in at]
                if docs:
                    cols = [[k for k, _ in docs], [len(x) for _, x in docs], [x.astype("<u4").tobytes() for _, x in docs], [f.bytes_read] * len(docs)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(cols, schema)], schema=schema)

    return files.where(may).select("data").mapInArrow(run, "doc_id long, n_tokens long, ids binary, frame_bytes long")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, number, data in zip(*(b.column(i) for i in range(3))):
                f = SeekableFile(data.as_py())
                rows, at = [], 0
                for i in range(len(f)):
                    doc_id, ids = f.document(i)
                    rows.append((part.as_py(), number.as_py(), doc_id, at, len(ids), crc_of_ids(ids)))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows), _READ)], schema=_READ)

    line = Window.partitionBy(F.lit(0)).orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    bases = files.select("part", "number", F.coalesce(F.sum("n_ids").over(line), F.lit(0)).alias("base"))
    docs = files.select("part", "number", "data").mapInArrow(run, "part int, number int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(bases, ["part", "number"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_corpus(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Sort the texts by doc_id, tokenize them where they then are, write the files and return the table of files.

    Null text counts as empty and gives the end id alone. A null doc_id is
    kept; repeated rows stay. Texts move once and ids never do. An empty table
    gives no files.
    """
    return write_files(tokenize(ascending(docs), tokenizer, end_id), scratch, id_dtype(tokenizer))
