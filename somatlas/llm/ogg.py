"""Documents as Ogg: 8-bit stereo samples, one logical stream for each channel.

A payload's even bytes are the left channel and its odd bytes the right one.
Each channel is a logical stream of its own: an identification packet on the
first page, then packets of ``PACKET`` samples, paged and interleaved with the
other stream's pages in time order. A page's granule position is the number of
the channel's samples up to the end of the last packet that ends on it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192
RATE = 8000
PACKET = 960
PACKETS_A_PAGE = 16
HEAD = struct.Struct("<4sBBqIIIB")
IDENT = struct.Struct("<8sBBIQ")
MAGIC = b"smpl8bit"
# Page checksums take bits from the top down, zlib's from the bottom up: the same polynomial over mirrored bytes.
MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, start and final value 0, most significant bit first."""
    raw = zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(MIRROR), "big")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, padded by spaces to a positive multiple of UNIT; and their count before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" "), len(raw)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]


def _lacing(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def write_ogg(payload: bytes) -> bytes:
    """The payload as an Ogg file; the serial numbers come from the payload, so equal payloads give equal files."""
    base, out = zlib.crc32(payload) & 0xFFFFFFFE, []
    channels = [payload[0::2], payload[1::2]]
    for k, x in enumerate(channels):
        ident = IDENT.pack(MAGIC, 1, k, RATE, len(x))
        out.append(_page(FIRST, 0, base + k, 0, _lacing(len(ident)), ident))
    step = PACKET * PACKETS_A_PAGE
    for number, at in enumerate(range(0, len(channels[0]), step), 1):
        for k, x in enumerate(channels):
            body = x[at : at + step]
            lacing = b"".join(_lacing(min(PACKET, len(body) - i)) for i in range(0, len(body), PACKET))
            out.append(_page(LAST if at + step >= len(x) else 0, at + len(body), base + k, number, lacing, body))
    return b"".join(out)


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule, serial, number, lacing, body) of each page; raises ValueError where the file or a checksum is wrong."""
    at = 0
    while at < len(data):
        if len(data) - at < HEAD.size:
            raise ValueError(f"a page header is cut off at byte {at}")
        magic, version, flags, granule, serial, number, checksum, n = HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        lacing = data[at + HEAD.size : at + HEAD.size + n]
        end = at + HEAD.size + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise ValueError(f"the page at byte {at} is cut off")
        page = data[at:end]
        if page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != checksum:
            raise ValueError(f"the page at byte {at} has another checksum")
        yield flags, granule, serial, number, lacing, page[HEAD.size + n :]
        at = end


def demultiplex(data: bytes) -> dict[int, dict]:
    """Logical streams by serial number: packets with (start, end) in granules, pages and the last granule position.

    Packets are put together from lacing values over page borders. A page's
    granule position is where its last whole packet ends; packets before it on
    the page are timed backwards from there by their own lengths.
    """
    streams: dict[int, dict] = {}
    for flags, granule, serial, number, lacing, body in pages(data):
        if flags & FIRST:
            if serial in streams:
                raise ValueError(f"stream {serial} begins twice")
            streams[serial] = {"packets": [], "times": [], "pages": 0, "granule": 0, "part": b"", "ended": False}
        if serial not in streams or streams[serial]["ended"]:
            raise ValueError(f"a page of stream {serial} is outside the stream")
        s = streams[serial]
        if number != s["pages"]:
            raise ValueError(f"stream {serial}: page {number} stands for page {s['pages']}")
        if bool(flags & CONTINUED) != bool(s["part"]):
            raise ValueError(f"stream {serial}: a packet is cut off before page {number}")
        done, at, start = [], 0, 0
        for v in lacing:
            at += v
            if v < 255:
                done.append(s["part"] + body[start:at])
                s["part"], start = b"", at
        s["part"] += body[start:]
        end, times = granule, []
        for p in reversed(done):
            begin = end - (0 if flags & FIRST else len(p))
            times.append((begin, end))
            end = begin
        s["packets"] += done
        s["times"] += times[::-1]
        s["pages"] += 1
        if done:
            s["granule"] = granule
        s["ended"] = bool(flags & LAST)
    for serial, s in streams.items():
        if s["part"] or not s["ended"]:
            raise ValueError(f"stream {serial} has no end")
    return streams


def read_ogg(data: bytes) -> tuple[bytes, str]:
    """The payload, from the stored bytes alone, and a line of features."""
    channels, packets, n_pages, last = {}, 0, 0, 0
    streams = demultiplex(data)
    for serial, s in streams.items():
        magic, version, channel, rate, n = IDENT.unpack(s["packets"][0])
        if (magic, version) != (MAGIC, 1):
            raise ValueError(f"stream {serial} is of another kind")
        at = 0
        for p, (begin, end) in zip(s["packets"][1:], s["times"][1:], strict=True):
            if begin != at or end - begin != len(p):
                raise ValueError(f"stream {serial}: a packet for {begin} stands at {at}")
            at = end
        if at != n:
            raise ValueError(f"stream {serial} has {at} of {n} samples")
        channels[channel] = b"".join(s["packets"][1:])
        packets, n_pages, last = packets + len(s["packets"]), n_pages + s["pages"], max(last, s["granule"])
    payload = bytearray(sum(map(len, channels.values())))
    for k in range(len(channels)):
        payload[k :: len(channels)] = channels[k]
    return bytes(payload), f"ogg;streams={len(streams)};pages={n_pages};packets={packets};granule={last};us={last * 1_000_000 // rate}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _encode(batches: Iterator[pa.RecordBatch], with_media: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in range(0, b.num_rows, 256):  # media are as large as texts: a few at a time
            rows, media = [], []
            piece = b.slice(part, 256)
            for key, text in zip(piece.column(0).to_pylist(), piece.column(1)):
                payload, n = payload_of(text.as_py())
                stored = write_ogg(payload)
                back, feature = read_ogg(stored)
                rows.append((key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
                media.append(stored if with_media else None)
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)]
            schema = ARROW
            if with_media:
                cols, schema = [*cols, pa.array(media, pa.binary())], ARROW.append(pa.field("media", pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, schema=schema)


def to_ogg(docs: DataFrame, with_media: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text as an Ogg file, with figures read back from the file: one row out for each row in, no shuffle.

    ``media`` is the file. Null text counts as empty, and an empty text is one
    unit of spaces; null keys stay null; repeated rows are repeated; other
    columns are ignored; an empty table gives no rows.
    """
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(lambda it: _encode(it, with_media), SCHEMA + ", media binary" * with_media)
