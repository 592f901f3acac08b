"""Media columns: Ogg.

``write_ogg`` lays packets of several logical streams out in pages; ``read_ogg`` verifies every page's checksum,
reassembles packets from lacing values (also over pages), separates the logical streams, and derives timestamps from
granule positions. ``media_column`` adds the stored form to a table; ``read_column`` reads it back.

The stored payload: 8-bit samples in packets of PACKET samples on one logical stream, which takes four lacing values each; a page holds
SEGMENTS values, so that a packet goes on on the next page. On another stream is a packet of captions for each page of samples,
interleaved with it.

Defined results: a null text is empty, and its payload is one frame of spaces; equal texts give equal bytes; bytes that
aren't Ogg, a wrong checksum, a lost page or an unfinished packet raise ``OggError`` in ``read_ogg``, and are an error
message with null outputs in ``read_column`` and ``digests``; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerline.llm.common import arrow_map

FRAME = 192
PACKET = 5 * FRAME
#: Lacing values of a page of samples; 255 are possible.
SEGMENTS = 17
RATE = 8000
SAMPLES, CAPTIONS = 1, 2
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
_IDENT = struct.Struct("<8sIHH")


class OggError(ValueError):
    """The bytes aren't a whole, valid Ogg file."""


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 04c11db7, not reflected, no inversion), by way of the reflected one of zlib."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    b = crc.to_bytes(4, "big").translate(_REVERSED)
    return int.from_bytes(b[::-1], "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return b"".join((head[:22], checksum(head + body).to_bytes(4, "little"), head[26:], body))


def _lacing(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


class _Writer:
    """Pages of one logical stream."""

    def __init__(self, serial: int):
        self.serial, self.number = serial, 0

    def page(self, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
        out = _page(flags, granule, self.serial, self.number, lacing, body)
        self.number += 1
        return out

    def packet(self, packet: bytes, granule: int, first: bool = False, last: bool = False) -> bytes:
        """A packet on pages of its own, continued over as many as it needs; a page on which none ends has granule -1."""
        lacing, out, at = _lacing(len(packet)), [], 0
        for i in range(0, len(lacing), 255):
            part, over = lacing[i : i + 255], i + 255 >= len(lacing)
            flags = (1 if i else 0) | (2 if first and not i else 0) | (4 if last and over else 0)
            out.append(self.page(flags, granule if over else -1, part, packet[at : at + sum(part)]))
            at += sum(part)
        return b"".join(out)


def write_ogg(payload: bytes, rate: int = RATE, packet: int = PACKET, segments: int = SEGMENTS) -> bytes:
    """The payload as 8-bit samples of one channel in packets of ``packet`` samples, ``segments`` lacing values a page, with a caption a page; lossless."""
    samples, captions = _Writer(SAMPLES), _Writer(CAPTIONS)
    out = [samples.packet(_IDENT.pack(b"samples8", rate, 1, packet), 0, first=True), captions.packet(_IDENT.pack(b"captions", rate, 1, packet), 0, first=True)]
    full, rest = divmod(len(payload), packet)
    lacing = _lacing(packet) * full + (_lacing(rest) if rest or not full else b"")
    at, begun, granule = 0, False, 0
    for i in range(0, len(lacing), segments):
        part, done = lacing[i : i + segments], i + segments >= len(lacing)
        stop = at + sum(part)
        ended = next((j for j in range(len(part), 0, -1) if part[j - 1] < 255), 0)  # after the last packet that ends here
        if ended:
            granule = at + sum(part[:ended])
        out.append(captions.packet(b"page %d" % (i // segments), at, last=done))
        out.append(samples.page((1 if begun else 0) | (4 if done else 0), granule if ended else -1, part, payload[at:stop]))
        at, begun = stop, part[-1] == 255
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream: packets, and the seconds at which each page's last packet ends."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    pending: list[bytes] = field(default_factory=list)

    def seconds(self, rate: int) -> list[float]:
        return [g / rate for g in self.granules]


def read_ogg(media: bytes) -> dict[int, Stream]:
    """The logical streams by serial number."""
    streams: dict[int, Stream] = {}
    at, n = 0, len(media)
    while at < n:
        if n - at < 27:
            raise OggError(f"a page is cut off at {at}")
        magic, version, flags, granule, serial, number, crc, count = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at {at}")
        lacing = media[at + 27 : at + 27 + count]
        start, stop = at + 27 + count, at + 27 + count + sum(lacing)
        if len(lacing) < count or stop > n:
            raise OggError(f"a page is cut off at {at}")
        if checksum(b"".join((media[at : at + 22], b"\0\0\0\0", media[at + 26 : stop]))) != crc:
            raise OggError(f"wrong checksum at {at}")
        stream = streams.get(serial)
        if (stream is None) != bool(flags & 2):
            raise OggError(f"a stream must begin with its first page, at {at}")
        if stream is None:
            stream = streams[serial] = Stream(serial)
        if stream.ended or number != stream.pages or bool(flags & 1) != bool(stream.pending):
            raise OggError(f"a page is missing before {at}")
        stream.pages += 1
        size = 0
        for value in lacing:
            size += value
            if value < 255:
                piece = media[start : start + size]
                if stream.pending:
                    piece = b"".join((*stream.pending, piece))
                    stream.pending.clear()
                stream.packets.append(piece)
                start, size = start + size, 0
        if size:
            stream.pending.append(media[start : start + size])
        if granule != -1:
            if stream.granules and granule < stream.granules[-1]:
                raise OggError(f"time runs backwards at {at}")
            stream.granules.append(granule)
        stream.ended = bool(flags & 4)
        at = stop
    for stream in streams.values():
        if stream.pending or not stream.ended:
            raise OggError(f"stream {stream.serial} isn't complete")
    return streams


def read_samples(media: bytes) -> tuple[bytes, int, dict[int, Stream]]:
    """The samples, their rate, and all streams of what ``write_ogg`` stored."""
    streams = read_ogg(media)
    for stream in streams.values():
        if stream.packets and stream.packets[0][:8] == b"samples8":
            _, rate, _, _ = _IDENT.unpack(stream.packets[0])
            return b"".join(stream.packets[1:]), rate, streams
    raise OggError("no stream of samples")


def feature(samples: bytes, rate: int, streams: dict[int, Stream]) -> str:
    """Duration by granules, pages and packets by stream, and level, crossings and peak of the samples."""
    x = np.frombuffer(samples, np.uint8)
    level = int(x.sum(dtype=np.int64)) // max(1, len(x))
    above = x > level
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    power = int((np.bincount(x, minlength=256) * (np.arange(256, dtype=np.int64) - level) ** 2).sum()) // max(1, len(x))
    own = next(s for s in streams.values() if s.packets[0][:8] == b"samples8")
    ms = own.granules[-1] * 1000 // rate
    parts = ";".join(f"{s.serial}:{s.pages}/{len(s.packets)}" for s in sorted(streams.values(), key=lambda s: s.serial))
    return f"ms={ms};streams={parts};level={level};power={power};crossings={crossings};peak={int(x.max(initial=0))}"


def padded(text: bytes, unit: int = FRAME) -> bytes:
    """The text with spaces up to a positive multiple of ``unit``."""
    return text + b" " * (max(unit, -(-len(text) // unit) * unit) - len(text))


def media_column(df: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """id, n_bytes (of the text) and media (the stored form of the padded text)."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(part: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_ogg(padded(t)) for t in texts], pa.binary())], ["id", "n_bytes", "media"])

    return arrow_map(df.select(f"`{id_column}`", f"`{column}`"), run, f"id {kind}, n_bytes long, media binary", column).withColumnRenamed("id", id_column)


def read_column(df: DataFrame, id_column: str = "doc_id", column: str = "media") -> DataFrame:
    """id, the samples read back, seconds (of the last granule), feature, error (null where all is well)."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(part: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        rows = [_read(m) for m in part.column(1).to_pylist()]
        cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.float64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["id", "samples", "seconds", "feature", "error"])

    return arrow_map(df.select(f"`{id_column}`", f"`{column}`"), run, f"id {kind}, samples binary, seconds double, feature string, error string", column).withColumnRenamed("id", id_column)


def _read(media: bytes | None) -> tuple[bytes | None, float | None, str | None, str | None]:
    if media is None:
        return None, None, None, None
    try:
        samples, rate, streams = read_samples(media)
    except (OggError, struct.error) as e:
        return None, None, None, str(e)
    own = next(s for s in streams.values() if s.packets[0][:8] == b"samples8")
    return samples, own.seconds(rate)[-1], feature(samples, rate, streams), None


def digests(df: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """Store, read back and describe each text in one pass over it, without sending the media through the JVM."""
    kind = df.schema[id_column].dataType.simpleString()
    names = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "seconds": pa.float64(), "lossless": pa.bool_(), "error": pa.string()}

    def run(part: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        rows = []
        for t in part.column(1).cast(pa.binary()).to_pylist():
            payload = padded(t or b"")
            media = write_ogg(payload)
            samples, seconds, said, error = _read(media)
            whole = (None, None, None) if error else (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]))
            rows.append((len(t or b""), *whole, len(media), hashlib.sha256(media).hexdigest(), said, seconds, samples == payload, error))
        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(names.values()))], ["id", *names])

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, lossless boolean, error string"
    return arrow_map(df.select(f"`{id_column}`", f"`{column}`"), run, schema, column).withColumnRenamed("id", id_column)


def iter_pages(media: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(serial, number, granule, bytes) of each page, without verifying."""
    at = 0
    while at < len(media):
        _, _, _, granule, serial, number, _, count = _HEAD.unpack_from(media, at)
        size = 27 + count + sum(media[at + 27 : at + 27 + count])
        yield serial, number, granule, size
        at += size
