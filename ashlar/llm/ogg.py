"""Ogg as a media column: write, verify, reassemble, demultiplex, and time.

Reading goes page by page: the capture pattern, the page checksum (polynomial 0x04c11db7, most significant bit first),
the lacing values, from which packets are put together across page boundaries, the serial number, which separates
logical streams, and the granule position, which dates the packets that end on a page. A page whose checksum fails
is skipped and reading goes on at the next capture pattern; a packet with a missing part is dropped and counted.

Each medium is handled on its own inside Arrow tasks, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema

_HEAD = struct.Struct("<4sBBqIIIB")
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
#: Fixed values of the sample format written here: magic, channels, rate in Hz, sample bits.
PCM_HEAD = struct.Struct("<8sBIB")
PCM_MAGIC, RATE = b"PCM8bit\0", 8000
INDEX_MAGIC = b"INDEXPKT"
PACKET = 8192


def page_crc(page: bytes) -> int:
    """The Ogg checksum of a page whose checksum field is zero.

    It is the mirror image of the common CRC-32, so each byte and then the result are mirrored around zlib's.
    """
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


class StreamWriter:
    """Cuts one logical stream's packets into pages."""

    def __init__(self, serial: int) -> None:
        self.serial, self.sequence = serial, 0

    def _page(self, lacing: bytes, body: bytes, granule: int, flags: int) -> bytes:
        head = _HEAD.pack(b"OggS", 0, flags, granule, self.serial, self.sequence, 0, len(lacing))
        self.sequence += 1
        page = head + lacing + body
        return page[:22] + page_crc(page).to_bytes(4, "little") + page[26:]

    def pages(self, packets: list[tuple[bytes, int]], first: bool = False, last: bool = False) -> list[bytes]:
        """Pages of ``(packet, granule at its end)``; a page without the end of a packet has granule -1."""
        lacing, ends, body = bytearray(), {}, b"".join(p for p, _ in packets)
        for packet, granule in packets:
            lacing += b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
            ends[len(lacing) - 1] = granule
        out, at = [], 0
        for lo in range(0, len(lacing), 255):
            values = bytes(lacing[lo : lo + 255])
            size = sum(values)
            flags = (_CONTINUED if lo and lo - 1 not in ends else 0) | (_FIRST if first and not lo else 0)
            flags |= _LAST if last and lo + 255 >= len(lacing) else 0
            done = [g for k in range(lo, lo + len(values)) if (g := ends.get(k)) is not None]
            out.append(self._page(values, body[at : at + size], done[-1] if done else -1, flags))
            at += size
        return out


def encode_pcm(payload: bytes, serial: int = 1, rate: int = RATE) -> bytes:
    """An Ogg file of two logical streams: 8-bit samples, and an index with the peak of every second."""
    sound, index = StreamWriter(serial), StreamWriter(serial + 1)
    pages = sound.pages([(PCM_HEAD.pack(PCM_MAGIC, 1, rate, 8), 0)], first=True)
    pages += index.pages([(INDEX_MAGIC + struct.pack("<I", rate), 0)], first=True)
    samples = np.frombuffer(payload, np.uint8)
    peaks = np.maximum.reduceat(samples, np.arange(0, len(samples), rate)).tobytes() if len(samples) else b""
    packets = [(payload[k : k + PACKET], min(k + PACKET, len(payload))) for k in range(0, len(payload), PACKET)]
    data = sound.pages(packets, last=True) if packets else []
    marks = index.pages([(peaks, len(payload))], last=True)
    return b"".join([*pages, *data[:1], *marks, *data[1:]])


@dataclass
class Stream:
    serial: int
    pages: int = 0
    granule: int = 0
    lost: int = 0
    ended: bool = False
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    _part: list[bytes] | None = None
    _next: int | None = None

    def take(self, flags: int, granule: int, sequence: int, lacing: bytes, body: bytes) -> None:
        if self._next is not None and sequence != self._next:
            self.lost += self._part is not None
            self._part = None
        self._next = sequence + 1
        self.pages += 1
        if not flags & _CONTINUED and self._part is not None:
            self.lost += 1
            self._part = None
        orphan = bool(flags & _CONTINUED) and self._part is None
        at = start = 0
        before = len(self.packets)
        for value in lacing:
            at += value
            if value < 255:
                if orphan:
                    self.lost, orphan = self.lost + 1, False
                else:
                    self.packets.append(b"".join([*(self._part or ()), body[start:at]]))
                    self._part = None
                start = at
        if lacing and lacing[-1] == 255 and not orphan:
            self._part = [*(self._part or ()), body[start:]]
        # only the last packet to end on a page has a known position
        ended = len(self.packets) - before
        self.granules += [-1] * (ended - 1) + [granule] * (ended > 0)
        if granule >= 0:
            self.granule = granule
        self.ended |= bool(flags & _LAST)


@dataclass
class Demuxed:
    streams: dict[int, Stream] = field(default_factory=dict)
    pages: int = 0
    bad_pages: int = 0


def demux(media: bytes) -> Demuxed:
    """Logical streams of an Ogg file, with every page verified before any of it is used."""
    out, at = Demuxed(), 0
    while (at := media.find(b"OggS", at)) >= 0:
        if at + 27 > len(media):
            break
        _, version, flags, granule, serial, sequence, crc, segments = _HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + segments]
        body = at + 27 + segments
        end = body + sum(lacing)
        whole = version == 0 and len(lacing) == segments and end <= len(media)
        if not whole or page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            out.bad_pages += 1
            at += 4
            continue
        out.pages += 1
        stream = out.streams.setdefault(serial, Stream(serial))
        stream.take(flags, granule, sequence, lacing, media[body:end])
        at = end
    for stream in out.streams.values():
        stream.lost += stream._part is not None
    return out


def packet_times(stream: Stream, rate: int) -> list[float | None]:
    """Seconds at the end of each packet, where its page's granule position tells."""
    return [None if g < 0 else g / rate for g in stream.granules]


def sample_rate(stream: Stream) -> int | None:
    """Rate from the stream's first packet, if it is of the sample format written here."""
    head = stream.packets[0] if stream.packets else b""
    return PCM_HEAD.unpack(head)[2] if len(head) == PCM_HEAD.size and head.startswith(PCM_MAGIC) else None


def ogg_streams(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per logical stream of every medium.

    ``id, serial, pages, packets, bytes, granule, rate, seconds, lost_packets, ended, bad_pages, data``; ``data`` joins
    all packets but the first, which is the header. Null or empty media and media without a good page give one row
    with a null serial, so no medium disappears. Repeated rows give repeated results; other columns are ignored.
    """
    ddl = "id long, serial long, pages long, packets long, bytes long, granule long, rate int, seconds double, lost_packets long, ended boolean, bad_pages long, data binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = demux(value.as_py() or b"")
                for s in found.streams.values():
                    rate, data = sample_rate(s), b"".join(s.packets[1:])
                    rows.append((key, s.serial, s.pages, len(s.packets), sum(map(len, s.packets)), s.granule, rate, s.granule / rate if rate else None, s.lost, s.ended, found.bad_pages, data))
                if not found.streams:
                    rows.append((key, None, 0, 0, 0, None, None, None, 0, False, found.bad_pages, b""))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return media.select(F.col(id_col).cast("long"), F.col(media_col)).mapInArrow(run, ddl)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 64) -> DataFrame:
    """``doc_id, n_bytes, media``: each text as an Ogg file of 8-bit samples, padded with zeros to whole blocks.

    A null text is an empty one; an empty text is one block of zeros. Long texts are one medium of many pages.
    """
    schema = arrow_schema("doc_id long, n_bytes long, media binary")

    def run(batches):
        for batch in batches:
            sizes, media = [], []
            for value in batch.column(1):
                text = (value.as_py() or "").encode()
                sizes.append(len(text))
                media.append(encode_pcm(text + bytes(max(1, -(-len(text) // block)) * block - len(text))))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def describe(found: Demuxed) -> tuple[bytes, str]:
    """The samples of a file and a description: streams, pages, packets, seconds, level, and a sparse envelope."""
    sound = next((s for s in found.streams.values() if sample_rate(s)), None)
    if sound is None:
        return b"", f"streams={len(found.streams)};pages={found.pages};bad={found.bad_pages}"
    payload, rate = b"".join(sound.packets[1:]), sample_rate(sound)
    samples = np.frombuffer(payload, np.uint8)
    parts = [
        f"streams={len(found.streams)}",
        f"pages={found.pages}",
        f"bad={found.bad_pages}",
        f"packets={sum(len(s.packets) for s in found.streams.values())}",
        f"lost={sum(s.lost for s in found.streams.values())}",
        f"seconds={sound.granule / rate:.6f}",
        f"times={','.join(f'{t:.3f}' for t in packet_times(sound, rate)[1:] if t is not None)}",
    ]
    if len(samples):
        total = int(samples.sum(dtype=np.int64))
        square = int((samples.astype(np.int64) ** 2).sum())
        changes = int(np.count_nonzero((samples[1:] < 64) != (samples[:-1] < 64)))
        parts += [f"mean={total / len(samples):.6f}", f"rms={(square / len(samples)) ** 0.5:.6f}", f"crossings={changes}", f"peak={int(samples.max())}"]
    return payload, ";".join(parts)


def text_media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as an Ogg file, reads the stored bytes back, and returns digests and features of both.

    Columns: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``. Equal
    texts have equal values. Null ids stay null, repeated rows stay repeated, an empty table gives an empty result.
    """
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(2):
                media = value.as_py()
                payload, feature = describe(demux(media))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, schema.types[2:], strict=True)]], schema=schema)

    return store_texts(docs, id_col, text_col).mapInArrow(run, ddl)
