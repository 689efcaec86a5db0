import hashlib
import zlib

import pytest

from ashlar.llm import ogg


def plain_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("data", [b"", b"a", b"OggS" * 33, bytes(range(256))])
def test_checksum(data):
    assert ogg.page_crc(data) == plain_crc(data)


@pytest.mark.parametrize("size", [0, 64, 254, 255, 256, 8192, 8193, 65025, 70000, 500_032])
def test_round_trip(size):
    payload = bytes((i * 7 + i // 255) % 256 for i in range(size))
    found = ogg.demux(ogg.encode_pcm(payload))
    assert found.bad_pages == 0 and len(found.streams) == 2
    sound = found.streams[1]
    assert b"".join(sound.packets[1:]) == payload and sound.lost == 0
    assert [len(p) for p in sound.packets[1:-1]] == [ogg.PACKET] * max(0, len(sound.packets) - 2)
    assert sound.granule == size
    times = [t for t in ogg.packet_times(sound, ogg.RATE) if t is not None]
    assert times == sorted(times) and times[-1] == size / ogg.RATE


def test_packets_of_lacing_edges():
    writer = ogg.StreamWriter(5)
    packets = [(b"x" * n, i) for i, n in enumerate([0, 1, 254, 255, 510, 70000, 0])]
    found = ogg.demux(b"".join(writer.pages(packets, first=True, last=True)))
    assert found.streams[5].packets == [p for p, _ in packets] and found.streams[5].ended


def test_damage_is_noticed_and_read_over():
    media = bytearray(ogg.encode_pcm(bytes(300_000)))
    at = media.find(b"OggS", 70_000)
    media[at + 400] ^= 1
    found = ogg.demux(bytes(media))
    assert found.bad_pages >= 1
    sound = found.streams[1]
    assert sound.lost >= 1 and all(len(p) == ogg.PACKET for p in sound.packets[1:-1])
    assert ogg.demux(b"noise OggS").streams == {}
    assert ogg.demux(bytes(media[:50])).pages == 1


def test_digest(spark):
    texts = [(1, "abc", 0), (2, None, 0), (3, "", 0), (4, "é" * 100_000, 0), (5, "abc", 0), (None, "x" * 64, 0), (1, "abc", 0)]
    rows = ogg.text_media_digest(spark.createDataFrame(texts, "doc_id long, text string, media int")).collect()
    assert len(rows) == len(texts)
    for (doc_id, text, _), r in zip(sorted(texts, key=str), sorted(rows, key=lambda r: str((r.doc_id, next(t for i, t, _ in texts if i == r.doc_id), 0))), strict=True):
        data = (text or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (doc_id, len(data), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        media = ogg.encode_pcm(padded)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert len({r[1:] for r in rows if r.n_bytes == 3}) == 1


def test_streams_and_empty_tables(spark):
    media = [(1, ogg.encode_pcm(b"a" * 9000)), (2, None), (3, b""), (4, b"junk")]
    df = spark.createDataFrame(media, "id long, media binary")
    rows = ogg.ogg_streams(df, "id", "media").collect()
    assert sorted((r.id, r.serial or 0) for r in rows) == [(1, 1), (1, 2), (2, 0), (3, 0), (4, 0)]
    sound = next(r for r in rows if r.serial == 1)
    assert bytes(sound.data) == b"a" * 9000 and sound.seconds == 9000 / ogg.RATE
    assert ogg.ogg_streams(df.limit(0), "id", "media").count() == 0
    assert ogg.text_media_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
