import hashlib
import random
import zlib

from tickforge.llm.mpeg import RATE, crc16, decode, encode, header, probe_media, text_media

rng = random.Random(5)


def test_round_trip_and_seek_table():
    for n in (64, 128, 1408, 1472, 64 * 500):
        for payload in (bytes(n), rng.randbytes(n), b"\xff\xfa\xe8\xc0" * (n // 4)):
            data = encode(payload)
            f = decode(data)
            assert f["payload"] == payload and f["payload_crc"] == zlib.crc32(payload)
            assert f["samples"] == 1152 * len(f["seek"]) and f["rate"] == RATE and f["resyncs"] == 0
            assert f["bad_crc"] == 0 and f["checked"] == f["vbr_frames"] + 1 == len(f["seek"]) + 1
            assert all(header(data, at)["samples"] == 1152 for at in f["seek"])


def test_resynchronises_and_checks():
    payload = rng.randbytes(64 * 200)
    data = encode(payload)
    at = decode(data)["seek"]
    noisy = data[: at[3]] + b"\xff\xfb junk \xff" * 9 + data[at[3] :]
    f = decode(noisy)
    assert f["payload"] == payload and f["resyncs"] == 1 and f["seek"][3] == at[3] + 81
    hurt = bytearray(data)
    hurt[at[2] + 8] ^= 1  # in the side information
    f = decode(bytes(hurt))
    assert f["bad_crc"] == 1 and len(f["seek"]) == len(at)
    lost = data[: at[1] + 100] + data[at[2] :]
    f = decode(lost)
    assert f["resyncs"] >= 1 and len(f["seek"]) >= len(at) - 2
    for broken in (b"", b"\xff", b"ID3", b"x" * 500, data[:50]):
        assert decode(broken)["samples"] == 0
    assert crc16(b"123456789") == 0xAEE7  # the published check value of this polynomial and start


def test_a_stream_that_the_writer_did_not_make():
    """MPEG-1 Layer III at 128 kbit/s and 44.1 kHz, two channels, no checksums, laid out byte by byte."""
    tag = b"ID3\x03\x00\x00" + bytes([0, 0, 1, 0]) + bytes(128)
    table = b"\xff\xfb\x90\x00" + bytes(32) + b"Xing" + (3).to_bytes(4, "big") + (3).to_bytes(4, "big") + (417 * 3 + 418).to_bytes(4, "big")
    table += bytes(417 - len(table))
    plain, padded = b"\xff\xfb\x90\x00" + bytes(413), b"\xff\xfb\x92\x00" + bytes(414)
    data = tag + table + plain + padded + b"\x00 no frame \xff\x00" + plain + b"TAG" + bytes(125)
    f = decode(data)
    first = len(tag) + 417
    assert f["seek"] == [first, first + 417, first + 417 + 418 + 13]
    assert f["samples"] == 3 * 1152 and f["rate"] == 44100 and f["vbr_frames"] == 3 and f["resyncs"] == 1 and f["checked"] == f["bad_crc"] == 0


def test_other_headers():
    assert header(bytes([0xFF, 0xFB, 0x90, 0x00]), 0) == {"kind": (3, 3, 44100, False), "length": 417, "samples": 1152, "kbps": 128, "crc": False, "side": 32}
    assert header(bytes([0xFF, 0xFD, 0x84, 0x00]), 0)["length"] == 384  # layer II, 128 kbit/s, 48 kHz
    assert header(bytes([0xFF, 0xF3, 0x84, 0xC0]), 0)["samples"] == 576
    assert header(bytes([0xFF, 0xEA, 0x84, 0xC0]), 0) is None and header(bytes([0xFF, 0xFB, 0xF0, 0]), 0) is None


def test_text_media(spark):
    rows = [(1, "a"), (2, None), (3, ""), (4, "é" * 32), (5, "é" * 33), (6, "long text " * 20000), (7, "a"), (None, "b"), (1, "a")]
    df = spark.createDataFrame([(*r, b"m") for r in rows], "doc_id long, text string, media binary")
    got = text_media(df).collect()
    assert len(got) == len(rows)
    texts = {(i, len((t or "").encode())): (t or "").encode() for i, t in rows}
    for r in got:
        data = texts[r.doc_id, r.n_bytes]
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert hashlib.sha256(encode(padded)).hexdigest() == r.media_sha256 and len(encode(padded)) == r.media_bytes
        assert r.n_samples == 1152 * r.n_frames and r.bad_checksums == 0 and len(r.seek_offsets) == r.n_frames
    assert len({(r.media_sha256, r.feature) for r in got if r.n_bytes == 1 and r.doc_id in (1, 7)}) == 1
    assert text_media(df.limit(0)).count() == 0
    nothing = probe_media(spark.createDataFrame([(1, None)], "doc_id long, media binary"), ["doc_id"]).first()
    assert nothing.n_frames == 0 and nothing.payload_bytes == 0
