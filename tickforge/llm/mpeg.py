"""Media columns: MPEG audio streams that carry a payload, and a reader of MPEG audio.

Writer: an ID3v2 tag, a frame with a variable-bitrate table, silent Layer III frames whose ancillary bytes are the
payload, an ID3v1 tag. Each frame has the checksum of its header and side information. Bitrates vary so that the last
frame is as small as it can be. Reader: skips tags, finds frame headers again after foreign bytes, reads the table, checks
the checksums, and keeps exact durations (samples) and the byte offset of every frame.

Defined cases: a null text is an empty payload of 64 zero bytes; equal texts give equal streams; rows are independent,
so repeated ids and ties change nothing, and ids may be of any type; other columns aren't carried; a null or broken stream, cut
anywhere, has as many frames as can be found; an empty table gives an empty result. Long texts are
whole payloads; a task holds one text and its stream at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, stored

# Fixed values of the format: bitrates in kbit/s by (MPEG-1?, layer), sampling rates in Hz by version.
BITRATES = {
    (True, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
CRC_POLYNOMIAL, CRC_START = 0x8005, 0xFFFF
#: What the writer uses: MPEG-1 Layer III, one channel, 32 kHz, so 1,152 samples and 4.5 bytes a kbit/s.
RATE, SAMPLES, SIDE = 32_000, 1152, 17
OWNER = b"payload\0"


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    crc = CRC_START
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ CRC_POLYNOMIAL if crc & 0x8000 else crc << 1
        crc &= 0xFFFF
    return crc


def header(data: bytes, at: int) -> dict | None:
    """The frame header at `at`; None if there is none."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1 : at + 4]
    version, layer = b1 >> 3 & 3, 4 - (b1 >> 1 & 3)
    bitrate, rate = b2 >> 4, b2 >> 2 & 3
    if version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3 or b3 & 3 == 2:
        return None
    first, mono = version == 3, b3 >> 6 == 3
    kbps, hz, pad = BITRATES[first, layer][bitrate - 1], RATES[version][rate], b2 >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    length = (12_000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return {
        "kind": (version, layer, hz, mono), "length": length, "samples": samples, "kbps": kbps,
        "crc": not b1 & 1, "side": side if layer == 3 else 0,
    }


def frame(index: int, body: bytes) -> bytes:
    """A silent frame of bitrate number `index` with `body` as its ancillary bytes, filled up with zeros."""
    head = bytes([0xFF, 0xFA, (index + 1) << 4 | 2 << 2, 0xC0])
    length = 9 * BITRATES[True, 3][index] // 2
    side = bytes(SIDE)
    data = head + crc16(head[2:] + side).to_bytes(2, "big") + side + body
    return data + bytes(length - len(data))


ROOM = [9 * k // 2 - 6 - SIDE for k in BITRATES[True, 3]]


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    frames = []
    for at in range(0, len(payload), ROOM[-1]):
        part = payload[at : at + ROOM[-1]]
        frames.append(frame(next(i for i, r in enumerate(ROOM) if r >= len(part)), part))
    sizes = [len(f) for f in frames]
    info_size = 9 * 64 // 2
    total = info_size + sum(sizes)
    ends, marks = 0, []
    for f, size in enumerate(sizes):
        marks.append(info_size + ends)
        ends += size
        del f
    seek = bytes(min(255, 256 * marks[min(len(marks) - 1, p * len(marks) // 100)] // total) for p in range(100))
    info = frame(4, b"Xing" + struct.pack(">III", 7, len(frames), total) + seek)
    private = OWNER + struct.pack(">QI", len(payload), zlib.crc32(payload))
    tag = b"PRIV" + synchsafe(len(private)) + b"\0\0" + private
    start = b"ID3\x04\0\0" + synchsafe(len(tag)) + tag
    return start + info + b"".join(frames) + b"TAG" + bytes(125)


def decode(data: bytes) -> dict:
    """What a stream holds: payload, frames, samples, rate, seek offsets, table, checksum errors, resynchronisations."""
    found = {"payload": b"", "samples": 0, "rate": 0, "seek": [], "bad_crc": 0, "checked": 0, "resyncs": 0, "kbps": [], "vbr_frames": None, "vbr_bytes": None, "length": None, "payload_crc": None, "mode": ""}
    at, end = 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10:
        size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
        at, stop = 10, min(len(data), 10 + size)
        while at + 10 <= stop and data[at : at + 1].isalnum():
            n = data[at + 4] << 21 | data[at + 5] << 14 | data[at + 6] << 7 | data[at + 7]
            body = data[at + 10 : at + 10 + n]
            if data[at : at + 4] == b"PRIV" and body.startswith(OWNER) and len(body) >= len(OWNER) + 12:
                found["length"], found["payload_crc"] = struct.unpack_from(">QI", body, len(OWNER))
            at += 10 + n
        at = stop
    if len(data) >= 128 and data[-128:-125] == b"TAG":
        end -= 128
    kind, parts, lost, first = None, [], False, True
    while at + 4 <= end:
        h = header(data, at)
        ok = h is not None and at + h["length"] <= end and (kind is None or h["kind"] == kind)
        if ok and (lost or kind is None):  # a lone header isn't trusted: the next must follow, or the end
            after = header(data, at + h["length"])
            ok = at + h["length"] == end or (after is not None and after["kind"] == h["kind"])
        if not ok:
            if not lost:
                found["resyncs"] += 1
                lost = True
            nxt = data.find(b"\xff", at + 1, end)
            if nxt < 0:
                break
            at = nxt
            continue
        lost, kind = False, h["kind"]
        skip = 4 + 2 * h["crc"]
        if h["crc"] and h["side"]:
            found["checked"] += 1
            given = int.from_bytes(data[at + 4 : at + 6], "big")
            found["bad_crc"] += given != crc16(data[at + 2 : at + 4] + data[at + skip : at + skip + h["side"]])
        body, stop = at + skip + h["side"], at + h["length"]
        if first and stop - body >= 8 and data[body : body + 4] in (b"Xing", b"Info"):
            flags, p = struct.unpack_from(">I", data, body + 4)[0], body + 8
            for bit, name in ((1, "vbr_frames"), (2, "vbr_bytes")):  # a field that the frame has no room for is not there
                if flags & bit and p + 4 <= stop:
                    found[name], p = struct.unpack_from(">I", data, p)[0], p + 4
        else:
            found["seek"].append(at)
            found["kbps"].append(h["kbps"])
            found["samples"] += h["samples"]
            parts.append(data[body:stop])
        first = False
        at = stop
    if kind:
        found["rate"], found["mode"] = kind[2], f"{ {3: '1', 2: '2', 0: '2.5'}[kind[0]]}/{kind[1]}/{'mono' if kind[3] else 'stereo'}"
    whole = b"".join(parts)
    found["payload"] = whole if found["length"] is None else whole[: found["length"]]
    return found


def media_of_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, filled up with zero bytes to a positive multiple of 64, as a stream."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = []
            for text in batch.column(1):
                data = text.as_buffer().to_pybytes() if text.as_buffer() is not None else b""
                media.append(encode(data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    text = F.coalesce(named(text_col), F.lit(""))
    return docs.select(named(id_col), text.cast("binary"), F.octet_length(text).cast("long")).mapInArrow(
        make, f"doc_id {kind}, n_bytes long, media binary"
    )


FOUND = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "n_frames long, n_samples long, sample_rate int, bad_checksums int, resyncs int, seek_offsets array<long>"
)


def probe_media(media: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """The columns `keep` and what each stream holds. The exact duration is n_samples / sample_rate seconds."""
    schema = ", ".join(f"{c} {media.schema[c].dataType.simpleString()}" for c in keep)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(len(keep)):
                data = value.as_py() or b""
                f = decode(data)
                payload, intact = f["payload"], f["payload_crc"] == zlib.crc32(f["payload"])
                feature = (
                    f"mpeg={f['mode']};frames={len(f['seek'])};samples={f['samples']};rate={f['rate']};kbps={min(f['kbps'], default=0)}-{max(f['kbps'], default=0)};"
                    f"table={int(f['vbr_frames'] == len(f['seek']))};crc={f['checked'] - f['bad_crc']}/{f['checked']};payload={int(intact)}"
                )
                rows.append(
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature,
                     len(f["seek"]), f["samples"], f["rate"], f["bad_crc"], f["resyncs"], f["seek"])
                )
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            made = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], names)

    names = [*keep, *[p.split()[0] for p in FOUND.split(", ")]]
    return media.select(*keep, media_col).mapInArrow(read, f"{schema}, {FOUND}" if schema else FOUND)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored as streams in a table, read back and probed."""
    return probe_media(stored(media_of_text(docs, id_col, text_col), "media"), ["doc_id", "n_bytes"])
