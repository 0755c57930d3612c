"""MPEG audio columns: frames found by resynchronisation, tags, variable-bitrate tables, checksums, exact durations, seek offsets.

``parse`` reads any stream of MPEG-1/2/2.5 layer I-III frames. A frame counts if it follows a frame of the same version,
layer and sampling rate (so the last one before junk does), or if one of these follows it, or if the stream ends with it;
otherwise the reader moves on a byte and counts a resynchronisation. Checksums of all layers are verified: over the
side information in layer III, over the bit allocation in layer I, and over bit allocation and scale factor selection
in layer II. Durations are summed exactly for each sampling rate.
``encode`` writes a payload losslessly as the main data of layer III frames with CRCs, behind an ID3v2 tag and a Xing
table, which is how the query stores a text's bytes.

Nulls count as empty. Bytes that are no MPEG audio give a track without frames. Texts of any length are stored whole.
Repeated rows, and rows with equal texts, give equal values; a null doc_id stays null. Other columns are not read,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the MPEG audio standards: kbit/s by (is MPEG-1, layer), Hz by version bits, samples of a frame.
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Layer II: bits of the allocation of each subband, by table; the last is for MPEG-2 and 2.5.
ALLOCATION = {"a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "low": [4] * 4 + [3] * 7 + [2] * 19}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}

#: Payloads are padded with zeros to a positive multiple of this.
PAD = 64
#: A seek offset is kept for every so many frames.
SEEK_EVERY = 32


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    crc: bool
    kbits: int
    hz: int
    mono: bool
    bound: int  # first subband that both channels share; 32: none
    size: int
    samples: int

    def like(self, other: Header | None) -> bool:
        """Whether the two may be neighbours in one stream."""
        return other is not None and (self.version, self.layer, self.hz) == (other.version, other.layer, other.hz)

    @property
    def allocation(self) -> list[int]:
        """Layer II's allocation bits of each subband."""
        each = self.kbits if self.mono else self.kbits // 2
        if self.version != 3:
            return ALLOCATION["low"]
        if each <= 48:
            return ALLOCATION["d" if self.hz == 32000 else "c"]
        return ALLOCATION["a" if each <= 80 or self.hz == 48000 else "b"]

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(maxsize=4096)
def header(raw: bytes) -> Header | None:
    """The frame header in four bytes; None if they are none. Free-format frames have no size and count as none."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    rate, hz = raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    first = version == 3
    kbits, hz, pad = KBITS[first, layer][rate], HZ[version][hz], raw[2] >> 1 & 1
    samples = SAMPLES[first, layer]
    size = (12 * kbits * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbits * 1000 // hz + pad
    mode, bound = raw[3] >> 6, 4 * (raw[3] >> 4 & 3) + 4
    return Header(version, layer, not raw[1] & 1, kbits, hz, mode == 3, bound if mode == 1 else 32, size, samples)


@lru_cache(maxsize=65536)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The frame checksum over the first bits (or all): polynomial 0x8005, start 0xFFFF, highest bit first."""
    crc, left = 0xFFFF, 8 * len(data) if bits is None else bits
    for byte in data:
        for k in range(7, 7 - min(8, left), -1):
            top = crc >> 15 ^ byte >> k & 1
            crc = (crc << 1 ^ 0x8005 * top) & 0xFFFF
        left -= min(8, left)
    return crc


def protected(head: Header, body: bytes) -> int:
    """Bits behind the checksum that it covers; body: the frame from there on."""
    channels = 1 if head.mono else 2
    if head.layer == 3:
        return 8 * head.side
    if head.layer == 1:
        return sum(4 * (channels if band < head.bound else 1) for band in range(32))
    stream, at, chosen = int.from_bytes(body, "big"), 0, 0
    for band, width in enumerate(head.allocation):
        shared = band >= head.bound
        for _ in range(1 if shared else channels):
            used = stream >> (8 * len(body) - at - width) & (1 << width) - 1 if at + width <= 8 * len(body) else 0
            chosen += (used != 0) * (channels if shared else 1)
            at += width
    return at + 2 * chosen


@dataclass
class Track:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    table: dict | None = None
    resyncs: int = 0
    checked: int = 0
    broken: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def hz(self) -> int:
        return self.headers[0].hz if self.headers else 0

    def micros(self) -> int:
        """Exact duration over all frames, each at its own sampling rate, to the microsecond below."""
        played = Counter()
        for h in self.headers:
            played[h.hz] += h.samples
        return int(sum(Fraction(n * 1_000_000, hz) for hz, n in played.items()))

    def seek(self, every: int = SEEK_EVERY) -> list[int]:
        return self.offsets[::every]


def _synchsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """(bytes of the tag, its text frames)."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 127:
        return 0, {}
    end, at, tags = min(len(data), 10 + _synchsafe(data[6:10])), 10, {}
    wide = data[3] >= 4
    while at + 10 <= end and data[at : at + 4].isalnum():
        name, size = data[at : at + 4].decode("latin-1"), (_synchsafe if wide else lambda b: int.from_bytes(b, "big"))(data[at + 4 : at + 8])
        body = data[at + 10 : min(end, at + 10 + size)]
        if name[0] == "T" and body:
            text = body[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), errors="replace").rstrip("\0")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value
        at += 10 + size
    return end + (10 if data[5] & 0x10 else 0), tags


def _table(data: bytes, at: int, head: Header) -> dict | None:
    """The Xing/Info or VBRI table in a frame."""
    x = at + 4 + 2 * head.crc + head.side
    if data[x : x + 4] in (b"Xing", b"Info") and x + 8 <= len(data):
        flags, place, out = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8, {"kind": data[x : x + 4].decode().lower()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(data[place : place + 4], "big")
                place += 4
        if flags & 4:
            out["toc"] = list(data[place : place + 100])
        return out
    if data[at + 36 : at + 40] == b"VBRI" and at + 62 <= len(data):
        size, frames, entries, scale, width, each = struct.unpack(">IIHHHH", data[at + 46 : at + 62])
        table = [int.from_bytes(data[at + 62 + k * width : at + 62 + (k + 1) * width], "big") * scale for k in range(entries)]
        return {"kind": "vbri", "frames": frames, "bytes": size, "toc": table, "every": each}
    return None


def parse(data: bytes) -> Track:
    """All frames of a stream, with its tags and variable-bitrate table."""
    track = Track()
    at, track.tags = _id3v2(data)
    end = len(data) - 128 if len(data) >= 128 and data[-128:-125] == b"TAG" else len(data)
    if end < len(data):
        track.tags.setdefault("TIT2", data[-125:-95].decode("latin-1").rstrip("\0 "))
    lost, last = False, None
    while at + 4 <= end:
        head = header(data[at : at + 4])
        after = at + head.size if head else 0
        fits = head is not None and after <= end
        if not fits or not (head.like(last) or end - after < 4 or head.like(header(data[after : after + 4]))):
            at, last = data.find(b"\xff", at + 1, end), None
            if at < 0:
                break
            track.resyncs += not lost
            lost = True
            continue
        lost, last = False, head
        if head.crc:
            body = data[at + 6 : min(after, at + 6 + 96)]  # no layer covers more than 94 bytes
            bits = protected(head, body)
            if bits <= 8 * len(body):
                track.checked += 1
                track.broken += crc16(data[at + 2 : at + 4] + body[: -(-bits // 8)], 16 + bits) != int.from_bytes(data[at + 4 : at + 6], "big")
        if not track.headers and track.table is None and (found := _table(data, at, head)):
            track.table = found
        else:
            track.offsets.append(at)
            track.headers.append(head)
        at = after
    return track


def main_data(data: bytes, track: Track) -> bytes:
    """The main data of all frames, joined."""
    return b"".join(data[at + 4 + 2 * h.crc + h.side : at + h.size] for at, h in zip(track.offsets, track.headers, strict=True))


_SIDE = 17  # MPEG-1 layer III, mono


@lru_cache(maxsize=64)
def _frame(kbits_index: int) -> tuple[bytes, int]:
    """(header, checksum and side information, room for main data) of a 44.1 kHz mono frame."""
    raw = bytes([0xFF, 0xFA, kbits_index << 4, 0xC0])
    return raw + crc16(raw[2:] + bytes(_SIDE)).to_bytes(2, "big") + bytes(_SIDE), header(raw).size - 6 - _SIDE


def encode(text: bytes) -> bytes:
    """The bytes, zero-padded to a positive multiple of PAD, as frames behind an ID3v2 tag and a Xing table."""
    n = max(PAD, -(-len(text) // PAD) * PAD)
    payload = text + bytes(n - len(text))
    frames, at = [], 0
    while at < n:
        k = next((k for k in range(1, 14) if _frame(k)[1] >= n - at), 14)
        start, room = _frame(k)
        part = payload[at : at + room]
        frames.append(start + part + bytes(room - len(part)))
        at += room
    body = b"\0".join([b"\0PAYLOAD", f"{len(text)} {n}".encode()])
    tag = b"TXXX" + len(body).to_bytes(4, "big") + b"\0\0" + body
    size = len(tag)
    tag = b"ID3\3\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + tag
    start, room = _frame(9)
    total = sum(map(len, frames))
    places = [0]
    for f in frames:
        places.append(places[-1] + len(f))
    toc = bytes(min(255, places[len(frames) * k // 100] * 256 // total) for k in range(100))
    xing = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    return tag + start + xing + bytes(room - len(xing)) + b"".join(frames)


def feature(track: Track) -> str:
    if not track.headers:
        return f"none;resyncs={track.resyncs}"
    h, table = track.headers[0], track.table or {}
    version = {3: "1", 2: "2", 0: "2.5"}[h.version]
    rates = sorted({x.kbits for x in track.headers})
    return f"mpeg{version}-layer{h.layer};hz={h.hz};frames={len(track.headers)};samples={track.samples};us={track.micros()};kbits={rates[0]}-{rates[-1]};table={table.get('kind', 'none')}:{table.get('frames', 0)};crc={track.checked - track.broken}/{track.checked};resyncs={track.resyncs};seek={len(track.seek())}:{zlib.crc32(struct.pack(f'<{len(track.seek())}Q', *track.seek())):08x}"


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, media): every whole text as an MPEG stream."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in common.chunked(batches):
            raw = data.tobytes()
            media = [encode(raw[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(make, "doc_id long, media binary")


def tracks(media: DataFrame) -> DataFrame:
    """(doc_id, ...) with what the stored streams say: payload digests, exact duration, seek offsets, feature."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, seek array<long>"
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_us", "seek"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in common.pieces(common.flat(batch.column("media"))[1], 4 << 20):
                rows = []
                for doc, media in zip(batch.column("doc_id").slice(i, j - i).to_pylist(), batch.column("media").slice(i, j - i).to_pylist(), strict=True):
                    media = media or b""
                    track = parse(media)
                    n, padded = map(int, track.tags.get("PAYLOAD", "0 0").split())
                    payload = main_data(media, track)[:padded]
                    rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature(track), track.micros(), track.seek()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.mapInArrow(read, schema)


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents stored as an MPEG stream, read back from the stored table."""
    stored = common.written(media_column(common.table(spark, sf_dir, "documents")), "media", compression="zstd")
    return tracks(stored)
