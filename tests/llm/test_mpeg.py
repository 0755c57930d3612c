import hashlib
import math
import random
import struct
import zlib

from ledgerweave.llm import mpeg

from .helpers import ODD, documents


def frame(kbits_index, fill=0, crc=True):
    raw = bytes([0xFF, 0xFA if crc else 0xFB, kbits_index << 4, 0xC0])
    head = mpeg.header(raw)
    side = bytes(17)
    start = raw + (mpeg.crc16(raw[2:] + side).to_bytes(2, "big") if crc else b"") + side
    return start + bytes([fill]) * (head.size - len(start))


def test_header_sizes():
    assert mpeg.header(bytes([0xFF, 0xFB, 0x90, 0xC0])).size == 417  # 128 kbit/s, 44.1 kHz
    assert mpeg.header(bytes([0xFF, 0xFB, 0x92, 0xC0])).size == 418
    assert mpeg.header(bytes([0xFF, 0xF3, 0x90, 0xC0])).samples == 576  # MPEG-2
    assert mpeg.header(bytes([0xFF, 0xFF, 0x90, 0xC0])).samples == 384  # layer I
    assert mpeg.header(b"\xff\xfb\xf0\xc0") is None and mpeg.header(b"RIFF") is None


def test_known_checksum():
    assert mpeg.crc16(b"123456789") == 0xAEE7  # CRC-16/CMS: polynomial 0x8005, start 0xFFFF


def test_resynchronisation_and_broken_checksums():
    a, b, c = frame(9, 1), bytearray(frame(5, 2)), frame(9, 3, crc=False)
    b[8] ^= 1
    data = b"\x00\xff\xfb junk" + a + bytes(b) + b"\xff\x00lost" + c + a
    track = mpeg.parse(data)
    # all four frames: the one before the lost bytes follows a frame like it
    assert [h.kbits for h in track.headers] == [128, 64, 128, 128] and track.resyncs == 2
    assert (track.checked, track.broken, track.samples) == (3, 1, 4 * 1152)
    whole = mpeg.parse(a + bytes(b) + c)
    assert (whole.checked, whole.broken, whole.samples, whole.micros()) == (2, 1, 3 * 1152, 3 * 1152 * 1_000_000 // 44100)
    assert whole.offsets == [0, len(a), len(a) + len(b)] and whole.seek(2) == [0, len(a) + len(b)]


def test_mixed_rates():
    """44.1 kHz, then 48 kHz: each frame lasts as long as its own rate says, and no byte is skipped."""
    high = bytes([0xFF, 0xFB, 0x94, 0xC0])
    high += bytes(mpeg.header(high).size - 4)
    track = mpeg.parse(frame(9) * 3 + high * 2 + b"\xff\xfb junk")
    assert [h.hz for h in track.headers] == [44100] * 3 + [48000] * 2
    assert track.micros() == math.floor(1152 * 1_000_000 * (3 / 44100 + 2 / 48000)) and track.resyncs == 0


def bits_crc(bits):
    """The checksum by long division, bit by bit."""
    crc = 0xFFFF
    for bit in bits:
        crc = (crc << 1) ^ (0x8005 if (crc >> 15 & 1) != int(bit) else 0)
        crc &= 0xFFFF
    return crc.to_bytes(2, "big")


def as_bits(raw):
    return "".join(f"{b:08b}" for b in raw)


def test_layer_two_checksum():
    """Stereo at 192 kbit/s and 44.1 kHz: 30 subbands; joint ones share their allocation but choose scale factors twice."""
    for third, shared_from in ((0x00, 32), (0x60, 12)):
        raw = bytes([0xFF, 0xFC, 0xA0, third])
        head = mpeg.header(raw)
        assert (head.layer, head.kbits, head.bound) == (2, 192, shared_from)
        rng, bits, chosen = random.Random(third), "", 0
        for band in range(30):
            width = 4 if band < 11 else 3 if band < 23 else 2
            for _ in range(1 if band >= shared_from else 2):
                value = rng.randrange(1 << width) * rng.randrange(2)
                bits += f"{value:0{width}b}"
                chosen += (value > 0) * (2 if band >= shared_from else 1)
        bits += "".join(rng.choice("01") for _ in range(2 * chosen))
        body = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big")
        whole = raw + bits_crc(as_bits(raw[2:]) + bits) + body
        whole += b"\x55" * (head.size - len(whole))
        worse = bytearray(whole)
        worse[7] ^= 0x10
        track = mpeg.parse(whole + bytes(worse) + whole)
        assert (track.checked, track.broken, len(track.headers)) == (3, 1, 3)


def test_layer_one_checksum():
    for third, covered in ((0x00, 256), (0x50, 128 + 32), (0xC0, 128)):  # stereo, joint from subband 8, mono
        raw = bytes([0xFF, 0xFE, 0x40, third])
        head = mpeg.header(raw)
        body = random.Random(third).randbytes(head.size - 6)
        whole = raw + bits_crc(as_bits(raw[2:]) + as_bits(body)[:covered]) + body
        track = mpeg.parse(whole * 2)
        assert (head.layer, track.checked, track.broken) == (1, 2, 0)


def test_tables_and_tags():
    first = bytearray(frame(9, crc=False))
    first[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 1234, 5, 2, 1, 2, 3)
    first[62:66] = struct.pack(">HH", 700, 534)
    track = mpeg.parse(bytes(first) + frame(9, crc=False) + b"TAG" + b"A title".ljust(125, b"\0"))
    assert track.table == {"kind": "vbri", "frames": 5, "bytes": 1234, "toc": [700, 534], "every": 3} and track.tags["TIT2"] == "A title"
    assert len(track.headers) == 1
    made = mpeg.parse(mpeg.encode(b"x" * 5000))
    assert made.table["frames"] == len(made.headers) and made.table["kind"] == "xing" and len(made.table["toc"]) == 100
    assert made.checked == len(made.headers) + 1 and made.broken == made.resyncs == 0


def test_no_audio():
    for data in (b"", b"\xff", b"\xff" * 50, b"ID3\3\0\0\0\0\0\x7f", bytes(1000)):
        assert mpeg.parse(data).headers == [] and mpeg.feature(mpeg.parse(data)).startswith("none")


def test_texts_come_back(spark):
    ids = [*range(len(ODD) - 1), None]
    rows = mpeg.tracks(mpeg.media_column(documents(spark, ODD, ids))).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows}
    for i, text in zip(ids, ODD, strict=True):
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert got[i] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert mpeg.tracks(mpeg.media_column(documents(spark, []))).count() == 0
