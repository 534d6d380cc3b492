import struct
import hashlib
import random
import zlib

import numpy as np
import pytest

from lexigrain.llm import flac


class Writer:
    """A slow FLAC writer that uses what the operator's own writer does not."""

    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [v >> i & 1 for i in reversed(range(n))]

    def bytes(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()

    def rice(self, r, k):
        u = 2 * r if r >= 0 else -2 * r - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u & (1 << k) - 1, k)


def slow_crc(data, width, poly):
    reg = 0
    for b in data:
        reg ^= b << (width - 8)
        for _ in range(8):
            reg = (reg << 1 ^ poly if reg >> (width - 1) else reg << 1) & (1 << width) - 1
    return reg


def stream(frames, n, bps, channels, pcm_md5=bytes(16), total=None):
    info = n.to_bytes(2) * 2 + bytes(6) + (44100 << 44 | (channels - 1) << 41 | (bps - 1) << 36 | (len(frames) * n if total is None else total)).to_bytes(8) + pcm_md5
    return b"fLaC" + bytes([0x81, 0, 0, 0])[:0] + bytes([0x80, 0, 0, 34]) + info + b"".join(frames)


def frame(number, n, code, size_code, write):
    w = Writer()
    head = bytes([0xFF, 0xF8, 0x70, code << 4 | size_code << 1]) + flac._number(number) + (n - 1).to_bytes(2)
    for b in head + bytes([slow_crc(head, 8, 7)]):
        w.put(b, 8)
    write(w)
    raw = w.bytes()
    return raw + slow_crc(raw, 16, 0x8005).to_bytes(2)


def lpc(w, x, bps, coefs, shift, precision, method, parts, params):
    order = len(coefs)
    w.put((32 + order - 1) << 1, 8)
    for v in x[:order]:
        w.put(v & (1 << bps) - 1, bps)
    w.put(precision - 1, 4)
    w.put(shift, 5)
    for c in coefs:
        w.put(c & (1 << precision) - 1, precision)
    w.put(method, 2)
    w.put(parts, 4)
    size, width = len(x) >> parts, 4 + method
    for p in range(1 << parts):
        k = params[p]
        w.put((1 << width) - 1 if k is None else k, width)
        if k is None:
            w.put(bps + 3, 5)
        for i in range(max(order, p * size), (p + 1) * size):
            r = x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefs)) >> shift)
            w.put(r & (1 << bps + 3) - 1, bps + 3) if k is None else w.rice(r, k)


def decoded(media):
    (_, blocks, error), = flac.decode([media])
    return blocks, error


def test_tables():
    for data in (b"", b"a", b"123456789", bytes(range(256)) * 3):
        assert flac.crc8(data) == slow_crc(data, 8, 7)
        buf = np.frombuffer(b"zz" + data + b"yy", np.uint8)
        assert flac.crc16(buf, np.array([2]), np.array([len(data)]))[0] == slow_crc(data, 16, 0x8005)
    assert [flac._number(n).hex() for n in (0, 0x7F, 0x80, 0x7FF, 0x800, 0xFFFF, 0x10000)] == ["00", "7f", "c280", "dfbf", "e0a080", "efbfbf", "f0908080"]


@pytest.mark.parametrize("method", [0, 1])
def test_lpc_stereo_escapes(method):
    rng = random.Random(method)
    n, bps = 64, 16
    left = [int(3000 * np.sin(i / 5)) + rng.randrange(-9, 9) for i in range(n)]
    right = [v // 2 + rng.randrange(-50, 50) for v in left]

    def mid_side(w):
        mid = [(a + b) >> 1 for a, b in zip(left, right)]
        lpc(w, mid, bps, [117, -58, 3], 6, 9, method, 2, [5, None, 7, 9])
        lpc(w, [a - b for a, b in zip(left, right)], bps + 1, [64], 6, 9, method, 0, [10])

    def left_side(w):
        lpc(w, left, bps, [1], 0, 5, method, 1, [9, 0])
        w.put(1 << 1 | 1, 8)  # verbatim with one wasted bit
        w.put(1, 1)
        for a, b in zip(left, right):
            w.put((a - b) // 2 & (1 << bps) - 1, bps)

    even = [(a - (a - b) // 2 * 2) for a, b in zip(left, right)]
    for code, write, r in ((10, mid_side, right), (8, left_side, even)):
        want = np.array(list(zip(left, r)), "<i2").tobytes()
        media = stream([frame(i, n, code, 4, write) for i in range(3)], n, bps, 2, hashlib.md5(want * 3).digest())
        blocks, error = decoded(media)
        assert error is None and [s for s, _ in blocks] == [0, n, 2 * n] and all(p == want for _, p in blocks)


def test_long_unary_and_false_sync():
    n = 16
    x = [127, -128] * 4 + [0] * 8
    wide = frame(0, n, 0, 1, lambda w: lpc(w, x, 8, [1], 0, 2, 0, 0, [0]))  # runs of hundreds of zeros
    media = stream([wide], n, 8, 1)
    assert decoded(media) == ([(0, bytes(v + 128 for v in x))], None)
    trap = frame(1, n, 0, 1, lambda w: [w.put(1 << 1, 8)] + [w.put(b, 8) for b in (wide[:10] + bytes(16))[:n]])  # verbatim samples that hold a frame header
    blocks, error = decoded(stream([wide, trap, wide], n, 8, 1))
    assert error is None and len(blocks) == 3


def test_round_trip_and_damage():
    rng = random.Random(4)
    texts = [None, "", "a", "x" * 575, "y" * 576, "z" * 577, "é😀" * 900, "".join(chr(rng.randrange(32, 900)) for _ in range(5000)), "long " * 40000]
    payloads = [flac.payload(t)[1] for t in texts]
    media = flac.encode(payloads)
    assert media[0] == media[1]
    for i, blocks, error in flac.decode(media):
        assert error is None and b"".join(p for _, p in blocks) == payloads[i]
        assert [s for s, _ in blocks] == list(range(0, len(payloads[i]), flac.BLOCK))
    for at in (3, 30, 900, 2500, len(media[7]) - 1):  # marker, MD5, frames
        bad = bytearray(media[7])
        bad[at] ^= 0x10
        assert decoded(bytes(bad))[1]
    assert decoded(media[7][:-300])[1] and decoded(b"")[1]


def test_query_rows(spark):
    texts = [(1, "héllo"), (1, "héllo"), (None, None), (3, "w " * 3000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as media", "2 as error", "3 as feature")
    media = flac.write_media(df)
    rows = flac.digests(media).collect()
    assert len(rows) == 4
    for r, (i, t) in zip(rows, texts):
        raw = (t or "").encode()
        pad = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))
        assert r.error is None and r.media_bytes > 0
    assert rows[0].media_sha256 == rows[1].media_sha256 and rows[0].feature == rows[1].feature
    pcm = flac.read_pcm(media.filter("doc_id = 3")).orderBy("sample_offset").collect()
    assert b"".join(r.pcm for r in pcm).startswith(b"w w ") and [r.sample_offset for r in pcm] == list(range(0, 576 * len(pcm), 576))
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "doc_id long, media binary")
    assert [bool(r.error) for r in flac.digests(broken).collect()] == [True, True] and flac.read_pcm(broken).count() == 0
    assert flac.digests(flac.write_media(df.limit(0))).count() == 0


def test_seek_table_of_a_long_stream(monkeypatch):
    monkeypatch.setattr(flac, "SEEK_POINTS", 10)
    payload = bytes(range(256)) * 9 * 25
    (file,) = flac.encode([payload])
    size = int.from_bytes(file[43:46])
    points = [struct.unpack(">QQH", file[46 + 18 * i : 64 + 18 * i]) for i in range(size // 18)]
    assert len(points) <= 10 and [p[0] for p in points] == list(range(0, len(payload), 576 * (1 + 100 // 10)))
    first = 46 + size
    (_, blocks, error), = flac.decode([file])
    assert not error and b"".join(p for _, p in blocks) == payload
    assert all(file[first + offset : first + offset + 2] == b"\xff\xf8" for _, offset, _ in points)
