"""FLAC media columns: files in a binary column, written and read back as PCM blocks.

The codec works on many frames at once: one numpy row per frame, one step per
sample (reading) or per bit of the Rice parameter (writing). Reading handles
whole FLAC streams: constant, verbatim, fixed and LPC subframes, both Rice
methods with escapes, wasted bits, 1 to 8 channels and stereo decorrelation.
Header CRC-8, frame CRC-16 and the stream's MD5 are verified. Frames are found
through the seek table where it names all of them, else by their sync codes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, RATE = 576, 8000
#: Points that a seek table has room for; of a longer stream every second, third ... frame has one.
SEEK_POINTS = ((1 << 24) - 1) // 18
_PARTS = 4
_FRAMES = 2048
_FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])


class FlacError(ValueError):
    """A stream that is no valid FLAC, or fails a checksum."""


def _crc_table(width: int, poly: int) -> np.ndarray:
    """For each value of a register of ``width`` bits, the register after ``width`` zero bits."""
    reg = np.arange(1 << width, dtype=np.uint32)
    for _ in range(width):
        reg = np.where(reg >> (width - 1) & 1, reg << 1 ^ poly, reg << 1) & ((1 << width) - 1)
    return reg


_CRC8 = _crc_table(8, 0x07).tolist()
_CRC16 = _crc_table(16, 0x8005).astype(np.uint16)


def crc8(data: bytes) -> int:
    reg = 0
    for b in data:
        reg = _CRC8[reg ^ b]
    return reg


def crc16(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of each ``buf[start:start+length]``, two bytes a step."""
    order = np.argsort(-length, kind="stable")
    at, size = start[order], length[order]
    words = buf[:-1].astype(np.uint16) << 8 | buf[1:]
    reg = np.zeros(len(at), np.uint16)
    pairs = size // 2
    for j in range(int(pairs.max(initial=0))):
        n = int(np.searchsorted(-pairs, -j, "left"))
        reg[:n] = _CRC16[reg[:n] ^ words[at[:n] + 2 * j]]
    odd = np.nonzero(size % 2)[0]
    if len(odd):
        last = buf[at[odd] + size[odd] - 1].astype(np.uint16)
        turned = (reg[odd] >> 8) ^ last
        reg[odd] = (reg[odd] << 8) ^ _CRC16[turned]
    out = np.empty_like(reg)
    out[order] = reg
    return out


def _number(n: int) -> bytes:
    """A frame number in the stream's UTF-8-like form (up to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >> (6 * more + 6 - more):
        more += 1
    lead = (0xFF << (7 - more) & 0xFF) | n >> 6 * more
    return bytes([lead, *(0x80 | n >> 6 * i & 0x3F for i in reversed(range(more)))])


@lru_cache(1 << 16)
def _frame_header(number: int) -> bytes:
    head = bytes([0xFF, 0xF8, 0x24, 0x02]) + _number(number)
    return head + bytes([crc8(head)])


def _write_frames(x: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of 8-bit mono samples ``x`` (frames, BLOCK), each with its cheapest fixed predictor."""
    n = len(x)
    heads = [_frame_header(int(i)) for i in numbers]
    head_len = np.fromiter(map(len, heads), np.int64, n)
    flat = (x == x[:, :1]).all(1)
    order, best, d = np.zeros(n, np.int64), np.abs(x[:, 4:]).sum(1), x
    for o in range(1, 5):
        d = np.diff(d, axis=1)
        cost = np.abs(d[:, 4 - o :]).sum(1)
        order[cost < best] = o
        best = np.minimum(best, cost)
    order[flat] = 0
    u = np.zeros((n, BLOCK), np.int32)
    for o in np.unique(order):
        rows = order == o
        r = np.diff(x[rows], n=int(o), axis=1) if o else x[rows]
        u[rows, o:] = r << 1 ^ r >> 31
    size = BLOCK // _PARTS
    held = np.full((n, _PARTS), size)
    held[:, 0] -= order
    mean = u.reshape(n, _PARTS, size).sum(2) / held * 0.7
    k = np.clip(np.frexp(mean)[1] - 1, 0, 14)
    ks = np.repeat(k.astype(np.int32), size, axis=1)
    coded = (np.arange(BLOCK) >= order[:, None]) & ~flat[:, None]
    q = u >> ks
    bits = (q + 1 + ks) * coded
    ends = np.cumsum(bits, axis=1, dtype=np.int64)
    first_bit = 8 * (head_len + 1 + order)
    total = np.where(flat, 8 * (head_len + 2), first_bit + 6 + 4 * _PARTS + ends[:, -1])
    length = (total + 7) // 8
    start = np.cumsum(length + 2) - length - 2
    out = np.zeros(int((length + 2).sum()) * 8, np.uint8)
    base = start * 8 + first_bit
    last = base[:, None] + 6 + 4 * (np.arange(BLOCK) // size + 1) + ends - 1
    last, u, ks = last[coded], u[coded], ks[coded]
    out[last - ks] = 1
    for j in range(int(ks.max(initial=0))):
        out[last[(ks > j) & (u >> j & 1 == 1)] - j] = 1
    real = ~flat
    out[base[real] + 4] = 1
    begun = np.concatenate([np.zeros((n, 1), np.int64), ends[:, size - 1 : -1 : size]], axis=1)
    for p in range(_PARTS):
        for j in range(4):
            on = real & (k[:, p] >> j & 1 == 1)
            out[base[on] + 6 + 4 * p + begun[on, p] + 3 - j] = 1
    packed = np.packbits(out)
    gone = np.cumsum(head_len) - head_len
    packed[np.arange(int(head_len.sum())) + np.repeat(start - gone, head_len)] = np.frombuffer(b"".join(heads), np.uint8)
    packed[start + head_len] = np.where(flat, 0, (8 | order) << 1)
    packed[(start + head_len + 1)[flat]] = x[flat, 0] & 0xFF
    for i in range(4):
        on = order > i
        packed[(start + head_len + 1 + i)[on]] = x[on, i] & 0xFF
    check = crc16(packed, start, length)
    packed[start + length] = check >> 8
    packed[start + length + 1] = check & 0xFF
    raw = packed.tobytes()
    return [raw[a : a + m] for a, m in zip(start.tolist(), (length + 2).tolist(), strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of unsigned 8-bit samples; each payload is a positive multiple of BLOCK long."""
    counts = [len(p) // BLOCK for p in payloads]
    x = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, int)
    frames: list[bytes] = []
    for a in range(0, len(x), _FRAMES):
        frames += _write_frames(x[a : a + _FRAMES].astype(np.int32) - 128, numbers[a : a + _FRAMES])
    out, at = [], 0
    for payload, count in zip(payloads, counts, strict=True):
        own, at = frames[at : at + count], at + count
        sizes = np.fromiter(map(len, own), np.int64, count)
        points = np.zeros(count, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"], points["offset"], points["n"] = np.arange(count) * BLOCK, np.cumsum(sizes) - sizes, BLOCK
        md5 = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3) + int(sizes.max()).to_bytes(3) + (RATE << 44 | 7 << 36 | count * BLOCK).to_bytes(8) + md5
        table = points[:: 1 + len(points) // SEEK_POINTS].tobytes()
        out.append(b"fLaC" + bytes([0, 0, 0, 34]) + info + bytes([0x83]) + len(table).to_bytes(3) + table + b"".join(own))
    return out


_SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


@lru_cache(1 << 16)
def _parse_header(head: bytes, bps: int, channels: int) -> tuple[int, int, int, int, int] | None:
    """(bytes, samples, channels, sample bits, channel code) of a frame header; None where it is none."""
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8 or head[3] & 1:
        return None
    size, rate, code, width = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    lead = head[4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    at = 5 + more
    if not size or rate == 15 or code > 10 or width == 3 or (lead >= 0x80 and not 1 <= more <= 6):
        return None
    if size == 1:
        n = 192
    elif size < 6:
        n = 144 << size
    elif size < 8:
        n, at = int.from_bytes(head[at : at + size - 5]) + 1, at + size - 5
    else:
        n = 1 << size
    at += (rate == 12) + 2 * (rate in (13, 14))
    if at >= len(head) or crc8(head[:at]) != head[at]:
        return None
    return at + 1, n, code + 1 if code < 8 else 2, _SIZES.get(width, bps), code


class _Bits:
    """Bit reads at many positions of one buffer."""

    def __init__(self, data: np.ndarray):
        pad = np.concatenate([data, np.zeros(16, np.uint8)])
        n = len(data) + 8
        self.windows = np.zeros(n, np.uint64)
        for i in range(8):
            self.windows |= pad[i : i + n].astype(np.uint64) << np.uint64(56 - 8 * i)
        self.end = 8 * len(data)

    def window(self, at: np.ndarray) -> np.ndarray:
        return self.windows.take(at >> 3, mode="clip") << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Unsigned values of ``n`` (0 to 33) bits."""
        n = np.asarray(n, np.uint64)
        return (self.window(at) >> np.uint64(1) >> (np.uint64(63) - n)).astype(np.int64)

    def signed(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        v, n = self.read(at, n), np.asarray(n, np.int64)
        return v - ((v >> np.maximum(n - 1, 0) & (n > 0)) << n)


def _leading_zeros(w: np.ndarray) -> np.ndarray:
    """Zeros before the first one in the upper 32 bits; 32 where there is none."""
    return 32 - np.frexp((w >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)


def _unary(bits: _Bits, at: np.ndarray) -> np.ndarray:
    """Zeros before the next one at each position (up to the buffer's end)."""
    q = _leading_zeros(bits.window(at))
    more = np.nonzero(q == 32)[0]
    while len(more):
        here = at[more] + q[more]
        more = more[here < bits.end]
        if not len(more):
            break
        z = _leading_zeros(bits.window(at[more] + q[more]))
        q[more] += z
        more = more[z == 32]
    return q


def _residuals(bits: _Bits, at: np.ndarray, order: np.ndarray, n: int, good: np.ndarray) -> np.ndarray:
    """Rice residuals (n, frames); rows before a frame's order stay 0. ``at`` moves on, ``good`` loses bad frames."""
    res = np.zeros((n, len(at)), np.int64)
    method = bits.read(at, 2)
    parts = bits.read(at + 2, 4)
    at += 6
    good &= (method < 2) & (n % (1 << parts) == 0) & (n >> parts >= order)
    size = np.where(good, n >> np.where(good, parts, 0), n)
    width = 4 + (method == 1)
    k, raw = np.zeros(len(at), np.int64), np.full(len(at), -1)
    due = np.where(good, 0, n + 1)
    ready, some = np.zeros(len(at), bool), False
    for i in range(n):
        turn = np.nonzero(due == i)[0]
        if len(turn):
            p = bits.read(at[turn], width[turn])
            at[turn] += width[turn]
            esc = p == (1 << width[turn]) - 1
            raw[turn] = np.where(esc, bits.read(at[turn], 5), -1)
            at[turn] += 5 * esc
            k[turn] = np.where(esc, 0, p)
            due[turn] += size[turn]
            ready = raw >= 0
            some = bool(ready.any())
        live = (i >= order) & good
        every = bool(live.all())
        w = bits.window(at)
        q = _leading_zeros(w)
        if (q >= 24).any():
            q = _unary(bits, at)
            low = bits.read(np.minimum(at + q + 1, bits.end), k)
        else:
            low = (w << (q + 1).astype(np.uint64) >> np.uint64(1) >> (63 - k).astype(np.uint64)).astype(np.int64)
        u = q << k | low
        step = q + 1 + k
        r = u >> 1 ^ -(u & 1)
        if some:
            r = np.where(ready, bits.signed(at, np.maximum(raw, 0)), r)
            step = np.where(ready, raw, step)
        if every:
            at += step
            res[i] = r
        else:
            at += step * live
            res[i] = r * live
        if i % 64 == 63:
            good &= at <= bits.end
            np.minimum(at, bits.end, out=at)
    good &= at <= bits.end
    np.minimum(at, bits.end, out=at)
    return res


def _restore(x: np.ndarray, res: np.ndarray, order: int, coef: np.ndarray, shift: np.ndarray | None) -> None:
    """Fill ``x`` (samples, frames) after its warm-up rows from residuals and predictors (order, frames)."""
    for i in range(order, len(x)):
        guess = coef[0] * x[i - 1]
        for j in range(1, order):
            guess = guess + coef[j] * x[i - 1 - j]
        x[i] = res[i] + (guess if shift is None else guess >> shift)


def _subframes(bits: _Bits, at: np.ndarray, bps: np.ndarray, n: int, good: np.ndarray) -> np.ndarray:
    """One channel's samples (n, frames) of frames of ``n`` samples; ``at`` moves on."""
    out = np.zeros((n, len(at)), np.int64)
    head = bits.read(at, 8)
    good &= head < 128
    kind, at[:] = head >> 1 & 63, at + 8
    wasted = np.where(head & 1, _unary(bits, at) + 1, 0)
    at += wasted
    bps = bps - wasted
    good &= (bps > 0) & ((kind < 2) | (8 <= kind) & (kind <= 12) | (kind >= 32)) & (at < bits.end)
    bps = np.where(good, bps, 1)
    for code in np.unique(kind[good]):
        mine = np.nonzero((kind == code) & good)[0]
        pos, b, ok = at[mine], bps[mine], np.ones(len(mine), bool)
        if code == 0:
            out[:, mine] = bits.signed(pos, b)
            pos += b
        elif code == 1:
            for i in range(n):
                out[i, mine] = bits.signed(np.minimum(pos, bits.end), b)
                pos += b
        else:
            order = int(code) - 8 if code < 32 else int(code) - 31
            ok &= order <= n
            x = np.zeros((n, len(mine)), np.int64)
            for i in range(min(order, n)):
                x[i] = bits.signed(np.minimum(pos, bits.end), b)
                pos += b
            shift = None
            coef = np.tile(np.array(_FIXED[order], np.int64)[:, None], len(mine)) if code < 32 else np.zeros((order, len(mine)), np.int64)
            if code >= 32:
                np.minimum(pos, bits.end, out=pos)
                precision, shift = bits.read(pos, 4) + 1, bits.signed(pos + 4, 5)
                ok &= (precision < 16) & (shift >= 0)
                shift, pos = np.maximum(shift, 0), pos + 9
                for j in range(order):
                    coef[j] = bits.signed(np.minimum(pos, bits.end), precision)
                    pos += precision
            np.minimum(pos, bits.end, out=pos)
            res = _residuals(bits, pos, np.full(len(mine), min(order, n)), n, ok)
            if order == 0:
                x = res
            else:
                _restore(x, res, order, coef, shift)
            out[:, mine] = x
        good[mine] &= ok & (pos <= bits.end)
        at[mine] = np.minimum(pos, bits.end)
    return out << np.minimum(wasted, 32)


def _decode_frames(data: np.ndarray, starts: list[int], heads: list[tuple]) -> list[tuple[bytes, int] | None]:
    """PCM and end of each frame of equal sample count; None where it is broken or its CRC-16 differs."""
    n = heads[0][1]
    bits = _Bits(data)
    start = np.array(starts, np.int64)
    at = 8 * (start + np.array([h[0] for h in heads]))
    channels, width, code = (np.array([h[i] for h in heads]) for i in (2, 3, 4))
    good = np.ones(len(start), bool)
    found = []
    for c in range(int(channels.max())):
        side = (c == 1) & ((code == 8) | (code == 10)) | (c == 0) & (code == 9)
        mine = np.nonzero(channels > c)[0]
        pos, ok = at[mine], good[mine]
        x = _subframes(bits, pos, (width + side)[mine], n, ok)
        at[mine], good[mine] = pos, ok
        if len(mine) < len(start):
            whole = np.zeros((n, len(start)), np.int64)
            whole[:, mine] = x
            x = whole
        found.append(x)
    for c, fix in ((8, lambda a, b: (a, a - b)), (9, lambda a, b: (a + b, b)), (10, lambda a, b: (((a << 1 | b & 1) + b) >> 1, ((a << 1 | b & 1) - b) >> 1))):
        m = code == c
        if m.any():
            found[0][:, m], found[1][:, m] = fix(found[0][:, m], found[1][:, m])
    end = (at + 7) // 8
    good &= end + 2 <= len(data)
    safe = np.where(good, end, start)
    check = crc16(data, start, safe - start)
    tail = np.concatenate([data, np.zeros(2, np.uint8)])
    good &= check == (tail[safe].astype(np.uint16) << 8 | tail[safe + 1])
    if len(found) == 1 and (width == 8).all():
        pcm = (found[0] + 128).astype(np.uint8).T.tobytes()
        return [(pcm[i * n : i * n + n], e + 2) if g else None for i, (g, e) in enumerate(zip(good.tolist(), end.tolist(), strict=True))]
    out: list[tuple[bytes, int] | None] = []
    for i in range(len(start)):
        x = np.stack([f[:, i] for f in found[: channels[i]]], axis=1)
        size = (int(width[i]) + 7) // 8
        raw = (x + 128).astype(np.uint8).tobytes() if size == 1 else x.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :size].tobytes()
        out.append((raw, int(end[i]) + 2) if good[i] else None)
    return out


def _metadata(media: bytes) -> tuple[dict, list[int], int]:
    """(stream information, seek offsets, first frame's place) of a stream."""
    if media[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    info, points, at, last = None, [], 4, False
    while not last:
        if at + 4 > len(media):
            raise FlacError("metadata ends early")
        last, kind, size = media[at] >> 7, media[at] & 127, int.from_bytes(media[at + 1 : at + 4])
        body, at = media[at + 4 : at + 4 + size], at + 4 + size
        if kind == 0 and size >= 34:
            packed = int.from_bytes(body[10:18])
            info = {"channels": (packed >> 41 & 7) + 1, "bps": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34], "rate": packed >> 44}
        elif kind == 3:
            seek = np.frombuffer(body[: size // 18 * 18], np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
            seek = seek[seek["sample"] != 0xFFFFFFFFFFFFFFFF]
            ends = np.cumsum(seek["n"].astype(np.int64))
            if info and len(seek) and int(ends[-1]) == info["samples"] and (seek["sample"].astype(np.int64) == ends - seek["n"]).all():
                points = seek["offset"].astype(np.int64).tolist()
    if info is None:
        raise FlacError("no stream information")
    return info, points, at


def decode(files: list[bytes]) -> Iterator[tuple[int, list[tuple[int, bytes]], str | None]]:
    """For each file: its place in ``files``, PCM blocks with their sample offsets, an error or None.

    Blocks are interleaved little-endian; 8-bit samples are unsigned, as in WAV.
    """
    waiting: list[tuple[int, dict, list[int], int, bool]] = []
    held = 0
    for i, media in enumerate(files):
        try:
            info, points, first = _metadata(media)
        except FlacError as e:
            yield i, [], str(e)
            continue
        if points:
            starts = [first + p for p in points]
        else:
            raw = np.frombuffer(media, np.uint8)
            seen = np.nonzero((raw[first:-1] == 0xFF) & (raw[first + 1 :] & 0xFE == 0xF8))[0] + first
            starts = [s for s in seen.tolist() if _parse_header(media[s : s + 16], info["bps"], info["channels"])]
        waiting.append((i, info, starts, first, bool(points)))
        held += len(starts)
        if held >= _FRAMES:
            yield from _decoded(files, waiting)
            waiting, held = [], 0
    if waiting:
        yield from _decoded(files, waiting)


def _decoded(files: list[bytes], waiting: list) -> Iterator[tuple[int, list[tuple[int, bytes]], str | None]]:
    got: list[dict[int, tuple[bytes, int, int, int] | None]] = [{} for _ in waiting]
    groups: dict[int, list[tuple[int, int, tuple]]] = {}
    for w, (i, info, starts, *_) in enumerate(waiting):
        media = files[i]
        for s in starts:
            head = _parse_header(media[s : s + 16], info["bps"], info["channels"])
            got[w][s] = None
            if head:
                groups.setdefault(head[1], []).append((w, s, head))
    for n, members in groups.items():
        for a in range(0, len(members), max(1, _FRAMES * BLOCK // n)):
            part = members[a : a + max(1, _FRAMES * BLOCK // n)]
            base, pieces, size = {}, [], 0
            for w, s, _ in part:  # of a file whose frames fill several parts, only the stretch with these frames
                lo, hi = base.get(w, (s, s))
                base[w] = (min(lo, s), max(hi, s))
            moved = {}
            for w, (lo, hi) in base.items():
                i, _, starts, _, listed = waiting[w]
                after = bisect(starts, hi)
                stop = starts[after] if listed and after < len(starts) else len(files[i])
                moved[w] = size - lo
                pieces.append(files[i][lo:stop])
                size += stop - lo
            data = np.frombuffer(b"".join(pieces), np.uint8)
            for (w, s, head), x in zip(part, _decode_frames(data, [s + moved[w] for w, s, _ in part], [h for *_, h in part]), strict=True):
                got[w][s] = x and (x[0], x[1] - moved[w], head[1], head[3])
    for w, (i, info, _, first, _) in enumerate(waiting):
        media, at, sample, blocks, error = files[i], first, 0, [], None
        md5 = hashlib.md5()
        while at < len(media) and (not info["samples"] or sample < info["samples"]):
            frame = got[w].get(at)
            if frame is None:
                error = f"no valid frame at byte {at}"
                break
            pcm, at, n, bits = frame
            blocks.append((sample, pcm))
            sample += n
            md5.update((np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes() if bits <= 8 else pcm)
        if not error and info["samples"] and sample != info["samples"]:
            error = f"{sample} of {info['samples']} samples"
        if not error and any(info["md5"]) and md5.digest() != info["md5"]:
            error = "MD5 of the samples differs"
        yield i, blocks, error


MEDIA = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
DIGEST = T.StructType([T.StructField(n, t()) for n, t in (("payload_bytes", T.LongType), ("payload_sha256", T.StringType), ("tail_crc32", T.LongType), ("media_bytes", T.LongType), ("media_sha256", T.StringType), ("feature", T.StringType), ("error", T.StringType))])


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * ((-len(raw)) % BLOCK or (0 if raw else BLOCK))


def _groups(sizes: list[int], most: int = 4 << 20) -> Iterator[slice]:
    """Slices of a batch of about ``most`` bytes each: what is held at once, however long a batch is."""
    a = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield slice(a, i + 1)
            a, total = i + 1, 0
    if a < len(sizes):
        yield slice(a, len(sizes))


@F.pandas_udf(MEDIA)
def encode_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        lengths, media = [], []
        values = texts.tolist()
        for part in _groups([len(x or "") for x in values]):
            made = [payload(x) for x in values[part]]
            lengths += [n for n, _ in made]
            media += encode([p for _, p in made])
        yield pd.DataFrame({"n_bytes": pd.Series(lengths, dtype="int64"), "media": pd.Series(media, dtype=object)})


def _feature(pcm: bytes) -> str:
    """peak:zero crossings:energy:sum of steps of unsigned 8-bit PCM, all whole numbers."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    if not len(x):
        return "0:0:0:0"
    return f"{np.abs(x).max()}:{np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))}:{int(x @ x)}:{np.abs(np.diff(x)).sum()}"


def digest(media: list[bytes | None]) -> list[tuple]:
    """The DIGEST fields of each file, from the PCM read back; an unreadable file has an error and nulls."""
    out: list = [(None,) * 6 + ("null file",) if m is None else None for m in media]
    there = [i for i, m in enumerate(media) if m is not None]
    for j, blocks, error in decode([media[i] for i in there]):
        i = there[j]
        file = media[i]
        head = (len(file), hashlib.sha256(file).hexdigest())
        if error:
            out[i] = (None, None, None, *head, None, error)
        else:
            pcm = b"".join(p for _, p in blocks)
            out[i] = (len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-32:]), *head, _feature(pcm), None)
    return out


@F.pandas_udf(DIGEST)
def digest_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for files in batches:
        values = files.tolist()
        rows = [r for part in _groups([len(m or b"") for m in values]) for r in digest(values[part])]
        yield pd.DataFrame(rows, columns=DIGEST.fieldNames()).astype({"payload_bytes": "Int64", "tail_crc32": "Int64", "media_bytes": "Int64"})


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_bytes``, ``media``: each whole text as a FLAC file of 8-bit mono samples.

    A null text is as an empty one; both give one block of padding. Equal texts
    give equal files. Rows keep their ids, repeated or null; other columns are
    not read. An empty table gives an empty one.
    """
    made = docs.select(F.col(id_col), encode_udf(F.col(text_col)).alias("made"))
    return made.select(id_col, "made.n_bytes", "made.media")


def read_pcm(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``id``, ``sample_offset``, ``n_bytes``, ``pcm``: a row per frame of each file, to seek by sample.

    Files that are null, damaged or fail a checksum give no row.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            there = part[part.iloc[:, 1].notna()]
            ids, values = there.iloc[:, 0].tolist(), there.iloc[:, 1].tolist()
            for some in _groups([len(m) for m in values]):  # so a batch of large files is never decoded whole
                own = ids[some]
                rows = [(own[j], s, len(p), p) for j, found, error in decode(values[some]) if not error for s, p in found]
                yield pd.DataFrame(rows, columns=["id", "sample_offset", "n_bytes", "pcm"])

    found = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInPandas(blocks, f"id {kind}, sample_offset long, n_bytes long, pcm binary")
    return found.withColumnRenamed("id", id_col)


def digests(media: DataFrame, media_col: str = "media") -> DataFrame:
    """``media`` with the DIGEST fields of each file in place of its bytes."""
    kept = [c for c in media.columns if c != media_col and c not in DIGEST.fieldNames()]
    return media.select(*kept, digest_udf(F.col(media_col)).alias("read")).select(*kept, "read.*")
