"""FLAC media columns: lossless coding of PCM payloads and decoding to PCM blocks.

Streams follow the published FLAC format: STREAMINFO with the MD5 of the samples, a SEEKTABLE
with a point for each frame, and frames with CRC-8 and CRC-16. The writer makes mono streams of
8-bit samples (byte - 128); each frame takes the shortest of a constant, verbatim samples, fixed predictors of order 0 to 2 and
a linear predictor of order LPC, with one Rice parameter or one for each quarter. The reader takes any
native FLAC stream of up to 24 bits: constant, verbatim, fixed and LPC subframes, Rice codes with
4- and 5-bit parameters, partitions and escapes, wasted bits, and stereo decorrelation.

All frames of a batch are coded side by side: one numpy step handles a sample of each frame.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import byte_values, chunks, documents

BLOCK = 1024
RATE = 8000
#: Order of linear predictors, and bits of their coefficients.
LPC = 8
PRECISION = 10
#: Payload bytes whose frames are decoded side by side; a longer payload is decoded in several goes.
AT_ONCE = 1_500_000
#: Frames that are encoded side by side.
FRAMES_AT_ONCE = 256


class FlacError(ValueError):
    """A stream that isn't FLAC, is cut off, or fails a checksum."""


def _crc_table(bits: int, poly: int) -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for i in range(256):
        x = i << (bits - 8)
        for _ in range(8):
            x = ((x << 1) ^ poly) if x >> (bits - 1) else x << 1
            x &= (1 << bits) - 1
        out[i] = x
    return out


_CRC8 = [int(x) for x in _crc_table(8, 0x07)]
_CRC16 = _crc_table(16, 0x8005).astype(np.uint16)


def crc8(data: bytes) -> int:
    x = 0
    for b in data:
        x = _CRC8[x ^ b]
    return x


@lru_cache(maxsize=1)
def _crc16_by_distance(length: int) -> np.ndarray:
    """Row d: the CRC-16 of each byte value followed by d zero bytes."""
    table = np.empty((length, 256), np.uint16)
    table[0] = _CRC16
    for d in range(1, length):
        table[d] = (table[d - 1] << 8) ^ _CRC16[table[d - 1] >> 8]
    return table


def crc16s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each range of bytes; it is linear, so it is the xor of what each byte adds."""
    out = np.zeros(len(starts), np.uint16)
    sizes = ends - starts
    table = _crc16_by_distance(1 << max(11, int(sizes.max(initial=1) - 1).bit_length()))
    for i in range(0, len(starts), 512):
        n = sizes[i : i + 512]
        last = np.repeat(np.cumsum(n), n)
        at = np.arange(len(last))
        source = np.repeat(starts[i : i + 512] - (np.cumsum(n) - n), n) + at
        part = table[last - at - 1, data[source]]
        out[i : i + 512] = np.bitwise_xor.reduceat(part, np.cumsum(n) - n)
    return out


@lru_cache(maxsize=65536)
def _frame_header(number: int, size: int) -> bytes:
    if number < 128:
        coded = bytes([number])
    else:
        n = 2
        while number >= 1 << (5 * n + 1):
            n += 1
        coded = bytes([(0xFF00 >> n) & 0xFF | number >> 6 * (n - 1)]) + bytes(0x80 | (number >> 6 * j) & 63 for j in reversed(range(n - 1)))
    full = size == BLOCK
    head = bytes([0xFF, 0xF8, (0xA0 if full else 0x70) | 0x04, 0x02]) + coded + (b"" if full else (size - 1).to_bytes(2, "big"))
    return head + bytes([crc8(head)])


def encode(payloads: list[bytes]) -> list[bytes]:
    """One FLAC stream for each payload; an empty one has no frames."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    lens = np.array([len(x) for x in payloads], np.int64)
    frames = -(-lens // BLOCK)
    owner = np.repeat(np.arange(len(lens)), frames)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(frames) - frames, frames)
    start = np.repeat(np.cumsum(lens) - lens, frames) + number * BLOCK
    size = np.minimum(BLOCK, lens[owner] - number * BLOCK)
    parts, offsets = [], [np.zeros(1, np.int64)]
    for i in range(0, len(owner), FRAMES_AT_ONCE):
        own = slice(i, i + FRAMES_AT_ONCE)
        a = int(start[own][0])
        x = data[a : int(start[own][-1] + size[own][-1])].astype(np.int32) - 128
        part, ends = _encode_frames(x, start[own] - a, size[own], number[own])
        parts.append(part)
        offsets.append(offsets[-1][-1] + ends[1:])
    bodies, offsets = b"".join(parts), np.concatenate(offsets)
    out, first = [], np.concatenate([[0], np.cumsum(frames)])
    for i, payload in enumerate(payloads):
        a, b = first[i], first[i + 1]
        longest = np.diff(offsets[a : b + 1])
        info = BLOCK.to_bytes(2, "big") * 2 + int(longest.min(initial=1 << 20) if b > a else 0).to_bytes(3, "big") + int(longest.max(initial=0)).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big")
        info += hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
        points = np.zeros(b - a, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
        points["sample"], points["offset"], points["size"] = number[a:b] * BLOCK, offsets[a:b] - offsets[a], size[a:b]
        seek = points.tobytes()
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + bodies[offsets[a] : offsets[b]])
    return out


def _predictors(x: np.ndarray, at: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x LPC coefficients, shifts): quantised linear predictors from each frame's windowed autocorrelation."""
    w = (x * np.sin((at + 0.5) * np.repeat(np.pi / size, size))).astype(np.float32)
    r = np.empty((LPC + 1, len(size)))
    r[0] = np.add.reduceat(w * w, start, dtype=np.float64) * (1 + 1e-6) + 1e-6
    for lag in range(1, LPC + 1):
        part = np.zeros(len(w), np.float32)
        np.multiply(w[lag:], w[:-lag], out=part[lag:])
        part[at < lag] = 0
        r[lag] = np.add.reduceat(part, start, dtype=np.float64)
    a, error = np.zeros((LPC, len(size))), r[0].copy()
    for i in range(LPC):  # Levinson and Durbin, all frames at once
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(axis=0)) / error
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        error *= np.maximum(1 - k * k, 1e-9)
    top = np.frexp(np.abs(a).max(axis=0))[1]
    shift = np.clip(PRECISION - 1 - top, 0, 15)
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * np.exp2(shift)), -most - 1, most).astype(np.int64).T, shift


def _rice(u: np.ndarray, starts: np.ndarray, sizes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parameter, bits) of each stretch of codes u; count of its values are coded, the others are 0."""
    mean = np.maximum(np.add.reduceat(u, starts) / np.maximum(count, 1), 1)
    best, k = np.full(len(sizes), 1 << 60, np.int64), np.zeros(len(sizes), np.int64)
    for less in (0, 1):
        trial = np.clip(np.floor(np.log2(mean)).astype(np.int64) - less, 0, 14)
        bits = np.add.reduceat(u >> np.repeat(trial, sizes), starts) + count * (1 + trial)
        k, best = np.where(bits < best, trial, k), np.minimum(bits, best)
    return k, best


def _encode_frames(x: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The frames one after the other, and their offsets (one more than frames). Frames cover x in order."""
    at = np.arange(len(x)) - np.repeat(start, size)
    one = np.diff(x, prepend=0)
    coef, shift = _predictors(x, at, start, size)
    guess = np.zeros(len(x), np.int32)
    for j in range(LPC):
        guess[j + 1 :] += np.repeat(coef[:, j].astype(np.int32), size)[j + 1 :] * x[: -j - 1]
    errors, costs = [x, one, np.diff(one, prepend=0), x - (guess >> np.repeat(shift.astype(np.int32), size))], []
    orders, extra = np.array([0, 1, 2, LPC]), np.array([0, 0, 0, 9 + LPC * PRECISION])
    for order, more, e in zip(orders, extra, errors, strict=True):
        total, n = np.add.reduceat(np.where(at >= order, np.abs(e), 0), start), np.maximum(size - order, 1)
        costs.append(n * (np.log2(2 * total / n + 1) + 1) + 8 * order + more + np.where(size > 2 * order, 0, 1 << 40) * (order > 2))
    kind = np.argmin(costs, axis=0)
    order, linear = orders[kind], kind == 3
    own = np.repeat(order, size)
    e = np.choose(np.repeat(kind, size), errors)
    code = at >= own  # the samples before are stored as they are
    u = np.where(code, (e << 1) ^ (e >> 31), 0).astype(np.int64)
    k, bits = _rice(u, start, size, size - order)
    # quarters with parameters of their own
    fits = (size % 4 == 0) & (size >= 4 * LPC + 4)
    edges = size[:, None] * np.arange(5) // 4
    quarters = np.maximum(np.diff(edges, axis=1), 0)
    kq, bq = _rice(u, np.minimum((start[:, None] + edges[:, :4]).ravel(), len(u) - 1), quarters.ravel(), (quarters - np.where(np.arange(4) == 0, order[:, None], 0)).ravel())
    kq, bq = kq.reshape(-1, 4), bq.reshape(-1, 4).sum(axis=1) + 12
    parts = fits & (bq < bits)
    bits = np.where(parts, bq, bits) + 8 * order + np.where(linear, extra[3], 0) + 10
    flat = np.add.reduceat(np.where(at > 0, one != 0, False).astype(np.int64), start) == 0
    raw = ~flat & (bits >= 8 * size)
    rice = ~flat & ~raw
    body = np.where(flat, 1, np.where(raw, size, (bits + 7) // 8))
    heads = [_frame_header(int(n), int(s)) for n, s in zip(number, size, strict=True)]
    head = np.array([len(h) for h in heads])
    total = head + 1 + body + 2
    offsets = np.concatenate([[0], np.cumsum(total)])
    into = (offsets[:-1] + head + 1) * 8  # the bit where warm-up samples begin

    fields: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (bit, bits, value)
    put = lambda where, n, value: fields.append((where, np.broadcast_to(n, len(where)), value))
    for j in range(LPC):
        has = rice & (order > j)
        put(into[has] + 8 * j, 8, x[start[has] + j] & 255)
    has = rice & linear
    place = into[has] + 8 * LPC
    put(place, 9, (PRECISION - 1 << 5) + shift[has])
    for j in range(LPC):
        put(place + 9 + PRECISION * j, PRECISION, coef[has, j] & (1 << PRECISION) - 1)
    codes = into + 8 * order + np.where(linear, extra[3], 0)
    put(codes[rice], 6, np.where(parts[rice], 2, 0))
    code &= np.repeat(rice, size)
    quarter = np.repeat(kq.ravel(), quarters.ravel()) if quarters.sum() == len(u) else np.repeat(k, size)
    kk = np.where(np.repeat(parts, size), quarter, np.repeat(k, size))[code]
    # where a parameter stands before a code
    lead = at == own
    begins = (start[:, None] + edges[:, 1:4])[parts].ravel()
    lead[begins] = True
    lead = lead[code]
    uu = u[code]
    length = (uu >> kk) + 1 + kk + 4 * lead
    ends = np.cumsum(length)
    coded = np.where(rice, size - order, 0)
    before = np.concatenate([[0], ends])[np.cumsum(coded) - coded]
    ends = ends + np.repeat(codes + 6 - before, coded)
    put((ends - length)[lead], 4, kk[lead])
    put(ends - kk - 1, kk + 1, (np.int64(1) << kk) | (uu & ((np.int64(1) << kk) - 1)))  # the stop bit and the bits after it
    where, n, value = (np.concatenate(f) for f in zip(*fields, strict=True))
    value = value.astype(np.uint64) << (64 - (where & 31) - n).astype(np.uint64)
    words = int(offsets[-1]) // 4 + 3
    sums = np.bincount(where >> 5, (value >> np.uint64(32)).astype(np.float64), words) + np.bincount((where >> 5) + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    buf = sums.astype(np.uint32).astype(">u4").view(np.uint8)[: offsets[-1]].copy()

    for i, h in enumerate(heads):
        buf[offsets[i] : offsets[i] + len(h)] = np.frombuffer(h, np.uint8)
    into = into // 8
    buf[into - 1] = np.where(flat, 0, np.where(raw, 1, np.where(linear, 31 + LPC, 8 + order))) << 1
    buf[into[flat]] = x[start[flat]].astype(np.uint8)
    for i in np.flatnonzero(raw):
        buf[into[i] : into[i] + size[i]] = x[start[i] : start[i] + size[i]].astype(np.uint8)
    sums = crc16s(buf, offsets[:-1], offsets[1:] - 2)
    buf[offsets[1:] - 2], buf[offsets[1:] - 1] = sums >> 8, sums & 255
    return buf.tobytes(), offsets


class _Bits:
    """Bytes of many streams, read at many bit positions at once."""

    def __init__(self, data: bytes):
        self.raw = data + bytes(16)
        self.u8 = np.frombuffer(self.raw, np.uint8)
        n = len(data) + 8
        self.wide = np.zeros(n, np.uint64)
        for i in range(8):
            self.wide = (self.wide << np.uint64(8)) | self.u8[i : i + n]
        some = np.flatnonzero(self.u8)
        self.some = np.append(some, len(self.raw))

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """64 bits, of which the first 57 at least are right."""
        return self.wide[np.minimum(pos >> 3, len(self.wide) - 1)] << (pos & 7).astype(np.uint64)

    def take(self, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
        return ((self.peek(pos) >> np.uint64(1)) >> (63 - n).astype(np.uint64)).astype(np.int64)

    def zeros(self, pos: np.ndarray) -> np.ndarray:
        """Zero bits before the next one bit."""
        e = np.frexp((self.peek(pos) >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
        out = 32 - e
        for i in np.flatnonzero(e == 0):
            p = int(pos[i])
            rest = self.raw[p >> 3] & (255 >> (p & 7))
            byte = p >> 3 if rest else int(self.some[np.searchsorted(self.some, (p >> 3) + 1)])
            if byte >= len(self.raw):
                raise FlacError("cut off in a code")
            out[i] = byte * 8 + 8 - (rest or self.raw[byte]).bit_length() - p
        return out

    def one(self, pos: int, n: int) -> int:
        end = pos + n
        x = int.from_bytes(self.raw[pos >> 3 : (end + 7) >> 3], "big")
        return (x >> (-end & 7)) & ((1 << n) - 1)

    def signed(self, pos: int, n: int) -> int:
        x = self.one(pos, n)
        return x - (1 << n) if n and x >> (n - 1) else x


def _residuals(bits: _Bits, pos: np.ndarray, n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each lane the coded prediction errors from pos on. Returns (steps x lanes, positions behind)."""
    lanes = len(pos)
    wide = np.array([4 + bits.one(int(p), 2) for p in pos], np.int64)
    if (wide > 5).any():
        raise FlacError("reserved residual coding")
    parts = np.array([bits.one(int(p) + 2, 4) for p in pos], np.int64)
    pos = pos + 6
    by = n >> parts
    count = n - order
    k, raw = np.zeros(lanes, np.int64), np.zeros(lanes, bool)
    left_to = by - order  # the step at which the next partition begins
    if (left_to < 0).any():
        raise FlacError("partition shorter than the predictor")
    out = np.zeros((int(count.max(initial=0)), lanes), np.int64)
    turn = np.arange(lanes)

    def params(which: np.ndarray) -> None:
        k[which] = bits.take(pos[which], wide[which])
        pos[which] += wide[which]
        raw[which] = k[which] == (1 << wide[which]) - 1
        esc = which[raw[which]]
        k[esc] = bits.take(pos[esc], np.full(len(esc), 5))
        pos[esc] += 5

    params(turn)
    for empty in turn[left_to == 0]:  # a first partition without a code
        while left_to[empty] == 0 and count[empty] > 0:
            left_to[empty] += by[empty]
            params(np.array([empty]))
    for s in range(len(out)):
        live = int(np.searchsorted(-count, -s, side="left"))  # lanes are sorted, longest first
        due = np.flatnonzero(left_to[:live] == s)
        if len(due):
            params(due)
            left_to[due] += by[due]
        p, kk = pos[:live], k[:live]
        if raw[:live].any():
            esc, own = np.flatnonzero(raw[:live]), np.flatnonzero(~raw[:live])
            x = bits.take(p[esc], kk[esc])
            x = np.where(x >> np.maximum(kk[esc] - 1, 0) & 1, x - (np.int64(1) << kk[esc]), x)
            out[s, esc] = np.where(kk[esc] == 0, 0, x)
            pos[esc] += kk[esc]
            if len(own):
                q = bits.zeros(p[own])
                u = (q << kk[own]) | bits.take(p[own] + q + 1, kk[own])
                out[s, own] = (u >> 1) ^ -(u & 1)
                pos[own] += q + 1 + kk[own]
            continue
        q = bits.zeros(p)
        u = (q << kk) | bits.take(p + q + 1, kk)
        out[s, :live] = (u >> 1) ^ -(u & 1)
        pos[:live] += q + 1 + kk
    return out, pos


def _subframes(bits: _Bits, pos: list[int], size: list[int], depth: list[int]) -> tuple[list[np.ndarray], list[int]]:
    """Samples of one subframe of each lane, and the positions behind."""
    out: list = [None] * len(pos)
    behind = list(pos)
    coded = []
    for i, (p, n, d) in enumerate(zip(pos, size, depth, strict=True)):
        head = bits.one(p, 8)
        p += 8
        wasted = 0
        if head & 1:
            wasted = 1
            while not bits.one(p, 1):
                wasted, p = wasted + 1, p + 1
                if p >> 3 > len(bits.raw):
                    raise FlacError("cut off in a subframe")
            p += 1
        d -= wasted
        kind = head >> 1 & 63
        if head >> 7 or d <= 0:
            raise FlacError("bad subframe")
        if kind == 0:
            out[i], behind[i] = np.full(n, bits.signed(p, d), np.int64) << wasted, p + d
        elif kind == 1:
            row = np.unpackbits(bits.u8[p >> 3 : (p + n * d + 7) >> 3])[p & 7 :][: n * d].reshape(n, d).astype(np.int64)
            x = row @ (np.int64(1) << np.arange(d - 1, -1, -1, dtype=np.int64))
            out[i], behind[i] = np.where(x >> (d - 1), x - (1 << d), x) << wasted, p + n * d
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            if order > n:
                raise FlacError("predictor longer than its block")
            warm = [bits.signed(p + j * d, d) for j in range(order)]
            p += order * d
            coef, shift = None, 0
            if kind >= 32:
                precision, shift = bits.one(p, 4) + 1, bits.signed(p + 4, 5)
                if precision == 16 or shift < 0:
                    raise FlacError("bad linear predictor")
                coef = [bits.signed(p + 9 + j * precision, precision) for j in range(order)]
                p += 9 + order * precision
            coded.append((n - order, i, p, order, warm, coef, shift, wasted))
        else:
            raise FlacError("reserved subframe")
    coded.sort(key=lambda x: (-x[0], x[1]))
    if coded:
        order = np.array([x[3] for x in coded], np.int64)
        n = np.array([x[0] for x in coded], np.int64) + order
        errors, ends = _residuals(bits, np.array([x[2] for x in coded], np.int64), n, order)
        columns = np.ascontiguousarray(errors.T)
        linear: dict[int, list] = {}
        for lane, (count, i, _, own, warm, coef, shift, wasted) in enumerate(coded):
            behind[i] = int(ends[lane])
            x = columns[lane, :count]
            if coef is not None:
                linear.setdefault(own, []).append((i, x, warm, coef, shift, wasted))
                continue
            steps = [np.array(warm, np.int64)]
            for _ in range(1, own):
                steps.append(np.diff(steps[-1]))
            for step in reversed(steps if own else []):
                x = np.cumsum(np.concatenate([step[:1], x]))
            out[i] = x << wasted
        for own, group in linear.items():
            _restore(own, group, out)
    return out, behind


def _restore(order: int, group: list, out: list) -> None:
    """Linear prediction, one sample of each lane at a time."""
    longest = max(len(x[1]) for x in group)
    y = np.zeros((order + longest, len(group)), np.int64)
    for lane, (_, x, warm, *_) in enumerate(group):
        y[:order, lane] = warm
        y[order : order + len(x), lane] = x
    coef = np.array([x[3][::-1] for x in group], np.int64).T
    shift = np.array([x[4] for x in group], np.int64)
    for s in range(order, len(y)):
        y[s] += (coef * y[s - order : s]).sum(axis=0) >> shift
    for lane, (i, x, _, _, _, wasted) in enumerate(group):
        out[i] = y[: order + len(x), lane] << wasted


_SIZES = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}
_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _header(data: bytes, p: int, depth: int) -> tuple[int, int, int, int]:
    """Of the frame at p: (where its subframes begin, block size, channel code, sample size)."""
    if len(data) < p + 6 or data[p] != 0xFF or data[p + 1] & 0xFE != 0xF8:
        raise FlacError(f"no frame at byte {p}")
    size, rate, channels, bits = data[p + 2] >> 4, data[p + 2] & 15, data[p + 3] >> 4, data[p + 3] >> 1 & 7
    q = p + 4
    lead = data[q]
    q += 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if size in (6, 7):
        n = size - 5
        block, q = int.from_bytes(data[q : q + n], "big") + 1, q + n
    else:
        block = _SIZES.get(size, 0)
    q += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not block or channels > 10 or len(data) <= q or crc8(data[p:q]) != data[q]:
        raise FlacError(f"bad frame header at byte {p}")
    return q + 1, block, channels, _DEPTHS.get(bits, depth)


class Stream:
    """A parsed FLAC stream: format, blocks [(sample offset, samples)], and samples (channels x n)."""

    def __init__(self, data: bytes, base: int):
        if data[:4] != b"fLaC":
            raise FlacError("not a FLAC stream")
        p, last, self.points = 4, False, []
        self.rate = self.channels = self.depth = self.total = 0
        self.md5 = bytes(16)
        while not last:
            if len(data) < p + 4:
                raise FlacError("cut off in its metadata")
            last, kind, n = bool(data[p] & 128), data[p] & 127, int.from_bytes(data[p + 1 : p + 4], "big")
            body = data[p + 4 : p + 4 + n]
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.depth, self.total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
                self.md5 = body[18:34]
            elif kind == 3:
                if len(body) != n or n % 18:
                    raise FlacError("a seek table of a wrong size")
                table = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
                table = table[table["sample"] != np.uint64(0xFFFFFFFFFFFFFFFF)]
                self.points = [(int(a), int(b), int(c)) for a, b, c in table]
            p += 4 + n
        self.first, self.end = base + p, base + len(data)
        self.frames: dict[int, tuple[int, np.ndarray]] = {}
        if not self.points or self.points[0][0] or any(a[0] + a[2] != b[0] for a, b in zip(self.points, self.points[1:], strict=False)) or self.points[-1][0] + self.points[-1][2] != self.total:
            self.points = []  # not a point for each frame: frames are found one after the other

    def starts(self) -> list[int]:
        return [self.first + x[1] for x in self.points] or ([self.first] if self.first < self.end else [])


def decode(media: list[bytes]) -> list[Stream]:
    """Streams with their frames decoded and every checksum verified; FlacError names what is wrong."""
    try:
        return _decode(media)
    except FlacError:
        raise
    except (IndexError, ValueError) as e:  # lengths and places that damage has made up
        raise FlacError(f"damaged stream: {e}") from e


def _decode(media: list[bytes]) -> list[Stream]:
    data = b"".join(media)
    bits = _Bits(data)
    streams, base, waiting = [], 0, []
    for x in media:
        streams.append(s := Stream(x, base))
        waiting += [(s, p) for p in s.starts()]
        base += len(x)
    while waiting:
        todo, waiting = waiting[: AT_ONCE // BLOCK], waiting[AT_ONCE // BLOCK :]
        heads = [_header(data, p, s.depth) for s, p in todo]
        channels = [2 if h[2] >= 8 else h[2] + 1 for h in heads]
        pos = [h[0] * 8 for h in heads]
        parts: list[list[np.ndarray]] = [[] for _ in todo]
        for c in range(max(channels)):
            own = [i for i in range(len(todo)) if channels[i] > c]
            wider = [heads[i][3] + ((heads[i][2], c) in ((8, 1), (9, 0), (10, 1))) for i in own]
            got, behind = _subframes(bits, [pos[i] for i in own], [heads[i][1] for i in own], wider)
            for i, x, p in zip(own, got, behind, strict=True):
                parts[i].append(x)
                pos[i] = p
        first = np.array([p for _, p in todo], np.int64)
        ends = np.array([(p + 7) // 8 for p in pos], np.int64)
        if (ends + 2 > np.array([s.end for s, _ in todo])).any():
            raise FlacError("cut off in a frame")
        sums = crc16s(bits.u8, first, ends)
        if (sums != (bits.u8[ends].astype(np.uint16) << 8 | bits.u8[ends + 1])).any():
            raise FlacError("a frame fails its CRC-16")
        more = []
        for i, (s, p) in enumerate(todo):
            a, *rest = parts[i]
            code = heads[i][2]
            if code == 8:
                rest = [a - rest[0]]
            elif code == 9:
                a, rest = a + rest[0], rest
            elif code == 10:
                mid = a * 2 + (rest[0] & 1)
                a, rest = (mid + rest[0]) >> 1, [(mid - rest[0]) >> 1]
            s.frames[p] = (heads[i][1], np.stack([a, *rest]))
            if not s.points and ends[i] + 2 < s.end:
                more.append((s, int(ends[i]) + 2))
        waiting += more
    for s in streams:
        frames = [s.frames[p] for p in sorted(s.frames)]
        at = np.cumsum([0, *(n for n, _ in frames)])
        s.blocks = [(int(a), n) for a, (n, _) in zip(at, frames, strict=False)]
        s.samples = np.concatenate([x for _, x in frames], axis=1) if frames else np.zeros((max(s.channels, 1), 0), np.int64)
        if s.total and s.samples.shape[1] != s.total:
            raise FlacError(f"{s.samples.shape[1]} samples; the header has {s.total}")
        width = (s.depth + 7) // 8
        flat = np.ascontiguousarray(s.samples.T.astype(f"<i{ {1: 1, 2: 2}.get(width, 4)}"))
        packed = flat.tobytes() if width != 3 else flat.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        if s.md5 != bytes(16) and hashlib.md5(packed).digest() != s.md5:
            raise FlacError("the samples fail the stream's MD5")
        s.pcm = (flat.view(np.uint8) ^ 0x80).tobytes() if width == 1 else packed
    return streams


def feature(stream: Stream) -> str:
    """Level, crest and zero-crossing rate of the decoded samples."""
    x = stream.samples[0] if stream.samples.size else np.zeros(0, np.int64)
    if not len(x):
        return "n=0"
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max())};crossings={crossings}"


def flac_encode(rows: DataFrame, id_col: str, payload_col: str, pad: int = 64) -> DataFrame:
    """(id, n_bytes, media): each payload (string or binary; null is empty) as a FLAC stream of 8-bit samples.

    Payloads are padded with zero bytes to a positive multiple of `pad`; n_bytes is the length before.
    Repeated rows stay; an empty table gives an empty one; the other columns go.
    """

    def run(batches):
        for batch in batches:
            own = byte_values(batch.column(1))
            full = [x + bytes(max(pad, -(-len(x) // pad) * pad) - len(x)) for x in own]
            for a, b in chunks([len(x) for x in full], AT_ONCE):
                n = pa.array([len(x) for x in own[a:b]], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), n, pa.array(encode(full[a:b]), pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, payload_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def _decode_each(media: list[bytes | None]) -> tuple[list, list]:
    """(streams, reasons): a damaged stream is None and has a reason; the others of its batch are decoded."""
    whole = [x for x in media if x is not None]
    try:
        found = iter(decode(whole))
        return [None if x is None else next(found) for x in media], [None] * len(media)
    except FlacError as e:
        if len(media) == 1:
            return [None], [str(e)]
        half = len(media) // 2
        a, b = _decode_each(media[:half]), _decode_each(media[half:])
        return a[0] + b[0], a[1] + b[1]


def flac_decode(rows: DataFrame, id_col: str = "doc_id", media_col: str = "media", damaged: bool = False) -> DataFrame:
    """All columns of rows and: pcm (little-endian; 8-bit samples unsigned), blocks, rate, channels, depth, feature.

    blocks is an array of (sample_offset, n_samples, byte_offset in pcm), one for each frame, so a reader
    can seek to any sample. A null stream gives nulls. A stream that fails a checksum raises FlacError; with
    damaged, it gives nulls, and a column damage has the reason.
    """
    block = pa.list_(pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("byte_offset", pa.int64())]))
    extra = {"pcm": pa.binary(), "blocks": block, "rate": pa.int32(), "channels": pa.int32(), "depth": pa.int32(), "feature": pa.string()} | ({"damage": pa.string()} if damaged else {})
    kept = [c for c in rows.columns if c not in extra]

    def run(batches):
        for batch in batches:
            media = batch.column(kept.index(media_col)).to_pylist()
            for a, b in chunks([len(x or b"") for x in media], AT_ONCE):
                if damaged:
                    streams, reasons = _decode_each(media[a:b])
                else:
                    found = iter(decode([x for x in media[a:b] if x is not None]))
                    streams = [None if x is None else next(found) for x in media[a:b]]
                unit = [0 if s is None else len(s.pcm) // max(1, s.samples.shape[1]) for s in streams]
                made = [
                    [None if s is None else s.pcm for s in streams],
                    [None if s is None else [(p, n, p * w) for p, n in s.blocks] for s, w in zip(streams, unit, strict=True)],
                    [None if s is None else s.rate for s in streams],
                    [None if s is None else s.channels for s in streams],
                    [None if s is None else s.depth for s in streams],
                    [None if s is None else feature(s) for s in streams],
                    *([reasons] if damaged else []),
                ]
                new = [pa.array(x, kind) for x, kind in zip(made, extra.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns] + new, names=[*kept, *extra])

    had = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    made = "pcm binary, blocks array<struct<sample_offset: long, n_samples: int, byte_offset: long>>, rate int, channels int, depth int, feature string" + ", damage string" * damaged
    return rows.select(*[f"`{c}`" for c in kept]).mapInArrow(run, f"{had}, {made}")


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's payload as read back from its FLAC stream."""
    coded = flac_encode(documents(spark, sf_dir), "doc_id", "text")
    back = flac_decode(coded)
    size = F.length("pcm")
    return back.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.size("blocks").alias("n_blocks"),
    )
