"""Media columns: FLAC streams written and read with numpy inside tasks.

Frames of many streams are handled together: the steps of a frame's samples are
taken one after the other, each for all frames at once. The reader takes any
subframe kind (constant, verbatim, fixed and linear prediction), Rice parameters
of both widths with escapes, wasted bits, one to eight channels and stereo
decorrelation; it checks the CRC-8 of frame headers, the CRC-16 of frames and the
MD5 of the samples. The writer makes frames of 576 samples of 8-bit mono, with a
seek point for every ``SEEK`` frames.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 576
#: Frames between seek points.
SEEK = 64
RATE = 8000
#: The writer's linear predictors have this order, and coefficients of so many bits.
ORDER, PRECISION, SHIFT = 4, 8, 6
PARTITIONS = 4
#: More bytes than a sample takes in all channels, unless a code is absurdly long.
BYTES = 96
#: Frames that are handled together, half as many more at most: what bounds memory for very long streams.
GROUP = 1024
#: Bytes of streams or payloads that a task handles together, about.
_SLICE = GROUP * BLOCK


class FlacError(ValueError):
    """A stream that can't be read: what is wrong, and in which frame."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8 = CRC8.tolist()
#: What two bytes, the CRC before them added to them, give.
_CRC16 = (CRC16[(CRC16[:, None] >> 8) ^ np.arange(256)] ^ (CRC16[:, None] << 8 & 0xFFFF)).ravel()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of stretches of the bytes, all at once and two bytes a step; of an odd stretch, the first byte goes before."""
    order = np.argsort(-(size >> 1), kind="stable")
    begin, crc = start[order], np.zeros(len(start), np.int64)
    odd = np.flatnonzero(size[order] & 1)
    crc[odd] = CRC16[data[begin[odd]]]
    begin[odd] += 1
    pair = (data[:-1].astype(np.uint16) << 8) | data[1:]
    alive = np.searchsorted(-(size[order] >> 1), -np.arange(int(size.max(initial=0)) >> 1), side="left")
    for i, n in enumerate(alive.tolist()):
        crc[:n] = _CRC16[crc[:n] ^ pair[begin[:n] + 2 * i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _groups(n: int) -> list[tuple[int, int]]:
    """Stretches of about GROUP of n frames, as long as each other."""
    cut = np.linspace(0, n, max(1, round(n / GROUP)) + 1).astype(int).tolist()
    return list(zip(cut[:-1], cut[1:], strict=True))


# ---- writing


def _number(n: int) -> bytes:
    """A frame's number in the form of extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | (n >> (6 * i) & 0x3F) for i in range(size - 1)]
    return bytes([(0xFF << (8 - size) & 0xFF) | n >> (6 * (size - 1)), *reversed(tail)])


def _predictors(x: np.ndarray) -> np.ndarray:
    """Quantised linear predictors [frame, ORDER] of frames, by the autocorrelation method."""
    f = x.astype(np.float32)  # exact: sums of BLOCK products of 8-bit samples have under 24 bits
    r = np.stack([np.einsum("ij,ij->i", f[:, : x.shape[1] - k], f[:, k:]) for k in range(ORDER + 1)], axis=1).astype(np.float64)
    err = np.maximum(r[:, 0], 1e-9)
    a = np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / err
        old = a[:, :i].copy()
        a[:, i] = k
        a[:, :i] = old - k[:, None] * old[:, ::-1]
        err = np.maximum(err * (1 - k * k), 1e-9)
    high = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << SHIFT)), -high - 1, high).astype(np.int64)


def encode_frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of 8-bit samples [frame, BLOCK] and their numbers -> joined bytes, and the size of each frame."""
    n, x = len(x), x.astype(np.int16)
    coef = _predictors(x)
    guess, wide = np.zeros((n, BLOCK - ORDER), np.int32), x.astype(np.int32)
    for j in range(ORDER):
        guess += coef[:, j : j + 1].astype(np.int32) * wide[:, ORDER - 1 - j : BLOCK - 1 - j]
    first, linear = x.copy(), x.copy()
    first[:, 1:] -= x[:, :-1]
    linear[:, ORDER:] -= (guess >> SHIFT).astype(np.int16)
    choices = (x, first, linear)
    kind = np.stack([np.abs(c).sum(axis=1, dtype=np.int32) for c in choices]).argmin(axis=0)  # 0: order 0, 1: order 1, 2: linear
    flat = (x == x[:, :1]).all(axis=1)
    res = np.where((kind == 2)[:, None], linear, np.where((kind == 1)[:, None], first, x))
    warm = np.array([0, 1, ORDER])[kind]
    lead = np.arange(BLOCK)[None, :] < warm[:, None]
    u = ((res << 1) ^ (res >> 15)).view(np.uint16)
    u[lead] = 0
    part = BLOCK // PARTITIONS
    counts = part - np.where(np.arange(PARTITIONS)[None, :] == 0, warm[:, None], 0)
    # a parameter beyond the longest code's bits only costs more
    costs = np.stack([(u >> k).reshape(n, PARTITIONS, part).sum(axis=2, dtype=np.int32) + counts * (k + 1) for k in range(min(14, int(u.max(initial=0)).bit_length() + 1))])
    k = costs.argmin(axis=0)
    ks = np.repeat(k.astype(np.uint16), part, axis=1)
    # bits: header, kind, warm-up, [predictor], method and order, then each partition's parameter and its codes
    heads = []
    for i in number.tolist():
        raw = b"\xff\xf8\x24\x02" + _number(i)
        heads.append(raw + bytes([crc8(raw)]))
    head = np.fromiter(map(len, heads), np.int64, n) * 8
    side = np.where(kind == 2, 9 + ORDER * PRECISION, 0) + 6
    at = ((u >> ks) + (ks + np.uint16(1))).astype(np.int32)  # a code's bits
    at[lead] = 8
    long = at[:, -1].copy()
    at[:, 1:], at[:, 0] = at[:, :-1].copy(), 0
    at[:, ::part] += 4
    at[np.arange(n), warm] += side
    at[np.arange(n)[warm > 0], warm[warm > 0]] += 4  # the first partition's parameter follows the warm-up
    at[warm > 0, 0] -= 4
    at = np.cumsum(at, axis=1, dtype=np.int64)  # where each sample's code begins, after the frame's first two fields
    bits_in = np.where(flat, head + 16, head + 8 + at[:, -1] + long)
    size = (bits_in + 7) // 8 + 2
    begin = np.cumsum(size) - size
    words = np.zeros(int(size.sum()) // 4 + 3)  # of 32 bits; what is put in them never overlaps, so that sums are exact

    def put(where: np.ndarray, value: np.ndarray, m: np.ndarray | int) -> None:
        """``m`` bits (32 at most) of each value from each place."""
        both = value.astype(np.uint64) << (64 - m - (where & 31)).astype(np.uint64)
        word = where >> 5
        words[:] += np.bincount(word, weights=both >> np.uint64(32), minlength=len(words))
        words[:] += np.bincount(word + 1, weights=both & np.uint64(0xFFFFFFFF), minlength=len(words))

    body = begin * 8 + head
    put(body, np.where(flat, 0, np.where(kind == 2, (32 + ORDER - 1) << 1, (8 + kind) << 1)), 8)
    put(body[flat] + 8, x[flat, 0] & 0xFF, 8)
    live = np.flatnonzero(~flat)
    at += (body + 8)[:, None]
    for w in range(ORDER):
        own = live[warm[live] > w]
        put(at[own, w], x[own, w] & 0xFF, 8)
    after = at[np.arange(n), warm] - 4 - 6  # method and order of the residual
    lpc = live[kind[live] == 2]
    base = after[lpc] - 9 - ORDER * PRECISION
    put(base, np.full(len(lpc), (PRECISION - 1) << 5 | SHIFT), 9)
    for j in range(ORDER):
        put(base + 9 + j * PRECISION, coef[lpc, j] & ((1 << PRECISION) - 1), PRECISION)
    put(after[live], np.full(len(live), PARTITIONS.bit_length() - 1), 6)
    for p in range(PARTITIONS):
        where = at[live, p * part] - 4 if p else after[live] + 6
        put(where, k[live, p], 4)
    code = ~lead & ~flat[:, None]
    kk, uu = ks[code], u[code]
    put(at[code] + (uu >> kk), np.uint16(1) << kk | uu & ((np.uint16(1) << kk) - np.uint16(1)), kk.astype(np.int64) + 1)
    data = words.astype(">u4").view(np.uint8)[: int(size.sum())].copy()
    for m in np.unique(head):
        own = np.flatnonzero(head == m)
        data[begin[own, None] + np.arange(m // 8)] = np.frombuffer(b"".join(heads[i] for i in own.tolist()), np.uint8).reshape(len(own), -1)
    crc = crc16(data, begin, size - 2)
    data[begin + size - 2], data[begin + size - 1] = crc >> 8, crc & 0xFF
    return data, size


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of BLOCK bytes, as a FLAC stream of 8-bit mono samples (byte minus 128)."""
    count = np.array([len(p) // BLOCK for p in payloads], np.int64)
    if not len(count):
        return []
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    x = (raw.astype(np.int16) - 128).reshape(-1, BLOCK)
    last = np.cumsum(count)
    number = np.arange(len(x)) - np.repeat(last - count, count)
    parts = [encode_frames(x[i:j], number[i:j]) for i, j in _groups(len(x))]
    data, size = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
    ends = np.append(0, np.cumsum(size))
    out = []
    for p, lo, hi in zip(payloads, (last - count).tolist(), last.tolist(), strict=True):
        own = size[lo:hi]
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = b"".join([BLOCK.to_bytes(2, "big") * 2, int(own.min()).to_bytes(3, "big"), int(own.max()).to_bytes(3, "big"), (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big"), hashlib.md5(signed).digest()])
        points = b"".join((i * BLOCK).to_bytes(8, "big") + int(ends[lo + i] - ends[lo]).to_bytes(8, "big") + BLOCK.to_bytes(2, "big") for i in range(0, hi - lo, SEEK))
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + data[ends[lo] : ends[hi]].tobytes())
    return out


# ---- reading


class Bits:
    """Reads many places of one run of bytes at once."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data + bytes(16), np.uint8)
        self.data, self.size = raw, len(data) * 8
        wide = np.zeros(len(raw) - 8, np.uint64)
        for j in range(8):
            whole = raw[j : j + (len(raw) - j) // 8 * 8].view(">u8")
            wide[j::8] = whole[: len(wide[j::8])]
        self.wide = wide  # 8 bytes from each

    @functools.cached_property
    def next(self) -> np.ndarray:
        """The first set bit at or after each place; made only for wasted bits and very long runs of zeros."""
        one = np.flatnonzero(np.unpackbits(self.data[: self.size // 8])).astype(np.int32)
        gaps = np.diff(np.append(-1, one))
        return np.append(np.repeat(one, gaps), np.full(self.size + 128 - (one[-1] + 1 if len(one) else 0), self.size, np.int32))

    def _look(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At least 57 bits from each place, and how many zeros they begin with: more than 52 if the first 53 are."""
        word = self.wide[at >> 3] << (at & 7).view(np.uint64)
        # the exponent of the first 53 bits as a float tells the first that is set
        return word, 1075 - ((word >> np.uint64(11)).view(np.int64).astype(np.float64).view(np.int64) >> 52)

    def _first(self, at: np.ndarray) -> np.ndarray:
        """The first set bit at or after each place."""
        start = at
        for _ in range(8):
            zeros = self._look(at)[1]
            far = (zeros > 52) & (at < self.size)
            at = np.minimum(at + np.where(far, 53, np.minimum(zeros, 53)), self.size)
            if not far.any():
                return at
        return self.next[start].astype(np.int64)

    def codes(self, at: np.ndarray, k: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Rice codes of parameters ``k`` (``most`` at most) from each place, unsigned, and where they end."""
        at = np.minimum(at, self.size)
        word, zeros = self._look(at)
        stop = zeros + 1
        if zeros.max(initial=0) + most > 55:
            far = np.flatnonzero(zeros + most > 55)
            stop[far] = 1
            low = (word << stop.view(np.uint64)) >> np.uint64(1) >> (63 - k).view(np.uint64)
            first = self._first(at[far])
            zeros[far], stop[far] = first - at[far], first - at[far] + 1
            low[far] = self.take(first + 1, k[far]).view(np.uint64)
        else:
            low = (word << stop.view(np.uint64)) >> np.uint64(1) >> (63 - k).view(np.uint64)
        return (zeros << k) | low.view(np.int64), at + stop + k

    def take(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """``n`` bits (0 to 32) from each place, unsigned."""
        at = np.minimum(at, self.size)
        word = self.wide[at >> 3] << (at & 7).astype(np.uint64)
        n = np.asarray(n, np.uint64)
        return np.where(n > 0, word >> (np.uint64(64) - np.maximum(n, np.uint64(1))), np.uint64(0)).astype(np.int64)

    def signed(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        v, n = self.take(at, n), np.asarray(n, np.int64)
        return np.where((n > 0) & (v >> np.maximum(n - 1, 0) & 1 == 1), v - (1 << n), v)


#: What the reader keeps of a subframe's fixed predictors.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def subframes(bits: Bits, at: np.ndarray, size: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples [frame, longest] of the subframes at these places, and where they end."""
    n, longest = len(at), int(size.max())
    kind = bits.take(at + 1, 6)
    wasted = bits.take(at + 7, 1)
    if wasted.any():
        wasted = np.where(wasted == 1, bits.next[np.minimum(at + 8, bits.size)] - (at + 8) + 1, 0)
    at, depth = at + 8 + wasted, depth - wasted
    out = np.zeros((longest, n), np.int64)
    constant, verbatim = kind == 0, kind == 1
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | linear).all():
        raise FlacError("a subframe of a reserved kind")
    own = np.flatnonzero(constant)
    if len(own):
        out[:, own] = bits.signed(at[own], depth[own])[None, :]
        at[own] += depth[own]
    own = np.flatnonzero(verbatim)
    if len(own):
        i = np.arange(longest)[:, None]
        out[:, own] = bits.signed(at[own] + i * depth[own], np.broadcast_to(depth[own], (longest, len(own))))
        at[own] += depth[own] * size[own]
    own = np.flatnonzero(fixed | linear)
    if len(own):
        samples, end = _predicted(bits, at[own], size[own], depth[own], kind[own])
        out[:, own] = samples
        at[own] = end
    return (out << wasted).T, at


def _predicted(bits: Bits, at: np.ndarray, size: np.ndarray, depth: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, longest = len(at), int(size.max())
    order = np.where(kind >= 32, kind - 31, kind - 8)
    most = int(order.max())
    # rows before the first are zero, so that every frame looks back as far
    out = np.zeros((most + longest, n), np.int64)
    for i in range(most):
        own = order > i
        out[most + i, own] = bits.signed(at[own], depth[own])
        at = np.where(own, at + depth, at)
    linear = kind >= 32
    precision = np.where(linear, bits.take(at, 4) + 1, 0)
    shift = np.where(linear, bits.signed(at + 4, np.full(n, 5)), 0)
    if (linear & ((precision == 16) | (shift < 0))).any():
        raise FlacError("a predictor that the format does not allow")
    at = np.where(linear, at + 9, at)
    coef = np.zeros((most, n), np.int64)
    for j in range(most):
        own = linear & (order > j)
        coef[j, own] = bits.signed(at[own], precision[own])
        at = np.where(own, at + precision, at)
    for o, c in enumerate(FIXED[: most + 1]):
        for j, v in enumerate(c):
            coef[j, ~linear & (order == o)] = v
    method = bits.take(at, 2)
    if (method > 1).any():
        raise FlacError("a residual of a reserved kind")
    wide = np.where(method == 1, 5, 4)
    part = size >> bits.take(at + 2, 4)
    at = at + 6
    k, raw, escaped = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    least, even = int(order.min()), bool((size == longest).all() and (part == part[0]).all())
    res = out[most:]  # the residuals, and in place of them the samples
    for i in range(least, longest):
        if even and i > most:  # all frames are past their warm-up, and begin partitions at the same samples
            go, new = None, np.ones(n, bool) if i % part[0] == 0 else None
        else:
            go = (i >= order) & (i < size)
            new = go & ((i == order) | (i % part == 0))
            if not new.any():
                new = None
        if new is not None:
            k = np.where(new, bits.take(at, wide), k)
            at = np.where(new, at + wide, at)
            escaped = np.where(new, k == (1 << wide) - 1, escaped)
            if escaped.any():
                hit = new & escaped
                raw = np.where(hit, bits.take(at, 5), raw)
                at = np.where(hit, at + 5, at)
            high, some = int(k.max()), bool(escaped.any())
        u, end = bits.codes(at, k, high)
        value = (u >> 1) ^ -(u & 1)
        if some:
            value = np.where(escaped, bits.signed(at, raw), value)
            end = np.where(escaped, at + raw, end)
        if go is None:
            res[i], at = value, end
        else:
            res[i] = np.where(go, value, res[i])
            at = np.where(go, end, at)
    if (at > bits.size).any():
        raise FlacError("a residual beyond the end")
    once = ~linear & (order == 1)
    res[:, once] = np.cumsum(res[:, once], axis=0)
    own = np.flatnonzero((order > 0) & ~once)
    if len(own):
        some, back, down = out[:, own], np.ascontiguousarray(coef[::-1, own]), shift[own]
        late = order[own]
        for i in range(int(late.min()), longest):
            value = (back * some[i : i + most]).sum(axis=0) >> down
            some[most + i] += value if i >= most else np.where(i >= late, value, 0)
        out[:, own] = some
    return out[most:], at


_RATE_TAIL, _SIZES = {12: 1, 13: 2, 14: 2}, {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}
_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}


def header(data: bytes, at: int, depth: int) -> tuple[int, int, int, int, int, bool] | None:
    """(bytes, samples, channels' code, depth, number, whether it counts samples) of a frame's header, or None if there is none."""
    b = data[at : at + 16]
    if len(b) < 6 or b[0] != 0xFF or b[1] & 0xFE != 0xF8 or b[3] & 1:
        return None
    size, rate, channels, bits = b[2] >> 4, b[2] & 15, b[3] >> 4, b[3] >> 1 & 7
    lead = b[4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if size == 0 or rate == 15 or channels > 10 or bits == 3 or more == 1 or more > 7:
        return None
    number = lead if not more else lead & (0x7F >> more)
    p = 5
    for _ in range(max(0, more - 1)):
        if p >= len(b) or b[p] >> 6 != 2:
            return None
        number = number << 6 | b[p] & 0x3F
        p += 1
    n = _SIZES.get(size)
    if size in (6, 7):
        n = int.from_bytes(b[p : p + size - 5], "big") + 1
        p += size - 5
    p += _RATE_TAIL.get(rate, 0)
    if p >= len(b) or crc8(b[:p]) != b[p]:
        return None
    return p + 1, n, channels, _DEPTHS.get(bits, depth), number, bool(b[1] & 1)


#: How a frame begins.
SYNC = re.compile(rb"\xff[\xf8\xf9]")


class Stream:
    """A stream's facts: where frames begin, and what its header says."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC" or len(data) < 42:
            raise FlacError("no FLAC stream")
        at, last, self.seek = 4, False, []
        while not last:
            last, kind, size = bool(data[at] >> 7), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body, at = data[at + 4 : at + 4 + size], at + 4 + size
            if kind == 0:
                facts = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.depth, self.samples, self.md5 = facts >> 44, (facts >> 41 & 7) + 1, (facts >> 36 & 31) + 1, facts & ((1 << 36) - 1), body[18:34]
            elif kind == 3:
                self.seek = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, len(body) - 17, 18)]
        self.data, self.start = data, at

    def frames(self) -> list[tuple]:
        """(place, header) of the frames, found by their sync code, header checksum and running number."""
        out, at, expect, seen = [], self.start, 0, 0
        while at >= 0 and at < len(self.data):
            h = header(self.data, at, self.depth)
            if h and h[4] == (seen if h[5] else expect):
                out.append((at, h))
                expect, seen, at = expect + 1, seen + h[1], at + h[0] + 2
            else:  # a payload may look like a header, even with its checksum
                at += 1
            found = SYNC.search(self.data, at)
            at = found.start() if found else -1
        return out


def decode(streams: list[bytes]) -> list[tuple[Stream, np.ndarray]]:
    """(facts, samples [sample, channel]) of each stream, all checksums verified."""
    facts = [Stream(s) for s in streams]
    found = [f.frames() for f in facts]
    try:
        return _together(facts, found)
    except FlacError:
        if len(streams) == 1:
            return [_in_turn(facts[0])]
        return [decode([s])[0] for s in streams]


def _in_turn(f: Stream) -> tuple[Stream, np.ndarray]:
    """Reads one frame after the other: where a payload looks like a frame's begin, only this finds the next."""
    at, parts = f.start, []
    while at < len(f.data):
        h = header(f.data, at, f.depth)
        if not h:
            raise FlacError(f"frame {len(parts)}: no header, or its checksum differs")
        part, size = _read(f.data[at : at + BYTES * h[1]], np.array([0]), [h])
        end = at + int(size[0])
        if int(crc16(np.frombuffer(f.data[at:end], np.uint8), np.array([0]), np.array([end - at - 2]))[0]) != int.from_bytes(f.data[end - 2 : end], "big"):
            raise FlacError(f"frame {len(parts)}: its checksum differs")
        parts.append(part[0])
        at = end
    return _checked(f, parts)


def _read(data: bytes, at: np.ndarray, heads: list[tuple]) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples [sample, channel] of frames at these places, and the bytes of each."""
    bits = Bits(data)
    size, mode, depth = (np.array([h[i] for h in heads], np.int64) for i in (1, 2, 3))
    channels = np.where(mode < 8, mode + 1, 2)
    place = (at + np.array([h[0] for h in heads])) * 8
    planes = []
    for c in range(int(channels.max())):
        own = np.flatnonzero(channels > c)
        more = ((mode == 8) | (mode == 10)) & (c == 1) | (mode == 9) & (c == 0)  # the difference has one bit more
        samples, end = subframes(bits, place[own], size[own], (depth + more)[own])
        full = np.zeros((len(at), int(size.max())), np.int64)
        full[own, : samples.shape[1]] = samples
        place[own] = end
        planes.append(full)
    if len(planes) > 1:
        a, b = planes[0], planes[1]
        m = mode[:, None]
        mid = (a << 1) | (b & 1)
        planes[0] = np.where(m == 9, a + b, np.where(m == 10, (mid + b) >> 1, a))
        planes[1] = np.where(m == 8, a - b, np.where(m == 10, (mid - b) >> 1, b))
    return [planes[0][i, : size[i], None] if c == 1 else np.stack([p[i, : size[i]] for p in planes[:c]], axis=1) for i, c in enumerate(channels.tolist())], (place + 7) // 8 + 2 - at


def _together(facts: list[Stream], found: list[list[tuple]]) -> list[tuple[Stream, np.ndarray]]:
    starts = np.cumsum([0] + [len(f.data) for f in facts])
    at = np.array([s + p for s, frames in zip(starts, found, strict=False) for p, _ in frames], np.int64)
    ends = np.concatenate([np.array([*[p for p, _ in frames[1:]], len(f.data)][: max(1, len(frames))], np.int64) + s if frames else np.zeros(0, np.int64) for f, s, frames in zip(facts, starts, found, strict=False)]) if facts else at
    if not len(at):
        return [_checked(f, []) for f in facts]
    data = b"".join(f.data for f in facts)
    heads = [h for frames in found for _, h in frames]
    parts, size = [], np.zeros(len(at), np.int64)
    for i, j in _groups(len(at)):
        some, size[i:j] = _read(data[at[i] : ends[j - 1]], at[i:j] - at[i], heads[i:j])
        parts += some
    if (at + size != ends).any():
        raise FlacError("a frame ends elsewhere than the next begins")
    raw = np.frombuffer(data, np.uint8)
    if (crc16(raw, at, size - 2) != (raw[ends - 2].astype(np.int64) << 8 | raw[ends - 1])).any():
        raise FlacError("a frame's checksum differs")
    cut = np.cumsum([0] + [len(frames) for frames in found])
    return [_checked(f, parts[cut[i] : cut[i + 1]]) for i, f in enumerate(facts)]


def _checked(f: Stream, parts: list[np.ndarray]) -> tuple[Stream, np.ndarray]:
    x = np.concatenate(parts) if parts else np.zeros((0, f.channels), np.int64)
    if f.samples and len(x) != f.samples:
        raise FlacError(f"{len(x)} samples; the header says {f.samples}")
    if any(f.md5) and hashlib.md5(signed_bytes(x, f.depth)).digest() != f.md5:
        raise FlacError("the samples' MD5 differs")
    return f, x


def signed_bytes(x: np.ndarray, depth: int) -> bytes:
    """Samples in turn, little-endian, in whole bytes."""
    wide = -(-depth // 8)
    if wide == 1:
        return x.astype(np.int8).tobytes()
    return np.ascontiguousarray(x.astype("<i4")).view(np.uint8).reshape(-1, 4)[:, :wide].tobytes()


# ---- columns


def _slices(size: np.ndarray) -> Iterator[tuple[int, int]]:
    slot = (np.cumsum(size) - size) // _SLICE
    for s in np.unique(slot):
        lo, hi = np.searchsorted(slot, [s, s + 1])
        yield int(lo), int(hi)


def _sizes(col: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def write_column(df: DataFrame, payload: str = "payload", media: str = "media", keep: bool = True) -> DataFrame:
    """All columns of df (without the payload if it isn't to be kept) and ``media``: the payload (a positive multiple of 576 bytes) as a FLAC stream of 8-bit samples.

    A null payload gives a null stream. A column of that name is replaced.
    """
    rows = df.drop(media)
    names = rows.columns
    at = names.index(payload)
    own = [i for i in range(len(names)) if keep or i != at]
    fields = [rows.schema.fields[i] for i in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(_sizes(batch.column(at))):
                part = batch.slice(lo, hi - lo)
                values = part.column(at).to_pylist()
                made = iter(encode([v for v in values if v is not None]))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in own), pa.array([None if v is None else next(made) for v in values], pa.binary())], [*(names[i] for i in own), media])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField(media, T.BinaryType())]))


#: What read_column gives: PCM (8 bits: unsigned, else signed little-endian), the stream's facts, and (first sample, byte of its frame in the stream) of its seek points.
DECODED = T.StructType([T.StructField("pcm", T.BinaryType()), T.StructField("rate", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("samples", T.LongType()), T.StructField("seek", T.ArrayType(T.StructType([T.StructField("sample", T.LongType()), T.StructField("byte", T.LongType())]))), T.StructField("error", T.StringType()), T.StructField("feature", T.StringType())])


def feature(x: np.ndarray) -> str:
    """Mean, root mean square, zero crossings and mean step of the samples."""
    if not len(x):
        return "0:0.0000:0.0000:0:0.0000"
    v = x[:, 0]
    return f"{len(v)}:{v.mean():.4f}:{np.sqrt((v * v).mean()):.4f}:{int(((v[1:] < 0) != (v[:-1] < 0)).sum())}:{np.abs(np.diff(v)).mean() if len(v) > 1 else 0:.4f}"


def read_column(df: DataFrame, media: str = "media", decoded: str = "decoded") -> DataFrame:
    """All columns of df but ``media``'s bytes stay, and ``decoded``: a struct of what the stream holds (DECODED).

    A null stream gives null; one that can't be read, or whose checksums differ,
    gives its error and no samples. A column of that name is replaced.
    """
    rows = df.drop(decoded)
    names = rows.columns
    at = names.index(media)
    arrow = pa.struct([("pcm", pa.binary()), ("rate", pa.int32()), ("channels", pa.int32()), ("depth", pa.int32()), ("samples", pa.int64()), ("seek", pa.list_(pa.struct([("sample", pa.int64()), ("byte", pa.int64())]))), ("error", pa.string()), ("feature", pa.string())])

    def one(item: tuple[Stream, np.ndarray]) -> dict:
        f, x = item
        pcm = signed_bytes(x, f.depth)
        if f.depth == 8:
            pcm = (np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes()
        return {"pcm": pcm, "rate": f.rate, "channels": f.channels, "depth": f.depth, "samples": len(x), "seek": [{"sample": s, "byte": f.start + b} for s, b, _ in f.seek], "error": None, "feature": feature(x)}

    def each(values: list[bytes | None]) -> list[dict | None]:
        try:
            made = iter(decode([v for v in values if v is not None]))
            return [None if v is None else one(next(made)) for v in values]
        except (FlacError, IndexError, ValueError) as e:
            if len(values) > 1:
                return [each([v])[0] for v in values]
            return [dict.fromkeys(("pcm", "rate", "channels", "depth", "samples", "seek", "feature")) | {"error": str(e)}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(_sizes(batch.column(at))):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(each(part.column(at).to_pylist()), arrow)], [*names, decoded])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(decoded, DECODED)]))


def pcm_blocks(df: DataFrame, keys: list[str], samples: int = BLOCK * SEEK, decoded: str = "decoded") -> DataFrame:
    """Rows of PCM: keys, block, first_sample, n_samples, pcm; blocks of ``samples`` samples, so that a sample's block is known by division."""
    step = F.col(f"{decoded}.channels") * F.ceil(F.col(f"{decoded}.depth") / 8).cast("int")
    count = F.ceil(F.col(f"{decoded}.samples") / samples).cast("int")
    rows = df.where(F.col(f"{decoded}.samples") > 0).select(*keys, F.col(decoded).alias("_d"), step.alias("_step"), F.explode(F.sequence(F.lit(0), count - 1)).alias("block"))
    first = F.col("block").cast("long") * samples
    n = F.least(F.lit(samples).cast("long"), F.col("_d.samples") - first)
    return rows.select(*keys, "block", first.alias("first_sample"), n.cast("int").alias("n_samples"), F.substring(F.col("_d.pcm"), (first * F.col("_step") + 1).cast("int"), (n * F.col("_step")).cast("int")).alias("pcm"))


def block_index(decoded: str = "decoded"):
    """For each seek point of a decoded stream of one channel and 8 bits the PCM block from it to the next: its first sample, samples, the byte of its frame in the stream, and the crc32 of its PCM."""
    points, samples = F.col(f"{decoded}.seek"), F.col(f"{decoded}.samples")
    until = lambda i: F.coalesce(F.get(points, i + 1)["sample"], samples)
    block = lambda x, i: F.struct(x["sample"].alias("first_sample"), (until(i) - x["sample"]).alias("n_samples"), x["byte"].alias("frame_byte"), F.crc32(F.substring(F.col(f"{decoded}.pcm"), (x["sample"] + 1).cast("int"), (until(i) - x["sample"]).cast("int"))).alias("pcm_crc32"))
    return F.transform(points, block)


def padded(text_col: str = "text", block: int = BLOCK):
    """A text's UTF-8 bytes, followed by bytes 255 up to a positive multiple of the block; null as an empty text."""
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8")
    short = (F.greatest(F.ceil(F.octet_length(raw) / block), F.lit(1)) * block - F.octet_length(raw)).cast("int")
    return F.concat(raw, F.unhex(F.repeat(F.lit("FF"), short)))
