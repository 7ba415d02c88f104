"""Layouts of five containers: small helpers that take a file's bytes apart, or put them together.

Each ``read_*`` gives (stream, pts, dts, duration, key, payload) in file order and
raises ValueError where the bytes break the layout; each ``write_*`` is its inverse.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

Packet = tuple[int, int | None, int | None, int, bool, bytes]

#: Codes of four characters in frame files, and codec names in block files.
FOURCC = {b"VP80": "vp8", b"VP90": "vp9", b"AV01": "av1"}
BLOCK_CODECS = {"V_VP8": "vp8", "V_VP9": "vp9", "V_AV1": "av1"}
#: Tags of sample formats in wave files.
WAVE_TAGS = {1: "pcm", 3: "float", 6: "alaw", 7: "mulaw"}


def probe(data: bytes, name: str = "") -> tuple[str | None, int]:
    """(format, score) of the first bytes, else of the name; (None, 0) for neither."""
    head, ext = data[:4096], name.lower().rpartition(".")[2]
    scores = {
        "ivf": 100 if head[:4] == b"DKIF" else 0,
        "wav": 99 if head[:4] in (b"RIFF", b"RF64") and head[8:12] == b"WAVE" else 0,
        "mp4": 90 if head[4:8] == b"ftyp" else 70 if head[4:8] in (b"moov", b"mdat", b"free", b"wide") else 50 if ext in ("mp4", "m4a", "m4v", "mov") else 0,
        "webm": (100 if b"webm" in head or b"matroska" in head else 50) if head[:4] == b"\x1a\x45\xdf\xa3" else 0,
        "annexb": 51 if head[:4] == b"\0\0\0\1" or head[:3] == b"\0\0\1" else 0,
    }
    best = max(scores, key=scores.get)
    return (best, scores[best]) if scores[best] else (None, 0)


# ---- frame files: a header of 32 bytes, then size and time before each frame


def write_ivf(frames: list[tuple[int, bytes]], fourcc: bytes = b"VP90", width: int = 0, height: int = 0, rate: tuple[int, int] = (30, 1)) -> bytes:
    head = struct.pack("<4sHH4sHHIIII", b"DKIF", 0, 32, fourcc, width, height, *rate, len(frames), 0)
    return head + b"".join(struct.pack("<IQ", len(d), pts) + d for pts, d in frames)


def read_ivf(data: bytes) -> Iterator[Packet]:
    if data[:4] != b"DKIF" or len(data) < 32:
        raise ValueError("no frame file")
    at = struct.unpack_from("<H", data, 6)[0]
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a frame's header is cut off")
        size, pts = struct.unpack_from("<IQ", data, at)
        if size == 0 or at + 12 + size > len(data):
            raise ValueError("a frame is empty or cut off")
        yield 0, pts, pts, 1, False, data[at + 12 : at + 12 + size]
        at += 12 + size


# ---- wave files


def write_wav(samples: bytes, rate: int = 44100, channels: int = 1, bits: int = 16, tag: int = 1) -> bytes:
    align = channels * bits // 8
    body = b"fmt " + struct.pack("<IHHIIHH", 16, tag, channels, rate, rate * align, align, bits) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def read_wav(data: bytes, frames: int = 1024) -> Iterator[Packet]:
    if data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        raise ValueError("no wave file")
    at, align = 12, 0
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = at + 8
        if kind == b"fmt ":
            tag, _, _, _, align, _ = struct.unpack_from("<HHIIHH", data, body)
            if tag not in WAVE_TAGS:
                raise ValueError(f"sample format {tag}")
        elif kind == b"data":
            if not align:
                raise ValueError("samples before their format")
            end = min(body + size, len(data))
            for i in range(body, end, align * frames):
                part = data[i : min(i + align * frames, end)]
                yield 0, (i - body) // align, (i - body) // align, len(part) // align, True, part
        at = body + size + size % 2


# ---- start-code streams


def units(data: bytes) -> list[bytes]:
    """Units between start codes of three or four bytes, without the zeros that follow a unit."""
    out, at = [], data.find(b"\0\0\1")
    while at >= 0:
        next_ = data.find(b"\0\0\1", at + 3)
        unit = data[at + 3 : next_ if next_ >= 0 else len(data)].rstrip(b"\0")
        if unit:
            out.append(unit)
        at = next_
    return out


def access_units(parts: list[bytes]) -> list[list[bytes]]:
    """Units by picture: one opens a group if the group has a slice, and it is no slice's companion or begins a picture."""
    groups: list[list[bytes]] = []
    has_slice = False
    for u in parts:
        kind = u[0] & 31
        is_slice = kind in (1, 5)
        opens = has_slice and (kind in (6, 7, 8, 9, 14, 15) or (is_slice and len(u) > 1 and u[1] >> 7 == 1))
        if opens or not groups:
            groups.append([])
            has_slice = False
        groups[-1].append(u)
        has_slice = has_slice or is_slice
    return groups


def read_annexb(data: bytes) -> Iterator[Packet]:
    for i, group in enumerate(access_units(units(data))):
        yield 0, i, i, 1, any(u[0] & 31 == 5 for u in group), b"".join(b"\0\0\0\1" + u for u in group)


def write_annexb(parts: list[bytes]) -> bytes:
    return b"".join(b"\0\0\0\1" + u for u in parts)


# ---- boxes


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the boxes' bodies; size 1 has 64 bits, size 0 goes on to the end."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} is longer than what holds it")
        yield kind, at + head, at + size
        at += size


def box(kind: bytes, *body: bytes) -> bytes:
    raw = b"".join(body)
    return struct.pack(">I4s", 8 + len(raw), kind) + raw


def _runs(values: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for v in values:
        if out and out[-1][1] == v:
            out[-1] = (out[-1][0] + 1, v)
        else:
            out.append((1, v))
    return out


def write_mp4(samples: list[tuple[int, int, bool, bytes]], timescale: int = 90000, kind: bytes = b"vide", entry: bytes = b"av01") -> bytes:
    """One track of (duration, pts - dts, key, payload); one sample a chunk, the index after the payload."""
    table = lambda name, fmt, rows, *first: box(name, struct.pack(">I", 0), *[struct.pack(">I", x) for x in first], struct.pack(">I", len(rows)), b"".join(struct.pack(fmt, *r) for r in rows))
    head = box(b"ftyp", b"isom", struct.pack(">I", 0), b"isom")
    offsets, at = [], len(head) + 16
    for s in samples:
        offsets.append(at)
        at += len(s[3])
    data = struct.pack(">I4sQ", 1, b"mdat", at - len(head)) + b"".join(s[3] for s in samples)
    wide = at > 0xFFFFFFFF
    parts = [
        box(b"stsd", struct.pack(">II", 0, 1), box(entry, bytes(6), struct.pack(">H", 1))),
        table(b"stts", ">II", _runs([s[0] for s in samples])),
        table(b"stsc", ">III", [(1, 1, 1)] if samples else []),
        box(b"stsz", struct.pack(">III", 0, 0, len(samples)), b"".join(struct.pack(">I", len(s[3])) for s in samples)),
        table(b"co64" if wide else b"stco", ">Q" if wide else ">I", [(o,) for o in offsets]),
    ]
    if any(s[1] for s in samples):
        parts.append(box(b"ctts", struct.pack(">II", 1 << 24, len(_runs([s[1] for s in samples]))), b"".join(struct.pack(">Ii", *r) for r in _runs([s[1] for s in samples]))))
    if not all(s[2] for s in samples):
        parts.append(table(b"stss", ">I", [(i + 1,) for i, s in enumerate(samples) if s[2]]))
    total = sum(s[0] for s in samples)
    media = box(b"mdia", box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, timescale, total, 0, 0)), box(b"hdlr", struct.pack(">II4s", 0, 0, kind), bytes(13)), box(b"minf", box(b"stbl", *parts)))
    return head + data + box(b"moov", box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, timescale, total), bytes(80)), box(b"trak", media))


def _find(data: bytes, at: int, end: int, *path: bytes) -> list[tuple[int, int]]:
    found = [(a, b) for kind, a, b in boxes(data, at, end) if kind == path[0]]
    return found if len(path) == 1 else [x for a, b in found for x in _find(data, a, b, *path[1:])]


def sample_table(data: bytes, at: int, end: int) -> tuple[np.ndarray, ...]:
    """(offset, size, dts, pts - dts, duration, key) of a track's samples, from its six side tables."""
    raw = {kind: (a, b) for kind, a, b in boxes(data, at, end)}

    def rows(name: bytes, kind: str, wide: int) -> np.ndarray:
        if name not in raw:
            return np.zeros((0, wide), np.int64)
        a = raw[name][0]
        n = struct.unpack_from(">I", data, a + 4)[0]
        return np.frombuffer(data, kind, n * wide, a + 8).astype(np.int64).reshape(n, wide)

    a = raw[b"stsz"][0]
    fixed, n = struct.unpack_from(">II", data, a + 4)
    size = np.full(n, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", n, a + 12).astype(np.int64)
    spread = lambda t, fill: np.append(np.repeat(t[:, 1], t[:, 0]), np.full(n, fill))[:n]
    duration = spread(rows(b"stts", ">u4", 2), 0)
    signed = b"ctts" in raw and data[raw[b"ctts"][0]] > 0
    shift = spread(rows(b"ctts", ">i4" if signed else ">u4", 2), 0)
    chunk = (rows(b"co64", ">u8", 1) if b"co64" in raw else rows(b"stco", ">u4", 1))[:, 0]
    runs = rows(b"stsc", ">u4", 3)
    run = np.searchsorted(runs[:, 0], np.arange(1, len(chunk) + 1), side="right") - 1  # the last run that begins no later
    per = runs[np.maximum(run, 0), 1] if len(runs) else np.zeros(len(chunk), np.int64)
    owner = np.repeat(np.arange(len(chunk)), per)[:n]
    size, duration, shift = size[: len(owner)], duration[: len(owner)], shift[: len(owner)]
    before = np.cumsum(size) - size
    inside = before - before[np.searchsorted(owner, owner)] if len(owner) else before
    key = np.zeros(len(owner), bool)
    named = rows(b"stss", ">u4", 1)[:, 0]
    key[named[named <= len(owner)] - 1] = True
    return chunk[owner] + inside, size, np.cumsum(duration) - duration, shift, duration, key if b"stss" in raw else ~key


def read_mp4(data: bytes) -> Iterator[Packet]:
    """Samples of all video and sound tracks, by time in µs and then by track."""
    rows = []
    for track, (a, b) in enumerate(_find(data, 0, len(data), b"moov", b"trak", b"mdia")):
        head = _find(data, a, b, b"mdhd")[0][0]
        scale = struct.unpack_from(">I", data, head + (20 if data[head] else 12))[0]
        kind = data[_find(data, a, b, b"hdlr")[0][0] + 8 :][:4]
        if kind not in (b"vide", b"soun"):
            continue
        for st in _find(data, a, b, b"minf", b"stbl"):
            for offset, size, dts, shift, duration, key in zip(*(x.tolist() for x in sample_table(data, *st)), strict=True):
                rows.append((dts * 1_000_000 // scale if scale else dts, track, dts, shift, duration, key, offset, size))
    for _, track, dts, shift, duration, key, offset, size in sorted(rows, key=lambda r: r[:3]):
        yield track, dts + shift, dts, duration, key, data[offset : offset + size]


# ---- nested elements with variable-length numbers

_MASTERS = {0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675}


def _number(data: bytes, at: int, keep: bool) -> tuple[int, int, bool]:
    """(value, length, unknown): the leading zeros tell the length; ids keep the marker bit, sizes of all ones are unknown."""
    n = 9 - data[at].bit_length()
    if n > 8:
        raise ValueError("a number of over eight bytes")
    v = int.from_bytes(data[at : at + n], "big")
    low = v & ((1 << 7 * n) - 1)
    return (v if keep else low), n, low == (1 << 7 * n) - 1


def _size(n: int) -> bytes:
    wide = next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * wide).to_bytes(wide, "big")


def element(id_: int, *body: bytes) -> bytes:
    raw = b"".join(body)
    return id_.to_bytes((id_.bit_length() + 7) // 8, "big") + _size(len(raw)) + raw


def write_webm(clusters: list[tuple[int, list[tuple[int, bool, bytes]]]], codec: str = "V_VP9") -> bytes:
    """Clusters of (time, [(time after it, key, payload)]) of one video track."""
    num = lambda i, v: element(i, v.to_bytes(max(1, (v.bit_length() + 7) // 8), "big"))
    head = element(0x1A45DFA3, element(0x4282, b"webm"))
    track = element(0x1654AE6B, element(0xAE, num(0xD7, 1), num(0x83, 1), element(0x86, codec.encode())))
    body = [element(0x1549A966, num(0x2AD7B1, 1_000_000)), track]
    for time, blocks in clusters:
        body.append(element(0x1F43B675, num(0xE7, time), *[element(0xA3, b"\x81" + struct.pack(">hB", t, 0x80 if key else 0), payload) for t, key, payload in blocks]))
    return head + element(0x18538067, *body)


def read_webm(data: bytes) -> Iterator[Packet]:
    videos: set[int] = set()

    def walk(at: int, end: int, state: dict) -> Iterator[Packet]:
        while at < end:
            id_, n, _ = _number(data, at, True)
            size, m, unknown = _number(data, at + n, False)
            at += n + m
            stop = end if unknown else min(at + size, end)
            if id_ in _MASTERS:
                inner = {} if id_ == 0xAE else state
                yield from walk(at, stop, inner)
                if id_ == 0xAE and inner.get("type") == 1 and inner.get("codec") in BLOCK_CODECS:
                    videos.add(inner.get("number", 0))
            elif id_ in (0xD7, 0x83, 0xE7):
                state[{0xD7: "number", 0x83: "type", 0xE7: "time"}[id_]] = int.from_bytes(data[at:stop], "big")
            elif id_ == 0x86:
                state["codec"] = data[at:stop].decode("ascii", "replace")
            elif id_ == 0xA3:
                track, k, _ = _number(data, at, False)
                delta, flags = struct.unpack_from(">hB", data, at + k)
                if flags & 6:
                    raise ValueError("a block with several frames")
                if track in videos:
                    pts = state.get("time", 0) + delta
                    yield 0, pts, pts, 0, bool(flags & 0x80), data[at + k + 3 : stop]
            at = stop

    if data[:4] != b"\x1a\x45\xdf\xa3":
        raise ValueError("no block file")
    yield from walk(0, len(data), {})


READERS = {"ivf": read_ivf, "wav": read_wav, "annexb": read_annexb, "mp4": read_mp4, "webm": read_webm}
