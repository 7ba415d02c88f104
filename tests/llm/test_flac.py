"""FLAC: memory, sums over odd stretches, long runs of zeros, streams with frames of many kinds."""

from __future__ import annotations

import hashlib
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm import flac


def payloads(seed: int, frames: int) -> list[bytes]:
    """Frames that each subframe kind suits best: noise, steps, a slow wave, words, one value, and rare far outliers."""
    rng = np.random.default_rng(seed)
    t = np.arange(flac.BLOCK)
    kinds = (
        lambda: rng.integers(0, 256, flac.BLOCK),
        lambda: np.repeat(rng.integers(0, 256, flac.BLOCK // 48), 48),
        lambda: 128 + 100 * np.sin(t / 20 + rng.random()),
        lambda: rng.choice(np.frombuffer(b"the quick brown fox jumps over \xc3\xa9", np.uint8), flac.BLOCK),
        lambda: np.full(flac.BLOCK, 255),
        lambda: np.where(t % 143 == 140, 255, 128),
    )
    made = [kinds[rng.integers(len(kinds))]().astype(np.uint8).tobytes() for _ in range(frames)]
    cut = np.sort(rng.choice(np.arange(1, frames), frames // 4, replace=False)).tolist()
    return [b"".join(made[i:j]) for i, j in zip([0, *cut], [*cut, frames], strict=True)]


def test_all_kinds_together():
    parts = payloads(7, 300)
    media = flac.encode(parts)
    # the streams that the writer made before its bits were put by words
    assert hashlib.sha256(b"".join(media)).hexdigest() == "6621554d28c365852ae659db5a3333cbadccde8320b6e89475ce20921813146b"
    for p, (_, x) in zip(parts, flac.decode(media), strict=True):
        assert (x[:, 0] + 128).astype(np.uint8).tobytes() == p
    assert [m for p in parts for m in flac.encode([p])] == media


def test_memory_of_a_task():
    """Arrays take no more than 60 bytes for each byte of payload, over two groups of frames."""
    parts = payloads(8, 2048)
    size, media = sum(map(len, parts)), flac.encode(parts)
    for run in (lambda: flac.encode(parts), lambda: flac.decode(media)):
        tracemalloc.start()
        run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 60 * size


def test_groups_cover_all_frames():
    for n in (0, 1, flac.GROUP, flac.GROUP + 1, 5 * flac.GROUP - 3):
        cut = flac._groups(n)
        assert cut[0][0] == 0 and cut[-1][1] == n and all(a[1] == b[0] for a, b in zip(cut, cut[1:], strict=False))
        assert max(j - i for i, j in cut) <= 1.5 * flac.GROUP


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=9), min_size=1, max_size=6))
def test_sums(parts):
    def plain(b: bytes) -> int:
        c = 0
        for x in b:
            c ^= x << 8
            for _ in range(8):
                c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        return c

    size = np.array([len(p) for p in parts])
    assert flac.crc16(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size).tolist() == [plain(p) for p in parts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, 7, 38, 41, 52, 53, 54, 70, 500, 3000]), st.integers(0, 14), st.integers(0, (1 << 14) - 1)), min_size=1, max_size=8))
def test_codes(items):
    """Rice codes with runs of zeros of any length, read at once."""
    text, at, want, k = "", [], [], np.array([i[1] for i in items])
    for zeros, m, low in items:
        low &= (1 << m) - 1
        at.append(len(text))
        text += "0" * zeros + "1" + (format(low, f"0{m}b") if m else "")
        want.append((zeros << m | low, len(text)))
    text += "0" * (-len(text) % 8)
    bits = flac.Bits(bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)))
    got = bits.codes(np.array(at), k, int(k.max()))
    assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want
