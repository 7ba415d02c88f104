"""Resampling: any cut into chunks gives the signal of the whole, and tones keep their pitch."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from framewright.operators import resample, scan


def whole(data, rate, to, taps):
    up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    out = []
    for n in range(-(-len(data) * up // down)):
        at, phase = n * down // up, n * down % up
        w = resample.weights(np.array([phase]), up, down, taps)[0].tolist()
        total = sum(w[j] * data[at + j - taps // 2 + 1] for j in range(taps) if 0 <= at + j - taps // 2 + 1 < len(data))
        out.append((total + (1 << 23)) >> 24)
    return out


@pytest.mark.parametrize(("rate", "to", "longest", "ranges"), [(48_000, 44_100, 90, 1), (44_100, 48_000, 3, 5), (7, 2, 40, 9), (11_025, 47_999, 50, 3), (5, 5, 64, 2)])
def test_chunks_and_whole_signals_agree(spark, monkeypatch, rate, to, longest, ranges):
    before = scan.ranged
    monkeypatch.setattr(resample, "ranged", lambda d, keys, order: before(d, keys, order, ranges))
    rng, rows, want = random.Random(rate), [], {}
    for key, n in (("a", 500), ("b", 1), (None, 90), ("c", 0)):
        data = [rng.randrange(-30_000, 30_000) for _ in range(n)]
        want[key] = whole(data, rate, to, 32)
        at = i = 0
        while at < n:
            size = rng.randint(0, longest)
            rows.append((key, i, data[at : at + size] if size else rng.choice([None, []])))
            at, i = at + size, i + 1
    df = spark.createDataFrame(rows, "k string, i int, s array<int>").repartition(3)
    got: dict = {k: [] for k in want}
    for r in resample.resample(df, ["k"], ["i"], "s", rate, to, taps=32).orderBy("k", "i").collect():
        assert r["first"] == len(got[r["k"]])
        got[r["k"]] += r["samples"]
    assert got == want


def test_a_tone_keeps_its_pitch_and_what_is_too_high_goes(spark):
    n = np.arange(4000)
    low, high = (np.round(20_000 * np.sin(2 * math.pi * f * n)).astype(int).tolist() for f in (0.01, 0.45))
    df = spark.createDataFrame([(k, i, s[i * 500 : i * 500 + 500]) for k, s in (("low", low), ("high", high)) for i in range(8)], "k string, i int, s array<int>")
    got: dict = {}
    for r in resample.resample(df, ["k"], ["i"], "s", 2, 1).orderBy("k", "i").collect():
        got.setdefault(r["k"], []).extend(r["samples"])
    inner = slice(100, 1900)
    assert np.abs(np.array(got["low"])[inner] - 20_000 * np.sin(2 * math.pi * 0.02 * np.arange(2000))[inner]).max() < 3
    assert np.abs(np.array(got["high"])[inner]).max() < 3
    with pytest.raises(ValueError):
        resample.resample(df, ["k"], ["i"], "s", 0, 1)
