"""Signals from one rate to any other, by a windowed sinc at each output's own phase.

A signal is the chunks of its keys in order. A chunk makes the outputs whose place falls
into it; the samples that its first and last outputs reach beyond it are handed on by the
ordered scan, so that any cut into chunks gives the same signal. Weights are whole numbers of 24
bits, so that sums don't depend on their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import ranged, running_sum, with_halo

#: Taps, the share of the lower rate's band that passes, and the bits of weights.
TAPS, CUTOFF, BITS = 128, 0.95, 24
#: Outputs that are made at once.
_PIECE = 4096
#: Four terms of the window that is squared: fixed values.
WINDOW = (0.35875, 0.48829, 0.14128, 0.01168)


def weights(phase: np.ndarray, up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """A row for each phase (in ``up``-ths of a sample) of weights of the samples from taps / 2 - 1 before to taps / 2 behind; each row's sum is about one."""
    x = np.arange(taps)[None, :] - (taps // 2 - 1) - phase[:, None] / up
    cut = CUTOFF * min(1.0, up / down)
    at = 2 * math.pi * (x + taps / 2) / taps
    window = (WINDOW[0] - WINDOW[1] * np.cos(at) + WINDOW[2] * np.cos(2 * at) - WINDOW[3] * np.cos(3 * at)) ** 2
    w = np.sinc(cut * x) * window
    return np.floor(w / w.sum(axis=1, keepdims=True) * (1 << BITS) + 0.5).astype(np.int64)


def resample(chunks: DataFrame, keys: list[str], order: list[str], samples: str, rate: int, to: int, taps: int = TAPS) -> DataFrame:
    """keys, order, first, samples: the outputs of each chunk and the number of the first of them in its signal.

    A signal of n samples gives ceil(n * to / rate). Beyond its ends are zeros; null and empty chunks
    are as if they weren't there.
    """
    if rate <= 0 or to <= 0 or taps % 2:
        raise ValueError("rates must be positive and taps even")
    up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    reach = taps // 2
    rows = chunks.select(*keys, *order, F.col(samples).cast("array<long>").alias("_s")).where(F.size("_s") > 0)
    rows = ranged(rows, keys, order)
    least = rows.agg(F.min(F.size("_s"))).first()[0] or reach
    near = -(-reach // least)
    rows = running_sum(rows, keys, order, F.size("_s").cast("long"), "_at")
    rows = with_halo(rows, keys, order, F.slice("_s", F.greatest(F.size("_s") - reach, F.lit(0)) + 1, F.lit(reach)), "_b", near)
    rows = with_halo(rows, keys, order, F.slice("_s", 1, reach), "_a", near, step=1)
    rows = rows.select(*keys, *order, "_at", F.flatten("_b").alias("_b"), "_s", F.slice(F.flatten("_a"), 1, reach).alias("_a"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, out = [], []
            parts = [b.column(c) for c in ("_b", "_s", "_a")]
            for i, at in enumerate(b.column("_at").to_pylist()):
                before, own, after = (np.asarray(p[i].values.to_numpy(zero_copy_only=False), np.int64) for p in parts)
                before = before[-reach:]
                data = np.concatenate([np.zeros(reach - len(before), np.int64), before, own, after, np.zeros(reach - len(after), np.int64)])
                n = np.arange(-(-at * up // down), -(-(at + len(own)) * up // down), dtype=np.int64)
                place, phase = n * down // up - at, n * down % up
                made = np.zeros(len(n), np.int64)
                windows = np.lib.stride_tricks.sliding_window_view(data, taps)
                for k in range(0, len(n), _PIECE):
                    used, which = np.unique(phase[k : k + _PIECE], return_inverse=True)
                    made[k : k + _PIECE] = (windows[place[k : k + _PIECE] + 1] * weights(used, up, down, taps)[which]).sum(axis=1)
                first.append(-(-at * up // down))
                out.append((made + (1 << (BITS - 1))) >> BITS)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *out])))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*keys, *order)], pa.array(first, pa.int64()), lists], [*keys, *order, "first", "samples"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*keys, *order))
    return rows.mapInArrow(step, f"{kinds}, first long, samples array<long>")
