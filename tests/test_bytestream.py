"""Byte streams: any cut into chunks gives the same units and pictures as the whole."""

from __future__ import annotations

import random

import pytest

from framewright.operators import bytestream, scan


def plain_units(data: bytes):
    """(pos, size, first, second, total), by looking for the next code from the end of the last."""
    codes, i = [], 0
    while i + 2 < len(data):
        if data[i : i + 3] == b"\0\0\1":
            codes.append((i, 3))
            i += 3
        elif data[i : i + 4] == b"\0\0\0\1":
            codes.append((i, 4))
            i += 4
        else:
            i += 1
    out = []
    for n, (at, size) in enumerate(codes):
        begin, end = at + size, codes[n + 1][0] if n + 1 < len(codes) else len(data)
        if end > begin:
            out.append((begin, end - begin, data[begin], data[begin + 1] if end - begin > 1 else -1, sum(data[begin:end])))
    return out


def plain_pictures(units):
    out = []
    for n, (_, size, first, second, _) in enumerate(units):
        kind = first & 31
        begins = kind in bytestream.HEADS or kind in bytestream.SLICES and second >= 128
        if not out or begins and out[-1]["slice"]:
            out.append({"slice": False, "first": n + 1, "parts": 0, "bytes": 0, "key": False})
        p = out[-1]
        p["parts"] += 1
        p["bytes"] += size
        p["slice"] |= kind in bytestream.SLICES
        p["key"] |= kind == 5
    return [(n + 1, p["first"], p["parts"], p["bytes"], p["key"]) for n, p in enumerate(out)]


def stream(seed, n):
    rng = random.Random(seed)
    return bytes(rng.choice([0, 0, 0, 1, 1, 0x65, 0x41, 0x67, 0x09, 0x80, 0xFF]) for _ in range(n))


@pytest.mark.parametrize(("longest", "ranges"), [(1, 5), (2, 1), (4, 9), (50, 3), (10_000, 1)])
def test_chunks_and_whole_streams_agree(spark, longest, ranges):
    rng, rows, want = random.Random(longest), [], {}
    for key, n in (("a", 900), ("b", 3), (None, 400), ("none", 0), ("codes", 0)):
        data = b"\0\0\0\1" * 5 if key == "codes" else stream(n, n)
        want[key] = plain_units(data)
        at = i = 0
        while at < len(data):
            size = min(longest, rng.randint(0 if rng.random() < 0.3 else longest, longest))
            rows.append((key, i, data[at : at + size] if size else rng.choice([None, b""])))
            at, i = at + size, i + 1
    df = spark.createDataFrame(rows, "k string, i int, b binary").repartition(4)
    before = scan.ranged
    try:
        bytestream.ranged = lambda d, keys, order: before(d, keys, order, ranges)
        found = bytestream.units(df, ["k"], ["i"], "b")
        got: dict = {k: [] for k in want}
        for r in found.orderBy("k", "unit").collect():
            assert r["unit"] == len(got[r["k"]]) + 1
            got[r["k"]].append((r["pos"], r["size"], r["first"], r["second"], r["total"]))
        assert got == want
        pictures: dict = {k: [] for k in want}
        for r in bytestream.pictures(found, ["k"]).orderBy("k", "picture").collect():
            pictures[r["k"]].append((r["picture"], r["first_unit"], r["parts"], r["bytes"], r["is_key"]))
        assert pictures == {k: plain_pictures(u) for k, u in want.items()}
    finally:
        bytestream.ranged = before
