"""Column functions against plain Python."""

from __future__ import annotations

import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import bits, kernels, noise, prefix
from framewright.functions import timebase as tb, prefix
from framewright.operators import matching, scan


def test_reduce_and_compare(spark):
    pairs = [(a, b, c, d) for a in (-6, 0, 4, 9_000_000_000) for b in (-4, 0, 6) for c in (3, -2) for d in (0, 5)]
    df = spark.createDataFrame(pairs, "a long, b long, c long, d long")
    for r in df.withColumn("r", tb.reduce(F.col("a"), F.col("b"))).withColumn("k", tb.compare(*(F.col(x) for x in "abcd"))).collect():
        g = max(math.gcd(r["a"], r["b"]), 1)
        sign = -1 if (r["a"] < 0) != (r["b"] < 0) else 1
        assert tuple(r["r"]) == (sign * (abs(r["a"]) // g), abs(r["b"]) // g)
        if r["b"] and r["d"]:
            x, y = Fraction(r["a"], r["b"]), Fraction(r["c"], r["d"])
            assert r["k"] == (x > y) - (x < y)


def test_rescale(spark):
    rows = [(a, b, c) for a in (-(2**62), -7, -1, 0, 5, 2**62) for b in (0, 1, 7, 2**31 - 1) for c in (1, 2, 3, 2**31 - 1)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    modes = ("zero", "inf", "down", "up", "near")
    found = df.where("abs(a) < 100 or b < 2").select("a", "b", "c", *[tb.rescale(F.col("a"), F.col("b"), F.col("c"), m).alias(m) for m in modes]).collect()
    for r in found:
        x = Fraction(r["a"] * r["b"], r["c"])
        size = abs(x)
        want = {"zero": math.floor(size), "inf": math.ceil(size), "near": math.floor(size + Fraction(1, 2))}
        sign = -1 if x < 0 else 1
        assert (r["zero"], r["inf"], r["near"]) == tuple(sign * want[m] for m in ("zero", "inf", "near"))
        assert (r["down"], r["up"]) == (math.floor(x), math.ceil(x))


def test_checksums_and_codes(spark):
    texts = ["", "a", "hello wörld", "x" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", bits.adler32(F.encode("t", "utf-8")).alias("a")).collect():
        assert r["a"] == zlib.adler32(r["t"].encode())
    n = spark.range(300)
    assert all(r["v"] == r["id"] for r in n.select("id", bits.read_ue(bits.ue_code(F.col("id"))).alias("v")).collect())
    got = n.limit(5).select(bits.signed(F.col("id")).alias("s")).collect()
    assert [r["s"] for r in got] == [0, 1, -1, 2, -2]


def test_kernels_do_the_same_in_sql_and_in_columns(spark):
    import duckdb

    x = [(i * 37 % 201) - 100 for i in range(64)]
    df = spark.createDataFrame([(x,)], "a array<long>")
    for n, kernel in ((8, kernels.inverse8), (4, kernels.inverse4), (4, kernels.dct4), (4, kernels.adst4)):
        got = df.select(kernels.two_pass(F.slice("a", 1, n * n), n, kernel).alias("o")).first()["o"]
        assert got == duckdb.sql(f"SELECT {kernels.sql_two_pass(str(x[: n * n]), n, kernel)}").fetchall()[0][0]


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_scans_agree_with_a_plain_loop(spark, ranges):
    rows = [(k, i, (i * 7 + (k or 5)) % 5 if i % 3 else None) for k in (0, 1, None) for i in range(50)]
    df = scan.ranged(spark.createDataFrame(rows, "k int, t long, v long"), ["k"], ["t"], ranges)
    df = scan.running_sum(df, ["k"], ["t"], F.col("v"), "s")
    df = scan.last_known(df, ["k"], ["t"], F.col("v"), "l")
    df = scan.neighbour(df, ["k"], ["t"], F.col("v"), "n")
    df = scan.neighbour(df, ["k"], ["t"], F.col("v"), "p", step=-1)
    df = scan.with_halo(df, ["k"], ["t"], F.col("v"), "h", 3)
    df = scan.with_halo(df, ["k"], ["t"], F.col("t"), "f", 20, step=1)
    got = {(x["k"], x["t"]): (x["s"], x["l"], x["n"], x["p"], x["h"], x["f"]) for x in df.collect()}
    assert len(got) == len(rows)
    for k in (0, 1, None):
        own, total, last = [x for x in rows if x[0] == k], 0, None
        values, times = [x[2] for x in own], [x[1] for x in own]
        for i, (_, t, v) in enumerate(own):
            last = v if v is not None else last
            want = (total, last, own[i + 1][2] if i + 1 < len(own) else None, own[i - 1][2] if i else None, values[max(i - 3, 0) : i], times[i + 1 : i + 21])
            assert got[k, t] == want
            total += v or 0


def test_equal_times_are_split_by_their_ties(spark):
    df = scan.ranged(spark.range(5000).selectExpr("0 AS t", "id"), [], ["t", "id"], 8)
    assert max(r["count"] for r in df.groupBy("_r").count().collect()) < 2500
    got = scan.row_number(df, [], ["t", "id"], "n").where("n <> id + 1").count()
    assert got == 0


def test_as_of_and_runs(spark):
    left = spark.createDataFrame([(t,) for t in range(0, 60, 7)], "t long")
    right = spark.createDataFrame([(t,) for t in (5, 21, 22, 50)], "t long")
    got = matching.as_of(left, right, [], "t", F.col("t"), "m").collect()
    assert {r["t"]: r["m"] for r in got} == {t: max((x for x in (5, 21, 22, 50) if x <= t), default=None) for t in range(0, 60, 7)}
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])], "t long, v string")
    runs = matching.run_lengths(df, [], ["t"], "v").orderBy("run").collect()
    assert [(r["v"], r["n"]) for r in runs] == [("a", 2), (None, 2), ("b", 1), ("a", 1)]


@pytest.mark.parametrize("bits_,sine", [(3, False), (4, False), (5, False), (3, True), (4, True)])
def test_stepped_transforms_are_near_the_exact_ones(bits_, sine):
    n, rng = 1 << bits_, np.random.default_rng(bits_)
    x, i = rng.integers(-2000, 2000, (50, n)), np.arange(n)
    if sine:
        exact = np.sin(np.pi * np.outer(2 * i + 1, 2 * i + 1) / (4 * n))
    else:
        exact = np.cos(np.pi * np.outer(2 * i + 1, i) / (2 * n)) * np.where(i == 0, 0.5**0.5, 1)
    got = np.stack(kernels.stepped(bits_, sine)([x[:, j] for j in range(n)]), axis=1)
    assert np.abs(got - x @ exact.T).max() < 6


def test_walsh_goes_back_without_loss():
    def forward(x):
        a, b, c, d = x
        a, d = a + b, d - c
        e = (a - d) >> 1
        b, c = e - b, e - c
        return [a - c, c, d + b, b]

    x = np.random.default_rng(1).integers(-255, 255, (100, 4))
    got = kernels.walsh4([v * 4 for v in forward([x[:, i] for i in range(4)])])
    assert np.array_equal(np.stack(got, axis=1), x)


@pytest.mark.parametrize("n", [4, 8])
def test_directions_follow_their_edges(n):
    """Level edges give level blocks; a mirrored pair of edges gives mirrored blocks; each direction carries a stripe along itself."""
    flat = kernels.directions([7] * (3 * n + 1), n)
    assert all(set(v) == {7} for v in flat.values()) and len(flat) == 9
    rng = np.random.default_rng(n)
    left, corner, top = rng.integers(0, 255, n).tolist(), 9, rng.integers(0, 255, 2 * n).tolist()
    one = kernels.directions([*left[::-1], corner, *top], n)
    other = kernels.directions([*top[:n][::-1], corner, *left, *[0] * n], n)
    turned = lambda v: np.array(v).reshape(n, n).T.ravel().tolist()
    assert one["vertical"] == turned(other["horizontal"]) and one["down_right"] == turned(other["down_right"]) and one["vertical_right"] == turned(other["horizontal_down"])
    assert np.array(one["down_left"]).reshape(n, n)[0, 1:].tolist() == np.array(one["down_left"]).reshape(n, n)[1, :-1].tolist()


def test_blocks_without_values(spark):
    df = spark.createDataFrame([([1] * 16,), (None,), ([2] * 16,)], "a array<long>")
    got = [r["o"] for r in df.coalesce(1).select(kernels.two_pass("a", 4, kernels.hadamard4).alias("o")).collect()]
    assert got[1] is None and len(got[0]) == len(got[2]) == 16 and df.where("a is null").select(kernels.two_pass("a", 4, kernels.hadamard4).alias("o")).first()["o"] is None


def test_prefix_codes_read_back_what_they_write(spark):
    rng = random.Random(4)
    texts = [None, "", "a", "é" * 3000, "".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(9000))] + ["".join(rng.choice("etaoin  \n") for _ in range(rng.randrange(9000))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    pieces = prefix.blocks(df, ["i"], "t")
    table = prefix.codes(prefix.counts(pieces))
    codes = [(r["context"], r["code"]) for r in table.collect()]
    assert max(len(c) for _, c in codes) > prefix.FIRST and max(len(c) for _, c in codes) <= prefix.LONGEST
    assert not any(a is not b and a[0] == b[0] and b[1].startswith(a[1]) for a in codes for b in codes)
    back: dict = {}
    for r in prefix.round_trip(pieces, table).orderBy("i", "block").collect():
        back[r["i"]] = back.get(r["i"], b"") + bytes(r["decoded"])
        assert len(r["packed"]) == (r["n_bits"] + 7) // 8 and r["n_bytes"] <= prefix.BLOCK
    assert back == {i: t.encode() for i, t in enumerate(texts) if t}


def test_noise_begins_at_any_sample(spark):
    x, states = 1, [1]
    for _ in range(3000):
        x = (x * 314_159 + 1) % (1 << 32)
        states.append(x)
    got = spark.range(3001).select(noise.state_at(F.col("id")).alias("x")).collect()
    assert [r["x"] for r in got] == states
    far = 1 << 40
    a, c = noise.affine_power(far)
    assert spark.range(1).select(noise.state_at(F.lit(far + 1).cast("long")).alias("x")).first()["x"] == ((a + c) * 314_159 + 1) % (1 << 32)
    row = spark.range(1).select(noise.noise_from(F.lit(states[100]).cast("long"), 50, 20_000).alias("v")).first()["v"]
    assert row == [s % 20_000 - 10_000 for s in states[101:151]]


def test_cosine(spark):
    got = spark.range(-70_000, 140_000, 37).select("id", noise.cosine(F.col("id")).alias("c")).collect()
    assert max(abs(r["c"] - 65_536 * math.cos(2 * math.pi * r["id"] / 65_536)) for r in got) < 8
