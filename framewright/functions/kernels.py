"""Array kernels in whole numbers. A kernel is a function of values that can be added, subtracted and shifted: arrays of numpy that hold one value of many blocks, or text of SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Sql(str):
    """Text of an SQL expression under + - * and shifts."""

    def __add__(self, x):
        return Sql(f"({str(self)} + {x!s})")

    def __radd__(self, x):
        return Sql(f"({x!s} + {str(self)})")

    def __sub__(self, x):
        return Sql(f"({str(self)} - {x!s})")

    def __rsub__(self, x):
        return Sql(f"({x!s} - {str(self)})")

    def __mul__(self, x):
        return Sql(f"({str(self)} * {x!s})")

    def __rmul__(self, x):
        return Sql(f"({x!s} * {str(self)})")

    def __neg__(self):
        return Sql(f"(-{str(self)})")


def shift(x, n: int):
    """x >> n, rounding down."""
    if isinstance(x, Sql):
        return Sql(f"({x!s} >> {n})")
    return F.shiftright(x, n) if isinstance(x, Column) else x >> n


def inverse4(x: list) -> list:
    """Four-point inverse transform."""
    a, b = x[0] + x[2], x[0] - x[2]
    c, d = shift(x[1], 1) - x[3], x[1] + shift(x[3], 1)
    return [a + d, b + c, b - c, a - d]


def inverse8(x: list) -> list:
    """Eight-point inverse transform: the four-point one on even inputs, butterflies on odd ones."""
    e = inverse4([x[0], x[2], x[4], x[6]])
    a1 = x[5] - x[3] - x[7] - shift(x[7], 1)
    a3 = x[1] + x[7] - x[3] - shift(x[3], 1)
    a5 = x[7] - x[1] + x[5] + shift(x[5], 1)
    a7 = x[3] + x[5] + x[1] + shift(x[1], 1)
    o = [a7 - shift(a1, 2), shift(a3, 2) - a5, a3 + shift(a5, 2), a1 + shift(a7, 2)]
    return [e[0] + o[0], e[1] + o[1], e[2] + o[2], e[3] + o[3], e[3] - o[3], e[2] - o[2], e[1] - o[1], e[0] - o[0]]


def hadamard4(x: list) -> list:
    a, b, c, d = x[0] + x[1], x[0] - x[1], x[2] + x[3], x[2] - x[3]
    return [a + c, a - c, b - d, b + d]


def dct4(x: list) -> list:
    """Four-point inverse cosine transform in 14-bit fixed point; each product is rounded. 11585, 6270 and 15137 are fixed values of the standard."""
    r = lambda v: shift(v + 8192, 14)
    a, b = r((x[0] + x[2]) * 11585), r((x[0] - x[2]) * 11585)
    c, d = r(x[1] * 6270 - x[3] * 15137), r(x[1] * 15137 + x[3] * 6270)
    return [a + d, b + c, b - c, a - d]


def adst4(x: list) -> list:
    """Four-point inverse sine transform, rounded once at the end. 5283, 9929, 13377 and 15212 are fixed values of the standard."""
    r = lambda v: shift(v + 8192, 14)
    s0, s1, s2 = x[0] * 5283 + x[2] * 15212, x[0] * 9929 - x[2] * 5283, x[1] * 13377
    s0, s1 = s0 + x[3] * 9929, s1 - x[3] * 15212
    s3 = (x[0] - x[2] + x[3]) * 13377
    return [r(s0 + s2), r(s1 + s2), r(s3), r(s0 + s1 - s2)]


def rows(a: Column | str, n: int) -> Column:
    """A flat array as n rows of n."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.slice(a, r * n + 1, n))


def transposed(m: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(m, lambda row: F.element_at(row, i + 1)))


def over_blocks(a: Column | str, n: int, kernel: Callable[[list], list], column_kernel: Callable[[list], list] | None = None, height: int | None = None) -> Column:
    """The kernel on each row of ``n`` of flat arrays of ``height`` rows, then ``column_kernel`` (if any) on each column.

    All blocks of an Arrow batch take each step of the kernel together. A null array
    gives null; one of another length fails.
    """

    @F.arrow_udf("array<bigint>")
    def run(a: pa.Array) -> pa.Array:
        there, valid = a.drop_null(), a.is_valid().to_numpy(zero_copy_only=False)
        x = there.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(there), height or n, n)
        x = np.stack(kernel([x[:, :, i] for i in range(n)]), axis=2)
        if column_kernel:
            x = x.transpose(0, 2, 1)
            x = np.stack(column_kernel([x[:, :, i] for i in range(x.shape[2])]), axis=2).transpose(0, 2, 1)
        ends = np.append(0, np.cumsum(valid * (x.shape[1] * x.shape[2]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~valid, False)), pa.array(np.ascontiguousarray(x).ravel()))

    return run(F.col(a) if isinstance(a, str) else a)


def two_pass(a: Column | str, n: int, kernel: Callable[[list], list]) -> Column:
    """Rows, then columns, as a flat array in the order of rows."""
    return over_blocks(a, n, kernel, kernel)


# ---- transforms of 8, 16 and 32 points, as the standard states them: steps on numbered places

#: A step: places a and b, and the angle of a rotation in 128ths of a half turn (None: sum and difference), whether both swap then, and whether it is rounded.
Step = tuple[int, int, "int | None", bool, bool]


def cosine(angle: int) -> int:
    """cos(angle * pi / 128) in 14 bits."""
    return int(round(16384 * np.cos(angle * np.pi / 128)))


def _reversed(i: int, bits: int) -> int:
    return int(f"{i:0{bits}b}"[::-1], 2)


def _turn(a: int, b: int, angle: int, swap: bool = True) -> Step:
    return a, b, angle, swap, True


def _sum(a: int, b: int, flip: int = 0) -> Step:
    return (b, a, None, False, False) if flip else (a, b, None, False, False)


def cosine_steps(bits: int) -> list[Step]:
    """Steps of the inverse cosine transform of 2**bits points (8 to 32), its inputs in bit-reversed order."""
    n = bits
    out: list[Step] = []
    if n >= 5:
        out += [_turn(16 + i, 31 - i, 6 + (_reversed(7 - i, 3) << 3), False) for i in range(8)]
    if n >= 4:
        out += [_turn(8 + i, 15 - i, 12 + (_reversed(3 - i, 2) << 4), False) for i in range(4)]
    if n >= 5:
        out += [_sum(16 + 2 * i, 17 + 2 * i, i & 1) for i in range(8)]
    out += [_turn(4 + i, 7 - i, 56 - 32 * i, False) for i in range(2)]
    if n >= 4:
        out += [_sum(8 + 2 * i, 9 + 2 * i, i & 1) for i in range(4)]
    if n >= 5:
        out += [_turn(30 - 4 * i - j, 17 + 4 * i + j, 24 + (j << 6) + ((1 - i) << 5)) for i in range(2) for j in range(2)]
    out += [_turn(2 * i, 2 * i + 1, 32 + 16 * i, not i) for i in range(2)]
    out += [_sum(4 + 2 * i, 5 + 2 * i, i) for i in range(2)]
    if n >= 4:
        out += [_turn(14 - i, 9 + i, 48 + 64 * i) for i in range(2)]
    if n >= 5:
        out += [_sum(16 + 4 * i + j, 19 + 4 * i - j, i & 1) for i in range(4) for j in range(2)]
    out += [_sum(i, 3 - i) for i in range(2)] + [_turn(6, 5, 32)]
    if n >= 4:
        out += [_sum(8 + 4 * i + j, 11 + 4 * i - j, i) for i in range(2) for j in range(2)]
    if n >= 5:
        out += [_turn(29 - i, 18 + i, 48 + (i >> 1) * 64) for i in range(4)]
    out += [_sum(i, 7 - i) for i in range(4)]
    if n >= 4:
        out += [_turn(13 - i, 10 + i, 32) for i in range(2)]
    if n >= 5:
        out += [_sum(16 + 8 * i + j, 23 + 8 * i - j, i) for i in range(2) for j in range(4)]
    if n >= 4:
        out += [_sum(i, 15 - i) for i in range(8)]
    if n >= 5:
        out += [_turn(27 - i, 20 + i, 32) for i in range(4)] + [_sum(i, 31 - i) for i in range(16)]
    return out


def sine_steps(bits: int) -> list[Step]:
    """Steps of the inverse sine transform of 8 or 16 points; its first rotations are rounded after the sums that follow them."""
    loose = lambda a, b, angle: (a, b, angle, True, False)
    tight = lambda a, b: (a, b, None, False, True)
    if bits == 3:
        out = [loose(2 * i, 2 * i + 1, 60 - 16 * i) for i in range(4)] + [tight(i, 4 + i) for i in range(4)]
        out += [loose(4 + 3 * i, 5 + i, 48 - 32 * i) for i in range(2)] + [_sum(i, 2 + i) for i in range(2)] + [tight(4 + i, 6 + i) for i in range(2)]
        return out + [_turn(2 + 4 * i, 3 + 4 * i, 32) for i in range(2)]
    out = [loose(2 * i, 2 * i + 1, 62 - 8 * i) for i in range(8)] + [tight(i, 8 + i) for i in range(8)]
    out += [x for i in range(2) for x in (loose(8 + 2 * i, 9 + 2 * i, 56 - 32 * i), loose(13 + 2 * i, 12 + 2 * i, 8 + 32 * i))]
    out += [_sum(i, 4 + i) for i in range(4)] + [tight(8 + i, 12 + i) for i in range(4)]
    out += [loose(4 + 8 * j + 3 * i, 5 + 8 * j + i, 48 - 32 * i) for i in range(2) for j in range(2)]
    out += [(_sum if j % 2 == 0 else tight)(4 * j + i, 2 + 4 * j + i) for i in range(2) for j in range(4)]
    return out + [_turn(2 + 4 * i, 3 + 4 * i, 32) for i in range(4)]


def places(bits: int, sine: bool) -> tuple[list[int], list[tuple[int, int]]]:
    """Which input goes to each place, and which place each output is taken from, with its sign."""
    n = 1 << bits
    if not sine:
        return [_reversed(i, bits) for i in range(n)], [(i, 1) for i in range(n)]
    gray = [_reversed(i ^ (i >> 1), bits) for i in range(n)]
    return [i - 1 if i & 1 else n - i - 1 for i in range(n)], [(g, -1 if i & 1 else 1) for i, g in enumerate(gray)]


def stepped(bits: int, sine: bool = False) -> Callable[[list], list]:
    """The transform of 2**bits points as a kernel."""
    steps, (first, last) = sine_steps(bits) if sine else cosine_steps(bits), places(bits, sine)

    def kernel(x: list) -> list:
        t = [x[i] for i in first]
        for a, b, angle, swap, rounded in steps:
            if angle is None:
                p, q = t[a] + t[b], t[a] - t[b]
            else:
                p, q = t[a] * cosine(angle) - t[b] * cosine(64 - angle), t[a] * cosine(64 - angle) + t[b] * cosine(angle)
            if rounded:
                p, q = (p + 8192) >> 14, (q + 8192) >> 14
            t[a], t[b] = (q, p) if swap else (p, q)
        return [t[i] * sign for i, sign in last]

    return kernel


def sql_stepped(source: str, keys: str, bits: int, sine: bool = False) -> str:
    """The same in SQL: ``source`` gives keys and x, a list of 2**bits numbers; a query for each step gives keys and y."""
    steps, (first, last) = sine_steps(bits) if sine else cosine_steps(bits), places(bits, sine)
    n = len(first)
    text = f"SELECT {keys}, {', '.join(f'x[{f + 1}] AS t{i}' for i, f in enumerate(first))} FROM ({source})"
    at = 0
    while at < len(steps):
        group: list[Step] = []
        used: set[int] = set()
        while at < len(steps) and not used & {steps[at][0], steps[at][1]}:  # steps on other places
            group.append(steps[at])
            used |= {steps[at][0], steps[at][1]}
            at += 1
        new = {}
        for a, b, angle, swap, rounded in group:
            p, q = (f"t{a} + t{b}", f"t{a} - t{b}") if angle is None else (f"t{a} * ({cosine(angle)}) - t{b} * ({cosine(64 - angle)})", f"t{a} * ({cosine(64 - angle)}) + t{b} * ({cosine(angle)})")
            p, q = (f"({v} + 8192) >> 14" for v in (p, q)) if rounded else (p, q)
            new[a], new[b] = (q, p) if swap else (p, q)
        text = f"SELECT {keys}, {', '.join(f'{new[i]} AS t{i}' if i in new else f't{i}' for i in range(n))} FROM ({text})"
    return f"SELECT {keys}, [{', '.join(f'{sign} * t{i}' for i, sign in last)}] AS y FROM ({text})"


def walsh4(x: list, first: bool = True) -> list:
    """Four-point inverse Walsh-Hadamard transform without loss; the first turn drops two bits."""
    a, c, d, b = (shift(v, 2) if first else v for v in x)
    a, d = a + c, d - b
    e = shift(a - d, 1)
    b, c = e - b, e - c
    return [a - b, b, c, d + c]


def sql_two_pass(a: str, n: int, kernel: Callable[[list], list]) -> str:
    """The same in SQL, with lists that count from one."""
    one = "[" + ", ".join(kernel([Sql(f"row[{i + 1}]") for i in range(n)])) + "]"
    turn = lambda m: f"list_transform(range(1, {n + 1}), lambda i: list_transform({m}, lambda row: row[i]))"
    m = f"list_transform(list_transform(range(0, {n}), lambda r: ({a})[r * {n} + 1:r * {n} + {n}]), lambda row: {one})"
    m = f"list_transform({turn(m)}, lambda row: {one})"
    return f"flatten({turn(m)})"


def clip(x: Column, lo: int = 0, hi: int = 255) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def listed(x: Column) -> Column:
    """An array as text, so that results are compared as a whole."""
    return F.array_join(x.cast("array<string>"), ",")


# ---- directional prediction of n by n blocks from their edges


def soft2(a, b):
    return shift(a + b + 1, 1)


def soft3(a, b, c):
    return shift(a + b * 2 + c + 2, 2)


def directions(e: list, n: int, plain: bool = False) -> dict[str, list]:
    """Predictions in the order of rows, from edges e: left from below up, the corner, then above and above right (n, 1, 2n values).

    ``plain`` is the rule of the codec without softened edges: to the left, blocks of more than
    four samples a side end with the last sample right above them, and a block of four with its
    last sample above.
    """
    top, left = (lambda i: e[n + 1 + i]), (lambda i: e[n - 1 - i])  # left(-1) and top(-1) are the corner
    end = n - 1 if plain and n > 4 else 2 * n - 1
    above = lambda i: top(min(i, end))
    cells = [(y, x) for y in range(n) for x in range(n)]

    def right(y, x):  # steep, to the right
        z, k = 2 * x - y, x - (y >> 1)
        if z >= 0:
            return soft3(top(k - 2), top(k - 1), top(k)) if z & 1 else soft2(top(k - 1), top(k))
        return soft3(left(0), e[n], top(0)) if z == -1 else soft3(left(y - 2 * x - 1), left(y - 2 * x - 2), left(y - 2 * x - 3))

    def down(y, x):  # flat, downwards
        z, k = 2 * y - x, y - (x >> 1)
        if z >= 0:
            return soft3(left(k - 2), left(k - 1), left(k)) if z & 1 else soft2(left(k - 1), left(k))
        return soft3(left(0), e[n], top(0)) if z == -1 else soft3(top(x - 2 * y - 1), top(x - 2 * y - 2), top(x - 2 * y - 3))

    def up(y, x):  # flat, upwards
        z, k = x + 2 * y, y + (x >> 1)
        if z > 2 * n - 3:
            return left(n - 1)
        if z == 2 * n - 3:
            return soft3(left(n - 2), left(n - 1), left(n - 1))
        return soft3(left(k), left(k + 1), left(k + 2)) if z & 1 else soft2(left(k), left(k + 1))

    def down_left(y, x):
        i = x + y
        if plain and n == 4 and i == 2 * n - 2:
            return top(end)
        return soft3(above(i), above(i + 1), above(i + 2))

    def left_of(y, x):  # steep, to the left
        k = x + (y >> 1)
        return soft3(above(k), above(k + 1), above(k + 2)) if y & 1 else soft2(above(k), above(k + 1))

    total = e[0]
    for i in [*range(1, n), *range(n + 1, 2 * n + 1)]:
        total = total + e[i]
    mean = shift(total + n, (2 * n).bit_length() - 1)
    rules = {
        "vertical": lambda y, x: top(x),
        "horizontal": lambda y, x: left(y),
        "mean": lambda y, x: mean,
        "down_left": down_left,
        "down_right": lambda y, x: soft3(e[n + x - y - 1], e[n + x - y], e[n + x - y + 1]),
        "vertical_right": right,
        "horizontal_down": down,
        "vertical_left": left_of,
        "horizontal_up": up,
    }
    return {name: [rule(y, x) for y, x in cells] for name, rule in rules.items()}


def smooth_edges(e: list, n: int) -> list:
    """Edges softened along their way; both ends lean on themselves."""
    last = len(e) - 1
    return [soft3(e[max(i - 1, 0)], e[i], e[min(i + 1, last)]) for i in range(len(e))]


def flat_filter(v: list, reach: int) -> list:
    """Samples across an edge, each as the mean of those within ``reach`` and itself once more; the outermost stand for what lies beyond."""
    last, out = len(v) - 1, [v[0]]
    for i in range(1, last):
        total = v[i] + (reach + 1)
        for j in range(-reach, reach + 1):
            total = total + v[min(max(i + j, 0), last)]
        out.append(shift(total, (2 * reach + 2).bit_length() - 1))
    return [*out, v[last]]


def edge(df: DataFrame) -> DataFrame:
    """df and taps (0, 4, 8 or 16) and out: sixteen samples ``v`` across an edge, filtered.

    df has level (0 to 63), sharp (0 to 7), ours and theirs (widths of the blocks behind and before the
    edge) and x (its place): an edge is where a block of ours begins.
    """
    at = lambda i: F.get("v", F.lit(i))
    p, q = [at(7 - i) for i in range(8)], [at(8 + i) for i in range(8)]
    level, sharp = F.col("level"), F.col("sharp")
    limit = F.when(sharp > 4, F.shiftright(level, 2)).when(sharp > 0, F.shiftright(level, 1)).otherwise(level)
    df = df.withColumn("inner", F.greatest(F.when(sharp > 0, F.least(limit, 9 - sharp)).otherwise(limit), F.lit(1)))
    near = lambda xs, top: F.greatest(*[F.abs(a - b) for a, b in xs]) <= top
    steps = [(p[i + 1], p[i]) for i in range(3)] + [(q[i + 1], q[i]) for i in range(3)]
    on = (F.col("x") % F.col("ours") == 0) & (level > 0) & near(steps, F.col("inner")) & (2 * F.abs(p[0] - q[0]) + F.shiftright(F.abs(p[1] - q[1]), 1) <= F.least(2 * (level + 2) + F.col("inner"), F.lit(255)))
    flat = lambda lo, hi: near([(x[i], x[0]) for x in (p, q) for i in range(lo, hi)], 1)
    width = F.least("ours", "theirs")
    df = df.withColumn("taps", F.when(~on, 0).when((width >= 16) & flat(1, 4) & flat(4, 8), 16).when((width >= 8) & flat(1, 4), 8).otherwise(4))
    top = F.shiftright(level, 4)
    df = df.withColumn("hev", (F.abs(p[1] - p[0]) > top) | (F.abs(q[1] - q[0]) > top))
    df = df.withColumn("f", clip(F.when(F.col("hev"), clip(p[1] - q[1], -128, 127)).otherwise(0) + 3 * (q[0] - p[0]), -128, 127))
    f1, f2 = F.shiftright(F.least(F.col("f") + 4, F.lit(127)), 3), F.shiftright(F.least(F.col("f") + 3, F.lit(127)), 3)
    half, v = F.shiftright(f1 + 1, 1), [at(i) for i in range(16)]
    outer = lambda x, y: F.when(F.col("hev"), x).otherwise(clip(y, 0, 255))
    four = [*v[:6], outer(p[1], p[1] + half), clip(p[0] + f2, 0, 255), clip(q[0] - f1, 0, 255), outer(q[1], q[1] - half), *v[10:]]
    eight = [*v[:4], *flat_filter(v[4:12], 3), *v[12:]]
    kinds = F.when(F.col("taps") == 0, F.col("v")).when(F.col("taps") == 4, F.array(*four)).when(F.col("taps") == 8, F.array(*eight)).otherwise(F.array(*flat_filter(v, 7)))
    return df.withColumn("out", kinds.cast("array<long>"))


def quarter_positions(px: Column) -> Column:
    """For the nine inner samples (rows and columns 2 to 4) of flat blocks of 8 by 8, the sixteen positions from the sample on to the next, by rows of quarters."""
    taps = np.array((1, -5, 20, 20, -5, 1), np.int64)

    @F.arrow_udf("array<array<bigint>>")
    def run(px: pa.Array) -> pa.Array:
        x = px.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 8, 8)
        six = lambda v, axis: np.lib.stride_tricks.sliding_window_view(v, 6, axis=axis) @ taps
        half = lambda v: np.clip((v + 16) >> 5, 0, 255)
        across, down = six(x, 2), six(x, 1)  # places 0, 1 and 2 are the samples 2, 3 and 4
        both = np.clip((six(across, 1) + 512) >> 10, 0, 255)
        g, right, below = x[:, 2:5, 2:5], x[:, 2:5, 3:6], x[:, 3:6, 2:5]
        b, s, h, m = half(across[:, 2:5]), half(across[:, 3:6]), half(down[:, :, 2:5]), half(down[:, :, 3:6])
        mean = lambda v, w: (v + w + 1) >> 1
        out = [g, mean(g, b), b, mean(b, right), mean(g, h), mean(b, h), mean(b, both), mean(b, m), h, mean(h, both), both, mean(both, m), mean(h, below), mean(h, s), mean(both, s), mean(m, s)]
        flat = np.stack(out, axis=3).reshape(-1)
        inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 16, dtype=np.int32)), pa.array(flat))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, 9 * len(x) + 1, 9, dtype=np.int32)), inner)

    return run(px)
