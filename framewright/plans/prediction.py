"""Transforms of 8 to 32 points, directional prediction, interpolation with clamped edges, filters across edges, resampling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import kernels as k
from ..tables import BLOCKS, blocks

#: Taps of the regular eight-tap filter for whole and up to half positions, in sixteenths: fixed values. The others are these from the other end.
TAPS = (
    (0, 0, 0, 128, 0, 0, 0, 0),
    (0, 1, -5, 126, 8, -3, 1, 0),
    (-1, 3, -10, 122, 18, -6, 2, 0),
    (-1, 4, -13, 118, 27, -9, 3, -1),
    (-1, 4, -16, 112, 37, -11, 4, -1),
    (-1, 5, -18, 105, 48, -14, 4, -1),
    (-1, 5, -19, 97, 58, -16, 5, -1),
    (-1, 6, -19, 88, 68, -18, 5, -1),
    (-1, 6, -19, 78, 78, -19, 6, -1),
)
PHASES = TAPS + tuple(t[::-1] for t in TAPS[7:0:-1])


def _rows(sine: bool, sizes: tuple[int, ...]) -> str:
    parts = [f"d{b} AS ({k.sql_stepped(f'SELECT vec_id, a[1:{1 << b}] AS x FROM blocks', 'vec_id', b, sine)})" for b in sizes]
    cols = ", ".join(f"array_to_string(d{b}.y, ',') AS t{1 << b}" for b in sizes)
    joins = " ".join(f"JOIN d{b} USING (vec_id)" for b in sizes[1:])
    return f"WITH {BLOCKS}, {', '.join(parts)} SELECT vec_id, {cols} FROM d{sizes[0]} {joins}"


@query(_rows(False, (3, 4, 5)))
def cosine_rows(spark, sf_dir):
    """Inverse cosine transforms of 8, 16 and 32 points, rounded after every rotation."""
    each = [k.listed(k.over_blocks(F.slice("a", 1, 1 << b), 1 << b, k.stepped(b), height=1)).alias(f"t{1 << b}") for b in (3, 4, 5)]
    return blocks(spark, sf_dir).select("vec_id", *each)


@query(_rows(True, (3, 4)))
def sine_rows(spark, sf_dir):
    """Inverse sine transforms of 8 and 16 points."""
    each = [k.listed(k.over_blocks(F.slice("a", 1, 1 << b), 1 << b, k.stepped(b, True), height=1)).alias(f"t{1 << b}") for b in (3, 4)]
    return blocks(spark, sf_dir).select("vec_id", *each)


def _square(first: bool, second: bool) -> str:
    rows = k.sql_stepped("SELECT vec_id, r, a[r * 8 + 1:r * 8 + 8] AS x FROM blocks, range(8) t(r)", "vec_id, r", 3, first)
    columns = k.sql_stepped("SELECT vec_id, c, list(y[c + 1] ORDER BY r) AS x FROM p, range(8) t(c) GROUP BY vec_id, c", "vec_id, c", 3, second)
    return f"WITH {BLOCKS}, p AS ({rows}), q AS ({columns}) SELECT vec_id, string_agg(CAST((y[r + 1] + 16) >> 5 AS VARCHAR), ',' ORDER BY r, c) AS px FROM q, range(8) t(r) GROUP BY vec_id"


@query(_square(False, False))
def cosine8x8(spark, sf_dir):
    """Eight-point cosine transform of rows and columns, as a residual."""
    px = k.over_blocks("a", 8, k.stepped(3), k.stepped(3))
    return blocks(spark, sf_dir).select("vec_id", k.listed(F.transform(px, lambda x: F.shiftright(x + 16, 5))).alias("px"))


@query(_square(True, False))
def sine_cosine8x8(spark, sf_dir):
    """Sine transform of rows and cosine transform of columns."""
    px = k.over_blocks("a", 8, k.stepped(3, True), k.stepped(3))
    return blocks(spark, sf_dir).select("vec_id", k.listed(F.transform(px, lambda x: F.shiftright(x + 16, 5))).alias("px"))


def _reconstructed(bits: int) -> str:
    n = 1 << bits
    rows = k.sql_stepped(f"SELECT blk, r, a[r * {n} + 1:r * {n} + {n}] AS x FROM z, range({n}) t(r)", "blk, r", bits)
    columns = k.sql_stepped(f"SELECT blk, c, list(y[c + 1] ORDER BY r) AS x FROM p, range({n}) t(c) GROUP BY blk, c", "blk, c", bits)
    return f"""WITH {BLOCKS}, w AS (SELECT vec_id // {n * n // 64} AS blk, flatten(list(a ORDER BY vec_id)) AS l FROM blocks GROUP BY 1), z AS (SELECT blk, list_concat(l, list_transform(range({n * n} - len(l)), lambda i: 0::BIGINT)) AS a FROM w), p AS ({rows}), q AS ({columns})
SELECT blk, string_agg(CAST(least(greatest((blk * 7 + r * {n} + c) % 256 + ((y[r + 1] + 32) >> 6), 0), 255) AS VARCHAR), ',' ORDER BY r, c) AS px FROM q, range({n}) t(r) GROUP BY blk"""


def _reconstruct(spark, sf_dir, bits: int):
    """Vectors side by side as a block of coefficients (zeros fill the last), transformed, and added to a prediction of 8 bits."""
    n, blk = 1 << bits, F.floor(F.col("vec_id") / ((1 << 2 * bits) // 64))
    each = blocks(spark, sf_dir).groupBy(blk.alias("blk")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "a"))), lambda x: x["a"])).alias("a"))
    each = each.select("blk", F.concat("a", F.array_repeat(F.lit(0).cast("long"), n * n - F.size("a"))).alias("a"))
    px = k.over_blocks("a", n, k.stepped(bits), k.stepped(bits))
    return each.select("blk", k.listed(F.transform(px, lambda x, i: k.clip((F.col("blk") * 7 + i) % 256 + F.shiftright(x + 32, 6), 0, 255))).alias("px"))


@query(_reconstructed(4))
def reconstruct16x16(spark, sf_dir):
    """Blocks of 16 by 16: rows and columns transformed, rounded, added to a prediction and kept in 8 bits."""
    return _reconstruct(spark, sf_dir, 4)


@query(_reconstructed(5))
def reconstruct32x32(spark, sf_dir):
    """Blocks of 32 by 32, as those of 16 by 16."""
    return _reconstruct(spark, sf_dir, 5)


def _walsh_sql() -> str:
    one = lambda first: "[" + ", ".join(k.walsh4([k.Sql(f"row[{i + 1}]") for i in range(4)], first)) + "]"
    turned = lambda m: f"list_transform(range(1, 5), lambda i: list_transform({m}, lambda row: row[i]))"
    rows = f"list_transform(list_transform(range(0, 4), lambda r: a[r * 4 + 1:r * 4 + 4]), lambda row: {one(True)})"
    return f"WITH {BLOCKS} SELECT vec_id, array_to_string(flatten({turned(f'list_transform({turned(rows)}, lambda row: {one(False)})')}), ',') AS px FROM blocks"


@query(_walsh_sql())
def walsh4x4(spark, sf_dir):
    """Walsh-Hadamard transform without loss."""
    px = k.over_blocks(F.slice("a", 1, 16), 4, k.walsh4, lambda x: k.walsh4(x, False))
    return blocks(spark, sf_dir).select("vec_id", k.listed(px).alias("px"))


def _directions(n: int, smooth: bool, at) -> dict[str, list]:
    e = [at(i) for i in range(3 * n + 1)]
    return k.directions(k.smooth_edges(e, n) if smooth else e, n)


def _directions_sql(n: int, smooth: bool) -> str:
    """Softened edges come from a query of their own, so that none is written twice."""
    size = 3 * n + 1
    edges = [f"a[{i + 1}] AS e{i}" for i in range(size)]
    source = f"SELECT vec_id, {', '.join(edges)} FROM blocks"
    if smooth:
        soft = k.smooth_edges([k.Sql(f"e{i}") for i in range(size)], n)
        source = f"SELECT vec_id, {', '.join(f'{x} AS e{i}' for i, x in enumerate(soft))} FROM ({source})"
    out = k.directions([k.Sql(f"e{i}") for i in range(size)], n)
    return f"WITH {BLOCKS} SELECT vec_id, {', '.join(f'''array_to_string([{', '.join(v)}], ',') AS {name}''' for name, v in out.items())} FROM ({source})"


def _directed(spark, sf_dir, n: int, smooth: bool, plain: bool = False):
    size = 3 * n + 1
    df = blocks(spark, sf_dir).select("vec_id", *[F.col("a")[i].alias(f"e{i}") for i in range(size)])
    if smooth:
        df = df.select("vec_id", *[x.alias(f"e{i}") for i, x in enumerate(k.smooth_edges([F.col(f"e{i}") for i in range(size)], n))])
    out = k.directions([F.col(f"e{i}") for i in range(size)], n, plain)
    return df.select("vec_id", *[k.listed(F.array(*v)).alias(name) for name, v in out.items()])


@query(_directions_sql(4, False))
def directions4x4(spark, sf_dir):
    """The nine predictions of a 4 by 4 block from its edges."""
    return _directed(spark, sf_dir, 4, False)


@query(_directions_sql(8, True))
def directions8x8(spark, sf_dir):
    """The nine predictions of an 8 by 8 block from softened edges."""
    return _directed(spark, sf_dir, 8, True)


def _plain_sql(n: int) -> str:
    """Each mode by a formula of its row and column: a[n - y] is on the left, a[n + 1] the corner, a[n + 2 + x] above."""
    up = lambda k: f"a[{n + 2} + {f'least({k}, {n - 1})' if n > 4 else k}]"
    x, y = f"(i % {n})", f"(i // {n})"
    j, k, d, m = f"({n} + {x} - {y})", f"({x} - {y} // 2)", f"({y} - {x} // 2)", f"({y} + {x} // 2)"
    corner = f"(a[{n}] + 2 * a[{n + 1}] + a[{n + 2}] + 2) >> 2"
    left = f"({x} + {y} // 2)"
    modes = {
        "vertical": f"a[{n + 2} + {x}]",
        "horizontal": f"a[{n} - {y}]",
        "mean": f"CAST(list_sum(a[1:{n}]) + list_sum(a[{n + 2}:{2 * n + 1}]) + {n} AS BIGINT) >> {n.bit_length()}",
        "down_left": f"CASE WHEN {n} = 4 AND {x} + {y} = {2 * n - 2} THEN a[{3 * n + 1}] ELSE ({up(f'({x} + {y})')} + 2 * {up(f'({x} + {y} + 1)')} + {up(f'({x} + {y} + 2)')} + 2) >> 2 END",
        "down_right": f"(a[{j}] + 2 * a[{j} + 1] + a[{j} + 2] + 2) >> 2",
        "vertical_right": f"CASE WHEN 2 * {x} - {y} >= 0 AND {y} % 2 = 0 THEN (a[{n + 1} + {k}] + a[{n + 2} + {k}] + 1) >> 1 WHEN 2 * {x} - {y} >= 0 THEN (a[{n} + {k}] + 2 * a[{n + 1} + {k}] + a[{n + 2} + {k}] + 2) >> 2 WHEN 2 * {x} - {y} = -1 THEN {corner} ELSE (a[{n + 1} - {y} + 2 * {x}] + 2 * a[{n + 2} - {y} + 2 * {x}] + a[{n + 3} - {y} + 2 * {x}] + 2) >> 2 END",
        "horizontal_down": f"CASE WHEN 2 * {y} - {x} >= 0 AND {x} % 2 = 0 THEN (a[{n + 1} - {d}] + a[{n} - {d}] + 1) >> 1 WHEN 2 * {y} - {x} >= 0 THEN (a[{n + 2} - {d}] + 2 * a[{n + 1} - {d}] + a[{n} - {d}] + 2) >> 2 WHEN 2 * {y} - {x} = -1 THEN {corner} ELSE (a[{n + 1} + {x} - 2 * {y}] + 2 * a[{n} + {x} - 2 * {y}] + a[{n - 1} + {x} - 2 * {y}] + 2) >> 2 END",
        "vertical_left": f"CASE WHEN {y} % 2 = 0 THEN ({up(left)} + {up(left + ' + 1')} + 1) >> 1 ELSE ({up(left)} + 2 * {up(left + ' + 1')} + {up(left + ' + 2')} + 2) >> 2 END",
        "horizontal_up": f"CASE WHEN {x} + 2 * {y} > {2 * n - 3} THEN a[1] WHEN {x} + 2 * {y} = {2 * n - 3} THEN (a[2] + 3 * a[1] + 2) >> 2 WHEN {x} % 2 = 1 THEN (a[{n} - {m}] + 2 * a[{n - 1} - {m}] + a[{n - 2} - {m}] + 2) >> 2 ELSE (a[{n} - {m}] + a[{n - 1} - {m}] + 1) >> 1 END",
    }
    cells = [f"array_to_string(list_transform(range(0, {n * n}), lambda i: {v}), ',') AS {name}" for name, v in modes.items()]
    return f"WITH {BLOCKS} SELECT vec_id, {', '.join(cells)} FROM blocks"


@query(_plain_sql(8))
def directions8x8_plain(spark, sf_dir):
    """The predictions of an 8 by 8 block from its edges as they are; to the left they end with the last sample right above."""
    return _directed(spark, sf_dir, 8, False, plain=True)


@query(_plain_sql(4))
def directions4x4_plain(spark, sf_dir):
    """The predictions of a 4 by 4 block from its edges as they are."""
    return _directed(spark, sf_dir, 4, False, plain=True)


@query(f"""WITH {BLOCKS}, s AS (SELECT vec_id, a, label % 4 AS m, CAST(list_sum(a[1:16]) AS BIGINT) AS t, CAST(list_sum(a[17:32]) AS BIGINT) AS l FROM blocks)
SELECT vec_id, array_to_string(list_transform(range(0, 256), lambda i: a[i % 16 + 1]), ',') AS vertical, array_to_string(list_transform(range(0, 256), lambda i: a[i // 16 + 17]), ',') AS horizontal,
 CASE m WHEN 0 THEN (t + l + 16) >> 5 WHEN 1 THEN (t + 8) >> 4 WHEN 2 THEN (l + 8) >> 4 ELSE 128 END AS mean FROM s""")
def predict16x16(spark, sf_dir):
    """16 by 16 blocks from the row above, the column on the left, or the mean of the edges there are."""
    total = lambda at: F.aggregate(F.slice("a", at, 16), F.lit(0).cast("long"), lambda s, x: s + x)
    m, t, left = F.col("label") % 4, total(1), total(17)
    cells = F.sequence(F.lit(0), F.lit(255))
    mean = F.when(m == 0, F.shiftright(t + left + 16, 5)).when(m == 1, F.shiftright(t + 8, 4)).when(m == 2, F.shiftright(left + 8, 4)).otherwise(128)
    return blocks(spark, sf_dir).select("vec_id", k.listed(F.transform(cells, lambda i: F.get("a", i % 16))).alias("vertical"), k.listed(F.transform(cells, lambda i: F.get("a", F.floor(i / 16).cast("int") + 16))).alias("horizontal"), mean.alias("mean"))


@query(f"""WITH {BLOCKS}, s AS (SELECT vec_id, label % 4 AS m, [CAST(list_sum(a[1:4]) AS BIGINT), CAST(list_sum(a[5:8]) AS BIGINT)] AS t, [CAST(list_sum(a[9:12]) AS BIGINT), CAST(list_sum(a[13:16]) AS BIGINT)] AS l FROM blocks), c AS (SELECT vec_id, m, t, l, unnest(range(0, 4)) AS part FROM s)
SELECT vec_id, part, CASE WHEN m = 3 THEN 128 WHEN m = 0 AND part IN (0, 3) THEN (t[part % 2 + 1] + l[part // 2 + 1] + 4) >> 3 WHEN m = 1 OR (m = 0 AND part = 1) THEN (t[part % 2 + 1] + 2) >> 2 ELSE (l[part // 2 + 1] + 2) >> 2 END AS mean FROM c""")
def chroma_means(spark, sf_dir):
    """Means of the four parts of a chroma block: both edges on the diagonal, else the edge that is nearer, of those there are."""
    total = lambda at: F.aggregate(F.slice("a", at, 4), F.lit(0).cast("long"), lambda s, x: s + x)
    df = blocks(spark, sf_dir).select("vec_id", (F.col("label") % 4).alias("m"), F.array(total(1), total(5)).alias("t"), F.array(total(9), total(13)).alias("l"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part"))
    m, part = F.col("m"), F.col("part")
    t, left = F.get("t", part % 2), F.get("l", F.floor(part / 2).cast("int"))
    mean = F.when(m == 3, 128).when((m == 0) & part.isin(0, 3), F.shiftright(t + left + 4, 3)).when((m == 1) | ((m == 0) & (part == 1)), F.shiftright(t + 2, 2)).otherwise(F.shiftright(left + 2, 2))
    return df.select("vec_id", part.cast("long").alias("part"), mean.alias("mean"))


_PHASES_SQL = "[" + ", ".join(str(list(t)) for t in PHASES) + "]"


def _taps_sql(source: str, at: str, phase: str) -> str:
    total = " + ".join(f"{_PHASES_SQL}[{phase} + 1][{j + 1}] * {source}[{at.format(j - 3)} + 1]" for j in range(8))
    return f"least(greatest(({total} + 64) >> 7, 0), 255)"


@query(f"""WITH {BLOCKS}, p AS (SELECT vec_id, vec_id % 16 AS mx, label % 16 AS my, list_transform(a, lambda v: (v % 256 + 256) % 256) AS a FROM blocks),
h AS (SELECT vec_id, my, list_transform(range(0, 64), lambda i: {_taps_sql('a', 'i // 8 * 8 + least(greatest(i % 8 + ({}), 0), 7)', 'mx')}) AS h FROM p)
SELECT vec_id, array_to_string(list_transform(range(0, 64), lambda i: {_taps_sql('h', 'least(greatest(i // 8 + ({}), 0), 7) * 8 + i % 8', 'my')}), ',') AS px FROM h""")
def interpolate8x8(spark, sf_dir):
    """Eight taps across, then down, at sixteenth positions; places beyond the picture are its nearest edge."""
    phases = F.array(*[F.array(*map(F.lit, t)) for t in PHASES])
    df = blocks(spark, sf_dir).select("vec_id", F.get(phases, (F.col("vec_id") % 16).cast("int")).alias("tx"), F.get(phases, (F.col("label") % 16).cast("int")).alias("ty"), F.transform("a", lambda v: F.pmod(v, F.lit(256))).alias("a"))
    cells = F.sequence(F.lit(0), F.lit(63))

    def filtered(source: str, taps: str, place):
        def one(i):
            total = F.lit(64).cast("long")
            for j in range(8):
                total = total + F.get(taps, F.lit(j)) * F.get(source, place(i, j - 3).cast("int"))
            return k.clip(F.shiftright(total, 7))

        return F.transform(cells, one)

    row, col = (lambda i: F.floor(i / 8)), (lambda i: i % 8)
    df = df.select("vec_id", "ty", filtered("a", "tx", lambda i, d: row(i) * 8 + k.clip(col(i) + d, 0, 7)).alias("h"))
    return df.select("vec_id", k.listed(filtered("h", "ty", lambda i, d: k.clip(row(i) + d, 0, 7) * 8 + col(i))).alias("px"))


def _flat_sql(n: int, reach: int) -> str:
    out = k.flat_filter([k.Sql(f"v[{i + 1}]") for i in range(n)], reach)
    return f"WITH {BLOCKS}, e AS (SELECT vec_id, unnest(range(0, {64 // n})) AS r, a FROM blocks), v AS (SELECT vec_id, r, a[r * {n} + 1:r * {n} + {n}] AS v FROM e) SELECT vec_id, r, array_to_string([{', '.join(out)}], ',') AS px FROM v"


def _flat(spark, sf_dir, n: int, reach: int):
    rows = F.transform(F.sequence(F.lit(0), F.lit(64 // n - 1)), lambda r: F.slice("a", r * n + 1, n))
    df = blocks(spark, sf_dir).select("vec_id", F.posexplode(rows).alias("r", "v"))
    return df.select("vec_id", F.col("r").cast("long").alias("r"), k.listed(F.array(*k.flat_filter([F.col("v")[i] for i in range(n)], reach))).alias("px"))


@query(_flat_sql(8, 3))
def flat_filter8(spark, sf_dir):
    """The filter of a flat edge over four samples on either side."""
    return _flat(spark, sf_dir, 8, 3)


@query(_flat_sql(16, 7))
def flat_filter16(spark, sf_dir):
    """The filter of a wide flat edge over eight samples on either side."""
    return _flat(spark, sf_dir, 16, 7)


@query(f"""WITH {BLOCKS}, e AS (SELECT vec_id, unnest(range(0, 16)) AS r, a FROM blocks), v AS (SELECT vec_id, r, ((a[r * 4 + 1] % 256) + 256) % 256 AS p1, ((a[r * 4 + 2] % 256) + 256) % 256 AS p0, ((a[r * 4 + 3] % 256) + 256) % 256 AS q0, ((a[r * 4 + 4] % 256) + 256) % 256 AS q1 FROM e),
h AS (SELECT *, abs(p1 - p0) > 40 OR abs(q1 - q0) > 40 AS hev FROM v), f AS (SELECT *, least(greatest(CASE WHEN hev THEN least(greatest(p1 - q1, -128), 127) ELSE 0 END + 3 * (q0 - p0), -128), 127) AS f FROM h),
g AS (SELECT *, least(f + 4, 127) >> 3 AS f1, least(f + 3, 127) >> 3 AS f2 FROM f)
SELECT vec_id, r, hev, CASE WHEN hev THEN p1 ELSE least(greatest(p1 + ((f1 + 1) >> 1), 0), 255) END AS p1, least(greatest(p0 + f2, 0), 255) AS p0, least(greatest(q0 - f1, 0), 255) AS q0, CASE WHEN hev THEN q1 ELSE least(greatest(q1 - ((f1 + 1) >> 1), 0), 255) END AS q1 FROM g""")
def narrow_filter(spark, sf_dir):
    """The filter of two samples on either side; where the edge is steep only the inner ones move."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda r: F.slice("a", r * 4 + 1, 4))
    df = blocks(spark, sf_dir).select("vec_id", F.posexplode(rows).alias("r", "v")).select("vec_id", F.col("r").cast("long").alias("r"), *[F.pmod(F.col("v")[i], F.lit(256)).alias(n) for i, n in enumerate(("p1", "p0", "q0", "q1"))])
    p1, p0, q0, q1 = (F.col(c) for c in ("p1", "p0", "q0", "q1"))
    df = df.withColumn("hev", (F.abs(p1 - p0) > 40) | (F.abs(q1 - q0) > 40))
    df = df.withColumn("f", k.clip(F.when(F.col("hev"), k.clip(p1 - q1, -128, 127)).otherwise(0) + 3 * (q0 - p0), -128, 127))
    df = df.withColumn("f1", F.shiftright(F.least(F.col("f") + 4, F.lit(127)), 3)).withColumn("f2", F.shiftright(F.least(F.col("f") + 3, F.lit(127)), 3))
    half = F.shiftright(F.col("f1") + 1, 1)
    return df.select("vec_id", "r", "hev", F.when(F.col("hev"), p1).otherwise(k.clip(p1 + half, 0, 255)).alias("p1"), k.clip(p0 + F.col("f2"), 0, 255).alias("p0"), k.clip(q0 - F.col("f1"), 0, 255).alias("q0"), F.when(F.col("hev"), q1).otherwise(k.clip(q1 - half, 0, 255)).alias("q1"))


@query(f"""WITH {BLOCKS}, e AS (SELECT vec_id, label, a, unnest(range(0, 4)) AS r FROM blocks),
s AS (SELECT vec_id, r, CAST(vec_id % 64 AS BIGINT) AS level, label % 8 AS sharp, [4, 8, 16, 32][CAST((vec_id * 7 + r) % 4 + 1 AS INTEGER)] AS ours, [4, 8, 16, 32][CAST((vec_id // 3 + r) % 4 + 1 AS INTEGER)] AS theirs, 8 * (vec_id % 8) AS x,
 list_transform(a[r * 16 + 1:r * 16 + 16], lambda v: least(greatest(120 + CAST(floor(v / (100 + 300 * (vec_id % 5))) AS BIGINT), 0), 255)) AS v FROM e),
l AS (SELECT *, greatest(CASE WHEN sharp > 0 THEN least(level >> ((sharp + 3) >> 2), 9 - sharp) ELSE level END, 1) AS inner_, x % ours = 0 AS edge, least(ours, theirs, 16) AS width FROM s),
g AS (SELECT *, edge AND level > 0 AND greatest(abs(v[5] - v[6]), abs(v[6] - v[7]), abs(v[7] - v[8]), abs(v[10] - v[9]), abs(v[11] - v[10]), abs(v[12] - v[11])) <= inner_ AND 2 * abs(v[8] - v[9]) + (abs(v[7] - v[10]) >> 1) <= least(2 * (level + 2) + inner_, 255) AS on_,
 list_max(list_transform([5, 6, 7], lambda i: greatest(abs(v[i] - v[8]), abs(v[17 - i] - v[9])))) <= 1 AS flat, list_max(list_transform([1, 2, 3, 4], lambda i: greatest(abs(v[i] - v[8]), abs(v[17 - i] - v[9])))) <= 1 AS flat2 FROM l),
k AS (SELECT *, CASE WHEN NOT on_ THEN 0 WHEN width >= 16 AND flat AND flat2 THEN 16 WHEN width >= 8 AND flat THEN 8 ELSE 4 END AS taps, abs(v[7] - v[8]) > level >> 4 OR abs(v[10] - v[9]) > level >> 4 AS hev FROM g),
f AS (SELECT *, least(greatest(CASE WHEN hev THEN least(greatest(v[7] - v[10], -128), 127) ELSE 0 END + 3 * (v[9] - v[8]), -128), 127) AS f FROM k),
h AS (SELECT *, least(f + 4, 127) >> 3 AS f1, least(f + 3, 127) >> 3 AS f2 FROM f)
SELECT vec_id, r, taps, array_to_string(CASE taps WHEN 0 THEN v WHEN 4 THEN list_transform(range(1, 17), lambda i: CASE WHEN i = 7 AND NOT hev THEN least(greatest(v[7] + ((f1 + 1) >> 1), 0), 255) WHEN i = 8 THEN least(greatest(v[8] + f2, 0), 255) WHEN i = 9 THEN least(greatest(v[9] - f1, 0), 255) WHEN i = 10 AND NOT hev THEN least(greatest(v[10] - ((f1 + 1) >> 1), 0), 255) ELSE v[i] END)
 WHEN 8 THEN list_transform(range(1, 17), lambda i: CASE WHEN i BETWEEN 6 AND 11 THEN CAST(list_sum(list_transform(range(-3, 4), lambda j: v[least(greatest(i + j, 5), 12)])) + v[i] + 4 AS BIGINT) >> 3 ELSE v[i] END)
 ELSE list_transform(range(1, 17), lambda i: CASE WHEN i BETWEEN 2 AND 15 THEN CAST(list_sum(list_transform(range(-7, 8), lambda j: v[least(greatest(i + j, 1), 16)])) + v[i] + 8 AS BIGINT) >> 4 ELSE v[i] END) END, ',') AS samples FROM h""")
def edge_filter(spark, sf_dir):
    """Edges between blocks: levels and sharpness give limits, block sizes say which edges there are and how many samples may move, gates choose 4, 8 or 16."""
    v, r = F.col("vec_id"), F.col("r")
    df = blocks(spark, sf_dir).select("vec_id", "label", "a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("r"))
    size = lambda c: F.get(F.array(*map(F.lit, (4, 8, 16, 32))), (c % 4).cast("int"))
    px = F.transform(F.slice("a", (r * 16 + 1).cast("int"), F.lit(16)), lambda x: k.clip(120 + F.floor(x / (100 + 300 * (v % 5))), 0, 255))
    df = df.select("vec_id", "r", (v % 64).alias("level"), (F.col("label") % 8).alias("sharp"), size(v * 7 + r).alias("ours"), size(F.floor(v / 3) + r).alias("theirs"), (8 * (v % 8)).alias("x"), px.alias("v"))
    return k.edge(df).select("vec_id", "r", "taps", k.listed(F.col("out")).alias("samples"))


#: Taps on either side of a windowed sinc.
_REACH = 8


def _sinc(phase: int) -> list[float]:
    """Weights of the samples from _REACH - 1 before to _REACH behind a place ``phase`` thirds after a sample: sinc under a cosine window, their sum one."""
    at = [j - phase / 3 for j in range(1 - _REACH, _REACH + 1)]
    w = [(1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)) * (0.5 + 0.5 * math.cos(math.pi * x / _REACH)) for x in at]
    return [round(v / sum(w) * (1 << 15)) for v in w]


_SINC = [_sinc(p) for p in range(3)]


@query(f"""WITH {BLOCKS} SELECT vec_id, array_to_string(list_transform(range(0, 96), lambda i: ({' + '.join(f'{[s[j] for s in _SINC]}[i * 2 % 3 + 1] * a[least(greatest(i * 2 // 3 + ({j + 1 - _REACH}), 0), 63) + 1]' for j in range(2 * _REACH))} + 16384) >> 15), ',') AS out_ FROM blocks""")
def resample_sinc(spark, sf_dir):
    """Three samples for every two by a windowed sinc of sixteen taps in 15-bit fixed point."""

    def one(i):
        base, total = F.floor(i * 2 / 3).cast("int"), F.lit(16_384).cast("long")
        for j in range(2 * _REACH):
            total = total + F.get(F.array(*[F.lit(s[j]) for s in _SINC]), (i * 2 % 3).cast("int")) * F.get("a", k.clip(base + (j + 1 - _REACH), 0, 63))
        return F.shiftright(total, 15)

    return blocks(spark, sf_dir).select("vec_id", k.listed(F.transform(F.sequence(F.lit(0), F.lit(95)), one)).alias("out_"))


@query(f"""WITH {BLOCKS}, s AS (SELECT vec_id, i, i * 2 % 3 AS f, a[greatest(i * 2 // 3 - 1, 0) + 1] AS m, a[i * 2 // 3 + 1] AS p, a[least(i * 2 // 3 + 1, 63) + 1] AS c, a[least(i * 2 // 3 + 2, 63) + 1] AS n FROM blocks, range(96) t(i))
SELECT vec_id, i, 54 * p + 9 * (c - m) * f + 3 * (2 * m - 5 * p + 4 * c - n) * f * f + (3 * (p - c) + n - m) * f * f * f AS out_ FROM s""")
def resample_cubic(spark, sf_dir):
    """Three samples for every two by a cubic through four neighbours, in 54ths."""
    df = blocks(spark, sf_dir).select("vec_id", "a", F.explode(F.sequence(F.lit(0), F.lit(95))).alias("i"))
    base, f = F.floor(F.col("i") * 2 / 3).cast("int"), F.col("i") * 2 % 3
    m, p, c, n = (F.get("a", k.clip(base + d, 0, 63)) for d in (-1, 0, 1, 2))
    out = 54 * p + 9 * (c - m) * f + 3 * (2 * m - 5 * p + 4 * c - n) * f * f + (3 * (p - c) + n - m) * f * f * f
    return df.select("vec_id", F.col("i").cast("long").alias("i"), out.alias("out_"))


#: The six taps of half positions: fixed values of the standard.
_SIX = (1, -5, 20, 20, -5, 1)


@query(f"""WITH {BLOCKS}, px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, ((a[i + 1] % 256) + 256) % 256 AS v FROM blocks, range(64) t(i)),
t(d, w) AS (VALUES {', '.join(f'({i - 2}, {t})' for i, t in enumerate(_SIX))}),
b AS (SELECT p.vec_id, p.y, p.x - d AS x, sum(w * v) AS b FROM px p, t WHERE p.x - d BETWEEN 2 AND 4 GROUP BY ALL),
h AS (SELECT p.vec_id, p.y - d AS y, p.x, sum(w * v) AS h FROM px p, t WHERE p.y - d BETWEEN 2 AND 4 GROUP BY ALL),
j AS (SELECT b.vec_id, b.y - d AS y, b.x, sum(w * b) AS j FROM b, t WHERE b.y - d BETWEEN 2 AND 4 GROUP BY ALL),
c AS (SELECT g.vec_id, g.y, g.x, g.v AS g, r.v AS r, m.v AS d, least(greatest((b.b + 16) >> 5, 0), 255) AS b, least(greatest((s.b + 16) >> 5, 0), 255) AS s, least(greatest((h.h + 16) >> 5, 0), 255) AS h, least(greatest((k.h + 16) >> 5, 0), 255) AS m, least(greatest((j.j + 512) >> 10, 0), 255) AS j
 FROM px g JOIN px r ON r.vec_id = g.vec_id AND r.y = g.y AND r.x = g.x + 1 JOIN px m ON m.vec_id = g.vec_id AND m.y = g.y + 1 AND m.x = g.x JOIN b ON b.vec_id = g.vec_id AND b.y = g.y AND b.x = g.x JOIN b s ON s.vec_id = g.vec_id AND s.y = g.y + 1 AND s.x = g.x
 JOIN h ON h.vec_id = g.vec_id AND h.y = g.y AND h.x = g.x JOIN h k ON k.vec_id = g.vec_id AND k.y = g.y AND k.x = g.x + 1 JOIN j ON j.vec_id = g.vec_id AND j.y = g.y AND j.x = g.x)
SELECT vec_id, y, x, array_to_string([g, (g + b + 1) >> 1, b, (b + r + 1) >> 1, (g + h + 1) >> 1, (b + h + 1) >> 1, (b + j + 1) >> 1, (b + m + 1) >> 1, h, (h + j + 1) >> 1, j, (j + m + 1) >> 1, (h + d + 1) >> 1, (h + s + 1) >> 1, (j + s + 1) >> 1, (m + s + 1) >> 1], ',') AS positions FROM c""")
def quarter_positions(spark, sf_dir):
    """All sixteen quarter positions of samples: halves by six taps in either direction and in both, quarters as means of two."""
    px = F.transform("a", lambda v: F.pmod(v, F.lit(256)))
    found = blocks(spark, sf_dir).select("vec_id", F.posexplode(k.quarter_positions(px)).alias("i", "p"))
    return found.select("vec_id", (2 + F.floor(F.col("i") / 3)).alias("y"), (2 + F.col("i") % 3).cast("long").alias("x"), k.listed(F.col("p")).alias("positions"))
