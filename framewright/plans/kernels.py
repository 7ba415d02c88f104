"""Array kernels over blocks: transforms, scaling, prediction, filters, motion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import kernels as k
from ..tables import BLOCKS, blocks, literal, table

_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
_K = ", ".join(_KEY)

#: The 4 by 4 zigzag scan.
ZIGZAG = (0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15)
#: The standard's 4 by 4 scale factors by qp modulo 6, for the three classes of position.
SCALE = ((10, 16, 13), (11, 18, 14), (13, 20, 16), (14, 23, 18), (16, 25, 20), (18, 29, 23))

#: The class of position i in a 4 by 4 block, counted from one: both even, both odd, or neither.
_CLASS = "CASE (i & 1) + ((i >> 2) & 1) WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 3 END"


def _join(sql: str) -> str:
    return f"array_to_string({sql}, ',')"


@query(f"""WITH {BLOCKS}, p AS (SELECT vec_id, list_concat([a[1] + 32], a[2:16]) AS c, list_transform(a[17:32], lambda x: (x % 256 + 256) % 256) AS pred FROM blocks), t AS (SELECT vec_id, pred, {k.sql_two_pass('c', 4, k.inverse4)} AS t FROM p)
SELECT vec_id, {_join("list_transform(range(1, 17), lambda i: least(greatest(pred[i] + (t[i] >> 6), 0), 255))")} AS px FROM t""")
def idct4x4(spark, sf_dir):
    """4 by 4 inverse transform, added to a prediction and clamped."""
    df = blocks(spark, sf_dir).select("vec_id", F.concat(F.array(F.col("a")[0] + 32), F.slice("a", 2, 15)).alias("c"), F.transform(F.slice("a", 17, 16), lambda x: F.pmod(x, F.lit(256))).alias("pred"))
    return df.select("vec_id", k.listed(F.zip_with("pred", k.two_pass("c", 4, k.inverse4), lambda p, t: k.clip(p + F.shiftright(t, 6)))).alias("px"))


@query(f"""WITH {BLOCKS}, t AS (SELECT vec_id, {k.sql_two_pass('list_concat([a[1] + 32], a[2:64])', 8, k.inverse8)} AS t FROM blocks) SELECT vec_id, {_join("list_transform(t, lambda x: least(greatest(128 + (x >> 6), 0), 255))")} AS px FROM t""")
def idct8x8(spark, sf_dir):
    """8 by 8 inverse transform over a grey prediction."""
    c = F.concat(F.array(F.col("a")[0] + 32), F.slice("a", 2, 63))
    df = blocks(spark, sf_dir).select("vec_id", c.alias("c"))
    return df.select("vec_id", k.listed(F.transform(k.two_pass("c", 8, k.inverse8), lambda x: k.clip(128 + F.shiftright(x, 6)))).alias("px"))


@query(f"""WITH {BLOCKS}, t AS (SELECT vec_id, label, {k.sql_two_pass('a[1:16]', 4, k.hadamard4)} AS t, a FROM blocks)
SELECT vec_id, {_join("list_transform(t, lambda x: (x * (label + 7) + 128) >> 8)")} AS dc4, {_join("list_transform([a[1] + a[2] + a[3] + a[4], a[1] - a[2] + a[3] - a[4], a[1] + a[2] - a[3] - a[4], a[1] - a[2] - a[3] + a[4]], lambda x: (x * (label + 7)) >> 7)")} AS dc2 FROM t""")
def hadamard_dc(spark, sf_dir):
    """Hadamard transforms of DC values, 4 by 4 and 2 by 2, with scaling."""
    df = blocks(spark, sf_dir).withColumn("q", F.col("label") + 7)
    a = [F.col("a")[i] for i in range(4)]
    two = F.array(a[0] + a[1] + a[2] + a[3], a[0] - a[1] + a[2] - a[3], a[0] + a[1] - a[2] - a[3], a[0] - a[1] - a[2] + a[3])
    return df.select("vec_id", k.listed(F.transform(k.two_pass(F.slice("a", 1, 16), 4, k.hadamard4), lambda x: F.shiftright(x * F.col("q") + 128, 8))).alias("dc4"), k.listed(F.transform(two, lambda x: F.shiftright(x * F.col("q"), 7))).alias("dc2"))


@query(f"""WITH {BLOCKS}, q AS (SELECT vec_id, vec_id % 52 AS qp, a FROM blocks), s AS (SELECT *, [{', '.join(str(list(x)) for x in SCALE)}][qp % 6 + 1] AS s FROM q)
SELECT vec_id, qp, {_join(f"list_transform(range(0, 16), lambda i: (a[i + 1] * (s[{_CLASS}] * 16 * CAST(pow(2, qp // 6 + 2) AS BIGINT)) + 32) >> 6)")} AS coef FROM s""")
def dequant_apply(spark, sf_dir):
    """Coefficients times the factor of their position and qp, from a flat matrix."""
    df = blocks(spark, sf_dir).withColumn("qp", F.col("vec_id") % 52)
    scale = F.array(*[F.array(*map(F.lit, x)) for x in SCALE])
    df = df.withColumn("s", F.get(scale, (F.col("qp") % 6).cast("int"))).withColumn("up", F.pow(F.lit(2), F.floor(F.col("qp") / 6) + 2).cast("long"))
    place = [(i & 1) + (i >> 2 & 1) for i in range(16)]
    out = F.array(*[F.shiftright(F.col("a")[i] * F.col("s")[{0: 0, 2: 1, 1: 2}[p]] * 16 * F.col("up") + 32, 6) for i, p in enumerate(place)])
    return df.select("vec_id", "qp", k.listed(out).alias("coef"))


@query(f"SELECT qp, pos, base * 16 * CAST(pow(2, qp // 6 + 2) AS BIGINT) AS factor, p_partkey FROM (SELECT p_partkey, p_size % 52 AS qp, unnest(range(0, 16)) AS pos, unnest(list_transform(range(0, 16), lambda i: [{', '.join(str(list(x)) for x in SCALE)}][p_size % 52 % 6 + 1][{_CLASS}])) AS base FROM part)")
def dequant_table(spark, sf_dir):
    """Scale tables: a factor for each position at a part's qp."""
    rows = [(m, pos, SCALE[m][{0: 0, 2: 1, 1: 2}[(pos & 1) + (pos >> 2 & 1)]]) for m in range(6) for pos in range(16)]
    base = literal(spark, rows, "m long, pos long, base long")
    df = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 52).cast("long").alias("qp")).withColumn("m", F.col("qp") % 6)
    return df.join(F.broadcast(base), "m").select("qp", "pos", (F.col("base") * 16 * F.pow(F.lit(2), F.floor(F.col("qp") / 6) + 2).cast("long")).alias("factor"), "p_partkey")


@query(f"WITH {BLOCKS} SELECT vec_id, {_join(f'list_transform(range(1, 17), lambda i: a[list_position({[z for z in ZIGZAG]}, i - 1)])')} AS coef FROM blocks")
def inverse_scan(spark, sf_dir):
    """Coefficients from scan order to their places."""
    return blocks(spark, sf_dir).select("vec_id", k.listed(F.array(*[F.col("a")[ZIGZAG.index(i)] for i in range(16)])).alias("coef"))


@query(f"WITH {BLOCKS} SELECT vec_id, {_join('list_transform(range(0, 64), lambda i: a[(i % 8) * 8 + i // 8 + 1])')} AS t FROM blocks")
def transpose_8x8(spark, sf_dir):
    """Rows as columns."""
    return blocks(spark, sf_dir).select("vec_id", k.listed(F.flatten(k.transposed(k.rows("a", 8), 8))).alias("t"))


@query(f"""WITH {BLOCKS}, t AS (SELECT vec_id, {k.sql_two_pass('a[1:16]', 4, k.dct4)} AS d, {k.sql_two_pass('a[1:16]', 4, k.adst4)} AS s FROM blocks)
SELECT vec_id, {_join("list_transform(d, lambda x: (x + 8) >> 4)")} AS dct, {_join("list_transform(s, lambda x: (x + 8) >> 4)")} AS adst FROM t""")
def dct_adst4(spark, sf_dir):
    """Inverse cosine and sine transforms in fixed point."""
    end = lambda kernel: k.listed(F.transform(k.two_pass(F.slice("a", 1, 16), 4, kernel), lambda x: F.shiftright(x + 8, 4)))
    return blocks(spark, sf_dir).select("vec_id", end(k.dct4).alias("dct"), end(k.adst4).alias("adst"))


_TAPS = "a[i] - 5 * a[i + 1] + 20 * a[i + 2] + 20 * a[i + 3] - 5 * a[i + 4] + a[i + 5]"


@query(f"WITH {BLOCKS} SELECT vec_id, {_join(f'list_transform(range(1, 60), lambda i: least(greatest(({_TAPS} + 16) >> 5, 0), 255))')} AS half, {_join(f'list_transform(range(1, 60), lambda i: (a[i + 2] + least(greatest(({_TAPS} + 16) >> 5, 0), 255) + 1) >> 1)')} AS quarter FROM blocks")
def fir6_halfpel(spark, sf_dir):
    """Half positions by the six-tap filter, and the quarter positions next to them."""
    at = lambda i: F.element_at("a", i)
    tap = lambda i: k.clip(F.shiftright(at(i) - 5 * at(i + 1) + 20 * at(i + 2) + 20 * at(i + 3) - 5 * at(i + 4) + at(i + 5) + 16, 5))
    df = blocks(spark, sf_dir).withColumn("h", F.transform(F.sequence(F.lit(1), F.lit(59)), tap))
    return df.select("vec_id", k.listed(F.col("h")).alias("half"), k.listed(F.zip_with(F.slice("a", 3, 59), "h", lambda x, y: F.shiftright(x + y + 1, 1))).alias("quarter"))


@query(f"""WITH m AS (SELECT {_K}, l_partkey % 64 - 32 AS a, l_suppkey % 64 - 32 AS b, CAST(l_quantity AS BIGINT) - 25 AS c, l_linenumber % 3 AS ra, l_partkey % 3 AS rb, l_suppkey % 3 AS rc FROM lineitem)
SELECT {_K}, CAST(CASE WHEN (ra = 0)::INT + (rb = 0)::INT + (rc = 0)::INT = 1 THEN CASE WHEN ra = 0 THEN a WHEN rb = 0 THEN b ELSE c END ELSE list_sort([a, b, c])[2] END AS BIGINT) AS mv, CAST(floor(a / 4.0) AS BIGINT) AS luma_x, ((a % 4) + 4) % 4 AS luma_frac, CAST(floor(a / 8.0) AS BIGINT) AS chroma_x, ((a % 8) + 8) % 8 AS chroma_frac FROM m""")
def mv_median(spark, sf_dir):
    """Motion from three neighbours: the only one with the reference, else the median; and its whole and fractional parts."""
    m = table(spark, sf_dir, "lineitem").select(*_KEY, (F.col("l_partkey") % 64 - 32).alias("a"), (F.col("l_suppkey") % 64 - 32).alias("b"), (F.col("l_quantity").cast("long") - 25).alias("c"), (F.col("l_linenumber") % 3 == 0).alias("ra"), (F.col("l_partkey") % 3 == 0).alias("rb"), (F.col("l_suppkey") % 3 == 0).alias("rc"))
    only = F.col("ra").cast("int") + F.col("rb").cast("int") + F.col("rc").cast("int") == 1
    mv = F.when(only, F.when(F.col("ra"), F.col("a")).when(F.col("rb"), F.col("b")).otherwise(F.col("c"))).otherwise(F.array_sort(F.array("a", "b", "c"))[1])
    a = F.col("a")
    return m.select(*_KEY, mv.alias("mv"), F.floor(a / 4).alias("luma_x"), F.pmod(a, F.lit(4)).alias("luma_frac"), F.floor(a / 8).alias("chroma_x"), F.pmod(a, F.lit(8)).alias("chroma_frac"))


@query(f"""WITH {BLOCKS} SELECT vec_id, {_join('list_transform(range(1, 33), lambda i: (a[i] + a[i + 32] + 1) >> 1)')} AS avg_, {_join('list_transform(range(1, 33), lambda i: least(greatest((a[i] * (64 - label * 3) + a[i + 32] * label * 3 + 32) >> 6, 0), 255))')} AS weighted FROM blocks""")
def bipred_average(spark, sf_dir):
    """Two predictions as their rounded mean, and weighted."""
    x, y, w = F.slice("a", 1, 32), F.slice("a", 33, 32), F.col("label") * 3
    return blocks(spark, sf_dir).select("vec_id", k.listed(F.zip_with(x, y, lambda p, q: F.shiftright(p + q + 1, 1))).alias("avg_"), k.listed(F.zip_with(x, y, lambda p, q: k.clip(F.shiftright(p * (64 - w) + q * w + 32, 6)))).alias("weighted"))


@query("""WITH p AS (SELECT o_orderkey, least(greatest(o_orderkey % 300 - 150, -128), 127) AS td, least(greatest(o_custkey % 300 - 150, -128), 127) AS tb, o_custkey % 200 - 100 AS mv FROM orders),
t AS (SELECT *, CASE WHEN td <> 0 THEN CAST(trunc((16384 + abs(td) // 2) / CAST(td AS DOUBLE)) AS BIGINT) END AS tx FROM p), s AS (SELECT *, (tb * tx + 32) >> 8 AS s, CASE WHEN td = 0 THEN 256 ELSE least(greatest((tb * tx + 32) >> 6, -1024), 1023) END AS sc FROM t)
SELECT o_orderkey, CAST(CASE WHEN td = 0 THEN 32 WHEN s BETWEEN -64 AND 128 THEN 64 - s ELSE 32 END AS BIGINT) AS weight, CAST((sc * mv + 128) >> 8 AS BIGINT) AS mv0, CAST(((sc * mv + 128) >> 8) - mv AS BIGINT) AS mv1 FROM s""")
def implicit_weights(spark, sf_dir):
    """Weights and scaled motion from distances in display order."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", k.clip(F.col("o_orderkey") % 300 - 150, -128, 127).alias("td"), k.clip(F.col("o_custkey") % 300 - 150, -128, 127).alias("tb"), (F.col("o_custkey") % 200 - 100).alias("mv"))
    tx = F.when(F.col("td") != 0, F.expr("(16384 + abs(td) div 2) div nullif(td, 0)"))
    df = df.withColumn("tx", tx).withColumn("s", F.shiftright(F.col("tb") * F.col("tx") + 32, 8)).withColumn("sc", k.clip(F.shiftright(F.col("tb") * F.col("tx") + 32, 6), -1024, 1023))
    sc = F.when(F.col("td") == 0, 256).otherwise(F.col("sc"))
    mv0 = F.shiftright(sc * F.col("mv") + 128, 8)
    weight = F.when(F.col("td") == 0, 32).when(F.col("s").between(-64, 128), 64 - F.col("s")).otherwise(32)
    return df.select("o_orderkey", weight.cast("long").alias("weight"), mv0.alias("mv0"), (mv0 - F.col("mv")).alias("mv1"))


@query(f"""WITH {BLOCKS}, g AS (SELECT vec_id, unnest(range(0, 56)) AS i, a, label FROM blocks WHERE label >= 0)
SELECT vec_id, i, CASE WHEN a[i + 1] % 5 = 0 OR a[i + 9] % 5 = 0 THEN CASE WHEN i // 8 % 4 = 3 THEN 4 ELSE 3 END WHEN a[i + 1] % 2 = 0 OR a[i + 9] % 2 = 0 THEN 2 WHEN abs(a[i + 1] - a[i + 9]) >= 64 THEN 1 ELSE 0 END AS bs FROM g""")
def deblock_strength(spark, sf_dir):
    """Strength of the edges below the cells of a grid: intra, coefficients, motion."""
    df = blocks(spark, sf_dir).select("vec_id", F.posexplode(F.zip_with(F.slice("a", 1, 56), F.slice("a", 9, 56), lambda p, q: F.struct(p.alias("p"), q.alias("q")))).alias("i", "x"))
    p, q = F.col("x.p"), F.col("x.q")
    bs = F.when((p % 5 == 0) | (q % 5 == 0), F.when(F.floor(F.col("i") / 8) % 4 == 3, 4).otherwise(3)).when((p % 2 == 0) | (q % 2 == 0), 2).when(F.abs(p - q) >= 64, 1).otherwise(0)
    return df.select("vec_id", F.col("i").cast("long").alias("i"), bs.alias("bs"))


@query(f"""WITH {BLOCKS}, e AS (SELECT vec_id, unnest(range(0, 8)) AS r, a FROM blocks), s AS (SELECT vec_id, r, a[r * 8 + 2] AS p2, a[r * 8 + 3] AS p1, a[r * 8 + 4] AS p0, a[r * 8 + 5] AS q0, a[r * 8 + 6] AS q1, a[r * 8 + 7] AS q2 FROM e),
f AS (SELECT *, abs(p0 - q0) < 200 AND abs(p1 - p0) < 150 AND abs(q1 - q0) < 150 AS active, 9 + (abs(p2 - p0) < 150)::INT + (abs(q2 - q0) < 150)::INT AS tc FROM s), d AS (SELECT *, least(greatest((4 * (q0 - p0) + p1 - q1 + 4) >> 3, -tc), tc) AS d FROM f)
SELECT vec_id, r, active, CASE WHEN active THEN p0 + d ELSE p0 END AS p, CASE WHEN active THEN q0 - d ELSE q0 END AS q, CASE WHEN active THEN (p2 + 2 * p1 + 2 * p0 + 2 * q0 + q1 + 4) >> 3 ELSE p0 END AS strong_p FROM d""")
def deblock_filter(spark, sf_dir):
    """The normal and the strong filter across the middle of each row."""
    df = blocks(spark, sf_dir).select("vec_id", F.posexplode(k.rows("a", 8)).alias("r", "x")).select("vec_id", F.col("r").cast("long").alias("r"), *[F.col("x")[i].alias(n) for i, n in enumerate(("p3", "p2", "p1", "p0", "q0", "q1", "q2"))])
    p2, p1, p0, q0, q1, q2 = (F.col(c) for c in ("p2", "p1", "p0", "q0", "q1", "q2"))
    active = (F.abs(p0 - q0) < 200) & (F.abs(p1 - p0) < 150) & (F.abs(q1 - q0) < 150)
    tc = 9 + (F.abs(p2 - p0) < 150).cast("int") + (F.abs(q2 - q0) < 150).cast("int")
    d = F.least(F.greatest(F.shiftright(4 * (q0 - p0) + p1 - q1 + 4, 3), -tc), tc)
    return df.select("vec_id", "r", active.alias("active"), F.when(active, p0 + d).otherwise(p0).alias("p"), F.when(active, q0 - d).otherwise(q0).alias("q"), F.when(active, F.shiftright(p2 + 2 * p1 + 2 * p0 + 2 * q0 + q1 + 4, 3)).otherwise(p0).alias("strong_p"))


@query(f"WITH {BLOCKS} SELECT vec_id, {_join('list_transform(range(0, 96), lambda i: floor((a[i * 2 // 3 + 1] * (3 - i * 2 % 3) + a[least(i * 2 // 3 + 1, 63) + 1] * (i * 2 % 3)) / 3.0)::BIGINT)')} AS out_ FROM blocks")
def resample_linear(spark, sf_dir):
    """Three samples for every two, between neighbours."""
    at = lambda i: F.element_at("a", i + 1)

    def one(i):
        base, part = F.floor(i * 2 / 3).cast("int"), i * 2 % 3
        return F.floor((at(base) * (3 - part) + at(F.least(base + 1, F.lit(63))) * part) / 3)

    return blocks(spark, sf_dir).select("vec_id", k.listed(F.transform(F.sequence(F.lit(0), F.lit(95)), one)).alias("out_"))


@query(f"""WITH {BLOCKS}, e AS (SELECT vec_id, a, CASE WHEN label % 4 IN (0, 1) THEN a[1:8] END AS t, CASE WHEN label % 4 IN (0, 2) THEN a[9:16] END AS l FROM blocks)
SELECT vec_id, CAST(CASE WHEN t IS NOT NULL AND l IS NOT NULL THEN CAST(list_sum(t) + list_sum(l) + 8 AS BIGINT) >> 4 WHEN t IS NOT NULL THEN CAST(list_sum(t) + 4 AS BIGINT) >> 3 WHEN l IS NOT NULL THEN CAST(list_sum(l) + 4 AS BIGINT) >> 3 ELSE 128 END AS BIGINT) AS dc FROM (SELECT vec_id, t, l FROM e)""")
def dc_predictor(spark, sf_dir):
    """The rounded mean of the edges there are; grey without any."""
    total = lambda at: F.aggregate(F.slice("a", at, 8), F.lit(0).cast("long"), lambda s, x: s + x)
    m = F.col("label") % 4
    dc = F.when(m == 0, F.shiftright(total(1) + total(9) + 8, 4)).when(m == 1, F.shiftright(total(1) + 4, 3)).when(m == 2, F.shiftright(total(9) + 4, 3)).otherwise(128)
    return blocks(spark, sf_dir).select("vec_id", dc.cast("long").alias("dc"))


@query(f"""WITH {BLOCKS} SELECT vec_id, {_join('list_transform(range(0, 16), lambda i: CASE WHEN i = 15 THEN (a[7] + 3 * a[8] + 2) >> 2 ELSE (a[i % 4 + i // 4 + 1] + 2 * a[i % 4 + i // 4 + 2] + a[i % 4 + i // 4 + 3] + 2) >> 2 END)')} AS down_left, {_join('list_transform(range(0, 16), lambda i: a[i % 4 + 1])')} AS vertical, {_join('list_transform(range(0, 16), lambda i: a[i // 4 + 9])')} AS horizontal FROM blocks""")
def intra4x4(spark, sf_dir):
    """Directional predictions of a 4 by 4 block from its edges."""
    a = [F.col("a")[i] for i in range(16)]
    soft = lambda n: F.shiftright(a[6] + 3 * a[7] + 2, 2) if n == 6 else F.shiftright(a[n] + 2 * a[n + 1] + a[n + 2] + 2, 2)
    cells = [(y, x) for y in range(4) for x in range(4)]
    return blocks(spark, sf_dir).select("vec_id", k.listed(F.array(*[soft(x + y) for y, x in cells])).alias("down_left"), k.listed(F.array(*[a[x] for _, x in cells])).alias("vertical"), k.listed(F.array(*[a[y + 8] for y, _ in cells])).alias("horizontal"))


@query(f"""WITH {BLOCKS}, g AS (SELECT vec_id, a, (a[6] - a[4]) + 2 * (a[7] - a[3]) + 3 * (a[8] - a[2]) + 4 * (a[9] - a[1]) AS h, (a[15] - a[13]) + 2 * (a[16] - a[12]) + 3 * (a[17] - a[11]) + 4 * (a[18] - a[10]) AS v FROM blocks), b AS (SELECT vec_id, (17 * h + 16) >> 5 AS b, (17 * v + 16) >> 5 AS c, 16 * (a[9] + a[18] + 1) AS base FROM g)
SELECT vec_id, {_join('list_transform(range(0, 64), lambda i: least(greatest((base - 3 * (b + c) + b * (i % 8) + c * (i // 8)) >> 5, 0), 255))')} AS px FROM b""")
def plane_predictor(spark, sf_dir):
    """A plane through the edges' gradients."""
    a = [F.col("a")[i] for i in range(18)]
    h = a[5] - a[3] + 2 * (a[6] - a[2]) + 3 * (a[7] - a[1]) + 4 * (a[8] - a[0])
    v = a[14] - a[12] + 2 * (a[15] - a[11]) + 3 * (a[16] - a[10]) + 4 * (a[17] - a[9])
    df = blocks(spark, sf_dir).select("vec_id", F.shiftright(17 * h + 16, 5).alias("b"), F.shiftright(17 * v + 16, 5).alias("c"), (16 * (a[8] + a[17] + 1)).alias("base"))
    b, c = F.col("b"), F.col("c")
    px = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: k.clip(F.shiftright(F.col("base") - 3 * (b + c) + b * (i % 8) + c * F.floor(i / 8), 5)))
    return df.select("vec_id", k.listed(px).alias("px"))


@query(f"""WITH {BLOCKS} SELECT vec_id, {_join('list_transform(range(0, 49), lambda i: ((8 - label % 8) * (8 - vec_id % 8) * a[i // 7 * 8 + i % 7 + 1] + label % 8 * (8 - vec_id % 8) * a[i // 7 * 8 + i % 7 + 2] + (8 - label % 8) * (vec_id % 8) * a[i // 7 * 8 + i % 7 + 9] + label % 8 * (vec_id % 8) * a[i // 7 * 8 + i % 7 + 10] + 32) >> 6)')} AS px FROM blocks""")
def chroma_bilinear(spark, sf_dir):
    """Eighth-sample positions between four neighbours."""
    dx, dy = F.col("label") % 8, F.col("vec_id") % 8

    def cell(i):
        at = F.floor(i / 7).cast("int") * 8 + i % 7 + 1
        e = lambda j: F.element_at("a", j)
        return F.shiftright((8 - dx) * (8 - dy) * e(at) + dx * (8 - dy) * e(at + 1) + (8 - dx) * dy * e(at + 8) + dx * dy * e(at + 9) + 32, 6)

    return blocks(spark, sf_dir).select("vec_id", k.listed(F.transform(F.sequence(F.lit(0), F.lit(48)), cell)).alias("px"))


@query(f"SELECT {_K}, CAST(CASE WHEN l_partkey % 5 = 0 AND l_suppkey % 5 = 0 THEN 0 WHEN l_partkey % 5 = 0 THEN l_suppkey % 17 WHEN l_suppkey % 5 = 0 THEN l_partkey % 17 ELSE (l_partkey % 17 + l_suppkey % 17 + 1) >> 1 END AS BIGINT) AS nc FROM lineitem")
def nc_context(spark, sf_dir):
    """Context of a block from the counts of the neighbours there are."""
    a, b = F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey") % 17), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey") % 17)
    return table(spark, sf_dir, "lineitem").select(*_KEY, F.coalesce(F.shiftright(a + b + 1, 1), a, b, F.lit(0)).alias("nc"))


