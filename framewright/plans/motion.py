"""Motion from neighbours: a grid of blocks for each picture, from the orders; candidates in their order, without repeats, clamped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..tables import table

#: Neighbours (columns, rows) in the order in which they are asked, for blocks of 8 by 8 and of 16 by 16: fixed values of the standard.
AROUND = {
    8: ((0, -1), (-1, 0), (-1, -1), (0, -2), (-2, 0), (-1, -2), (-2, -1), (-2, -2)),
    16: ((0, -1), (-1, 0), (1, -1), (-1, 1), (-1, -1), (0, -3), (-3, 0), (-3, -3)),
}
#: Columns and rows of the grid, the least and largest motion, and which references lie ahead in time.
_SIDE, _LOW, _HIGH, _AHEAD = 16, -3, 3, (False, False, True)


def _blocks(spark, sf_dir) -> DataFrame:
    """(pic, r, c, size, ref0, ref1, x0, y0, x1, y1): a block for each order; ref -1 is none."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    ref0 = (k * 7 + cust) % 4 - 1
    ref1 = F.when((ref0 >= 0) & (k * 5 % 7 < 3), k * 5 % 7).otherwise(-1)
    df = table(spark, sf_dir, "orders")
    return df.select(F.floor(k / _SIDE**2).alias("pic"), F.floor(k / _SIDE % _SIDE).alias("r"), (k % _SIDE).alias("c"), F.when(F.floor(k / _SIDE**2) % 2 == 0, 8).otherwise(16).alias("size"), ref0.alias("ref0"), ref1.alias("ref1"), (cust % 9 - 4).alias("x0"), (k * 3 % 7 - 3).alias("y0"), (cust % 5 - 2).alias("x1"), (k % 3 - 1).alias("y1"))


def candidates(grid: DataFrame) -> DataFrame:
    """pic, r, c, ref and found: for each block the different motions (x, y) of its neighbours and of its place in the picture before, in the order in which they count.

    First those of the block's own reference, then the others, mirrored where their
    reference lies on the other side in time. Each block sends its motion to the
    places that ask for it: one shuffle, no join.
    """
    motion = F.struct("ref0", "ref1", "x0", "y0", "x1", "y1")
    to = lambda order, pic, r, c: F.struct(F.lit(order).alias("order"), pic.alias("pic"), r.alias("r"), c.alias("c"))
    pic, r, c = F.col("pic"), F.col("r"), F.col("c")
    asks = {size: F.array(*[to(i, pic, r - dy, c - dx) for i, (dx, dy) in enumerate(offsets)], to(8, pic + 1, r, c), to(-1, pic, r, c)) for size, offsets in AROUND.items()}
    sent = grid.select(motion.alias("m"), F.explode(F.when(F.col("size") == 8, asks[8]).otherwise(asks[16])).alias("t"))
    got = sent.groupBy("t.pic", "t.r", "t.c").agg(F.max(F.when(F.col("t.order") < 0, F.col("m.ref0"))).alias("ref"), F.array_sort(F.collect_list(F.when(F.col("t.order") >= 0, F.struct(F.col("t.order").alias("order"), "m")))).alias("near"))
    got = got.where("ref is not null").withColumn("ref", F.greatest("ref", F.lit(0)))
    mv = lambda m, i, sign=1: F.struct((m[f"x{i}"] * sign).alias("x"), (m[f"y{i}"] * sign).alias("y"))
    ahead = lambda ref: F.get(F.array(*map(F.lit, _AHEAD)), ref.cast("int"))
    ref = F.col("ref")

    def same(n: Column) -> Column:
        m = n["m"]
        return F.when(m["ref0"] == ref, mv(m, 0)).when(m["ref1"] == ref, mv(m, 1))

    def other(n: Column) -> Column:
        m = n["m"]
        turned = lambda i: F.when(ahead(m[f"ref{i}"]) != ahead(ref), mv(m, i, -1)).otherwise(mv(m, i))
        differ = (m["x0"] != m["x1"]) | (m["y0"] != m["y1"])
        return F.array(F.when((m["ref0"] >= 0) & (m["ref0"] != ref), turned(0)), F.when((m["ref1"] >= 0) & (m["ref1"] != ref) & differ, turned(1)))

    all_ = F.concat(F.transform("near", same), F.flatten(F.transform("near", other)))
    return got.select("pic", "r", "c", "ref", F.array_distinct(F.array_compact(all_)).alias("found"))


_GRID = """g AS (SELECT o_orderkey // 256 AS pic, o_orderkey // 16 % 16 AS r, o_orderkey % 16 AS c, CASE WHEN o_orderkey // 256 % 2 = 0 THEN 8 ELSE 16 END AS size, (o_orderkey * 7 + o_custkey) % 4 - 1 AS ref0,
 CASE WHEN (o_orderkey * 7 + o_custkey) % 4 > 0 AND o_orderkey * 5 % 7 < 3 THEN o_orderkey * 5 % 7 ELSE -1 END AS ref1, o_custkey % 9 - 4 AS x0, o_orderkey * 3 % 7 - 3 AS y0, o_custkey % 5 - 2 AS x1, o_orderkey % 3 - 1 AS y1 FROM orders)"""


@query(f"""WITH {_GRID}, o(size, i, dx, dy) AS (VALUES {', '.join(f'({s}, {i}, {dx}, {dy})' for s, xs in AROUND.items() for i, (dx, dy) in enumerate(xs))}),
n AS (SELECT t.pic, t.r, t.c, greatest(t.ref0, 0) AS ref, o.i, n.ref0, n.ref1, n.x0, n.y0, n.x1, n.y1 FROM g t JOIN o ON o.size = t.size JOIN g n ON n.pic = t.pic AND n.r = t.r + dy AND n.c = t.c + dx
 UNION ALL SELECT t.pic, t.r, t.c, greatest(t.ref0, 0), 8, n.ref0, n.ref1, n.x0, n.y0, n.x1, n.y1 FROM g t JOIN g n ON n.pic = t.pic - 1 AND n.r = t.r AND n.c = t.c),
m AS (SELECT pic, r, c, i AS place, CASE WHEN ref0 = ref THEN x0 ELSE x1 END AS x, CASE WHEN ref0 = ref THEN y0 ELSE y1 END AS y FROM n WHERE ref0 = ref OR ref1 = ref
 UNION ALL SELECT pic, r, c, 100 + 2 * i, CASE WHEN (ref0 = 2) <> (ref = 2) THEN -x0 ELSE x0 END, CASE WHEN (ref0 = 2) <> (ref = 2) THEN -y0 ELSE y0 END FROM n WHERE ref0 >= 0 AND ref0 <> ref
 UNION ALL SELECT pic, r, c, 101 + 2 * i, CASE WHEN (ref1 = 2) <> (ref = 2) THEN -x1 ELSE x1 END, CASE WHEN (ref1 = 2) <> (ref = 2) THEN -y1 ELSE y1 END FROM n WHERE ref1 >= 0 AND ref1 <> ref AND (x0 <> x1 OR y0 <> y1)),
d AS (SELECT pic, r, c, x, y, row_number() OVER (PARTITION BY pic, r, c ORDER BY min(place)) AS k FROM m GROUP BY pic, r, c, x, y),
w AS (SELECT pic, r, c, count(*) AS n, max(CASE WHEN k = 1 THEN x END) AS ax, max(CASE WHEN k = 1 THEN y END) AS ay, max(CASE WHEN k = 2 THEN x END) AS bx, max(CASE WHEN k = 2 THEN y END) AS by_ FROM d GROUP BY pic, r, c)
SELECT pic, r, c, CAST(coalesce(n, 0) AS INTEGER) AS n, least(greatest(coalesce(ax, 0), -3), 3) AS nearest_x, least(greatest(coalesce(ay, 0), -3), 3) AS nearest_y, least(greatest(coalesce(bx, 0), -3), 3) AS near_x, least(greatest(coalesce(by_, 0), -3), 3) AS near_y FROM g LEFT JOIN w USING (pic, r, c)""")
def motion_candidates(spark, sf_dir):
    """The nearest and the next motion that a block may take from its neighbours and from the picture before."""
    part = lambda i, axis: F.least(F.greatest(F.coalesce(F.get("found", F.lit(i))[axis], F.lit(0)), F.lit(_LOW)), F.lit(_HIGH))
    found = candidates(_blocks(spark, sf_dir))
    return found.select("pic", "r", "c", F.size("found").alias("n"), part(0, "x").alias("nearest_x"), part(0, "y").alias("nearest_y"), part(1, "x").alias("near_x"), part(1, "y").alias("near_y"))


def _lists(pic: Column) -> Column:
    """Three references of a picture by index: for one of an odd number those behind it, from another place on for each picture; for an even one those two apart."""
    behind = F.array(*[F.when(pic % 2 == 1, pic - 1 - 2 * i).otherwise(pic - 2 - 2 * i) for i in range(3)])
    turn = (F.floor(pic / 2) % 3).cast("int")
    return F.when(pic % 2 == 1, F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.get(behind, (i + turn) % 3))).otherwise(behind)


def _order(pic: Column) -> Column:
    """The place of a picture in display order."""
    return 2 * pic + F.when(pic % 3 == 0, 1).otherwise(0)


def _with_colocated(grid: DataFrame) -> DataFrame:
    """Blocks of pictures of odd numbers, each with the block of the next picture in its place: the picture that this refers to, and its motion."""
    col = grid.select((F.col("pic") - 1).alias("p"), F.col("r").alias("cr"), F.col("c").alias("cc"), F.when(F.col("ref0") >= 0, F.get(_lists(F.col("pic")), F.col("ref0").cast("int"))).alias("points"), F.col("ref0").alias("c_ref"), F.col("x0").alias("cx"), F.col("y0").alias("cy"))
    return grid.where("pic % 2 = 1").join(col, (F.col("pic") == F.col("p")) & (F.col("r") == F.col("cr")) & (F.col("c") == F.col("cc")))


_LISTS = """l AS (SELECT *, CASE WHEN pic % 2 = 1 THEN list_transform(range(3), lambda i: pic - 1 - 2 * ((i + pic // 2 % 3) % 3)) ELSE list_transform(range(3), lambda i: pic - 2 - 2 * i) END AS refs, 2 * pic + CASE WHEN pic % 3 = 0 THEN 1 ELSE 0 END AS poc FROM g),
j AS (SELECT b.*, CASE WHEN k.ref0 >= 0 THEN k.refs[k.ref0 + 1] END AS points, k.ref0 AS c_ref, k.x0 AS cx, k.y0 AS cy, k.poc AS poc1 FROM l b JOIN l k ON k.pic = b.pic + 1 AND k.r = b.r AND k.c = b.c WHERE b.pic % 2 = 1)"""


@query(f"""WITH {_GRID}, {_LISTS},
i AS (SELECT *, CASE WHEN points IS NULL THEN 0 ELSE list_position(refs, points) - 1 END AS idx, CASE WHEN points IS NULL THEN 0 ELSE cx END AS mx, CASE WHEN points IS NULL THEN 0 ELSE cy END AS my FROM j),
t AS (SELECT *, refs[idx + 1] AS rp FROM i),
d AS (SELECT *, least(greatest(poc - (2 * rp + CASE WHEN rp % 3 = 0 THEN 1 ELSE 0 END), -128), 127) AS tb, least(greatest(poc1 - (2 * rp + CASE WHEN rp % 3 = 0 THEN 1 ELSE 0 END), -128), 127) AS td FROM t),
s AS (SELECT *, CASE WHEN td = 0 THEN NULL ELSE least(greatest((tb * ((16384 + abs(td // 2)) // td) + 32) >> 6, -1024), 1023) END AS scale FROM d)
SELECT pic, r, c, CAST(idx AS BIGINT) AS ref, CASE WHEN scale IS NULL THEN mx ELSE (scale * mx + 128) >> 8 END AS x0, CASE WHEN scale IS NULL THEN my ELSE (scale * my + 128) >> 8 END AS y0, CASE WHEN scale IS NULL THEN 0 ELSE ((scale * mx + 128) >> 8) - mx END AS x1, CASE WHEN scale IS NULL THEN 0 ELSE ((scale * my + 128) >> 8) - my END AS y1 FROM s""")
def direct_temporal(spark, sf_dir):
    """Motion scaled from the colocated block by distances in display order; its reference is looked up in the block's own list."""
    df = _with_colocated(_blocks(spark, sf_dir))
    there = F.col("points").isNotNull()
    df = df.withColumn("refs", _lists(F.col("pic"))).withColumn("ref", F.when(there, F.array_position("refs", F.col("points")) - 1).otherwise(F.lit(0).cast("long")))
    at = _order(F.get("refs", F.col("ref").cast("int")))
    df = df.withColumn("tb", F.least(F.greatest(_order(F.col("pic")) - at, F.lit(-128)), F.lit(127))).withColumn("td", F.least(F.greatest(_order(F.col("pic") + 1) - at, F.lit(-128)), F.lit(127)))
    df = df.withColumn("tx", F.expr("CASE WHEN td = 0 THEN NULL ELSE (16384 + abs(td div 2)) div td END"))
    df = df.withColumn("scale", F.least(F.greatest(F.shiftright(F.col("tb") * F.col("tx") + 32, 6), F.lit(-1024)), F.lit(1023)))
    scaled = F.col("td") != 0
    out = []
    for axis in ("x", "y"):
        own = F.when(there, F.col(f"c{axis}")).otherwise(0)
        first = F.when(scaled, F.shiftright(F.col("scale") * own + 128, 8)).otherwise(own)
        out += [first.alias(f"{axis}0"), F.when(scaled, first - own).otherwise(0).alias(f"{axis}1")]
    return df.select("pic", "r", "c", "ref", *out)


@query(f"""WITH {_GRID}, {_LISTS},
n AS (SELECT j.pic, j.r, j.c, j.c_ref, j.cx, j.cy, coalesce(a.ref0, -1) AS ra, coalesce(a.x0, 0) AS xa, coalesce(a.y0, 0) AS ya, coalesce(b.ref0, -1) AS rb, coalesce(b.x0, 0) AS xb, coalesce(b.y0, 0) AS yb, coalesce(d.ref0, e.ref0, -1) AS rc, coalesce(d.x0, e.x0, 0) AS xc, coalesce(d.y0, e.y0, 0) AS yc
 FROM j LEFT JOIN g a ON a.pic = j.pic AND a.r = j.r AND a.c = j.c - 1 LEFT JOIN g b ON b.pic = j.pic AND b.r = j.r - 1 AND b.c = j.c LEFT JOIN g d ON d.pic = j.pic AND d.r = j.r - 1 AND d.c = j.c + 1 LEFT JOIN g e ON e.pic = j.pic AND e.r = j.r - 1 AND e.c = j.c - 1),
f AS (SELECT *, coalesce(list_min(list_filter([ra, rb, rc], lambda v: v >= 0)), -1) AS ref FROM n),
m AS (SELECT *, [CASE WHEN ra >= 0 THEN xa ELSE 0 END, CASE WHEN rb >= 0 THEN xb ELSE 0 END, CASE WHEN rc >= 0 THEN xc ELSE 0 END] AS xs, [CASE WHEN ra >= 0 THEN ya ELSE 0 END, CASE WHEN rb >= 0 THEN yb ELSE 0 END, CASE WHEN rc >= 0 THEN yc ELSE 0 END] AS ys, list_filter([1, 2, 3], lambda i: [ra, rb, rc][i] = ref) AS same FROM f)
SELECT pic, r, c, greatest(ref, 0) AS ref, CASE WHEN ref < 0 OR (ref = 0 AND c_ref = 0 AND abs(cx) <= 1 AND abs(cy) <= 1) THEN 0 WHEN len(same) = 1 THEN xs[same[1]] ELSE list_sort(xs)[2] END AS x, CASE WHEN ref < 0 OR (ref = 0 AND c_ref = 0 AND abs(cx) <= 1 AND abs(cy) <= 1) THEN 0 WHEN len(same) = 1 THEN ys[same[1]] ELSE list_sort(ys)[2] END AS y FROM m""")
def direct_spatial(spark, sf_dir):
    """The least reference of three neighbours and the motion they predict for it; still where the colocated block hardly moves."""
    grid = _blocks(spark, sf_dir)
    # each block tells those that it is a neighbour of: left, above, above right, above left
    pic, r, c = F.col("pic"), F.col("r"), F.col("c")
    to = lambda name, rr, cc: F.struct(F.lit(name).alias("side"), rr.alias("r"), cc.alias("c"))
    sent = grid.where("pic % 2 = 1").select("pic", F.struct("ref0", "x0", "y0").alias("m"), F.explode(F.array(to("a", r, c + 1), to("b", r + 1, c), to("d", r + 1, c - 1), to("e", r + 1, c + 1))).alias("t"))
    near = sent.groupBy("pic", F.col("t.r").alias("r"), F.col("t.c").alias("c")).agg(*[F.max(F.when(F.col("t.side") == s, F.col("m"))).alias(s) for s in "abde"])
    df = _with_colocated(grid).join(near, ["pic", "r", "c"], "left")
    three = F.array("a", "b", F.coalesce("d", "e"))
    refs = F.transform(three, lambda m: F.coalesce(m["ref0"], F.lit(-1)))
    ref = F.coalesce(F.array_min(F.filter(refs, lambda v: v >= 0)), F.lit(-1))
    df = df.withColumn("three", three).withColumn("ref", ref)
    same = F.filter("three", lambda m: m["ref0"] == F.col("ref"))
    still = (F.col("ref") < 0) | ((F.col("ref") == 0) & (F.col("c_ref") == 0) & (F.abs("cx") <= 1) & (F.abs("cy") <= 1))
    median = lambda n: F.get(F.array_sort(F.transform("three", lambda m: F.when(m["ref0"] >= 0, m[n]).otherwise(0))), F.lit(1))
    part = lambda n: F.when(still, 0).when(F.size(same) == 1, F.get(same, F.lit(0))[n]).otherwise(median(n))
    return df.select("pic", "r", "c", F.greatest(F.col("ref"), F.lit(0)).alias("ref"), part("x0").alias("x"), part("y0").alias("y"))
