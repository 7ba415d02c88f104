"""Containers as relations: files written from tables as bytes of a group's rows, and read by walks whose units are rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import boxes as bx
from ..tables import table

_LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
_ORDER = ", ".join(_LINE)


def _per_order(spark, sf_dir, unit):
    """(l_orderkey, u): the units of an order's lines in their order; an order has a dozen lines."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE, unit.alias("u"))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*_LINE, "u"))), lambda x: x["u"]), "").alias("u"), F.count("*").alias("n"))


@query(f"""WITH l AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS size, l_partkey AS pts, row_number() OVER w - 1 AS n, coalesce(sum(CAST(l_quantity AS BIGINT) + 12) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_ORDER}))
SELECT l_orderkey, CAST(n AS INTEGER) AS n, CAST(32 + before AS BIGINT) AS pos, pts, size, 'DKIF' AS magic, 'AV01' AS fourcc, CAST(30 + l_orderkey % 30 AS BIGINT) AS rate, CAST(count(*) OVER (PARTITION BY l_orderkey) AS BIGINT) AS told FROM l""")
def ivf_frames(spark, sf_dir):
    """Frames of a simple container: a header of 32 bytes, then size and time before each frame."""
    size = F.col("l_quantity").cast("int")
    frame = F.concat(bx.little(size, 4), bx.little(F.col("l_partkey"), 8), F.repeat(F.lit("AB"), size))
    head = F.concat(F.hex(F.lit("DKIF")), bx.little(0, 2), bx.little(32, 2), F.hex(F.lit("AV01")), bx.little(640, 2), bx.little(480, 2), bx.little(30 + F.col("l_orderkey") % 30, 4), bx.little(1, 4), bx.little(F.col("n"), 4), bx.little(0, 4))
    files = _per_order(spark, sf_dir, frame).select("l_orderkey", F.concat(head, "u").alias("file"))
    f = F.col("file")
    found = files.select("l_orderkey", bx.text(f, 0, 4).alias("magic"), bx.text(f, 8, 4).alias("fourcc"), bx.read_little(f, 16, 4).alias("rate"), bx.read_little(f, 24, 4).alias("told"), F.posexplode(bx.frames(f)).alias("n", "x"))
    return found.select("l_orderkey", "n", "x.pos", "x.pts", "x.size", "magic", "fourcc", "rate", "told")


@query("""WITH c AS (SELECT c_custkey, 1 + c_nationkey % 2 AS channels, 8000 * (1 + c_custkey % 6) AS rate, 8 * (1 + c_custkey % 4) AS bits, octet_length(encode(c_name)) AS bytes, c_name FROM customer)
SELECT c_custkey, CAST(1 AS BIGINT) AS tag, CAST(channels AS BIGINT) AS channels, CAST(rate AS BIGINT) AS rate, CAST(rate * channels * bits // 8 AS BIGINT) AS byte_rate, CAST(channels * bits // 8 AS BIGINT) AS block, CAST(bits AS BIGINT) AS bits, CAST(36 + bytes AS BIGINT) AS riff_size, CAST(bytes AS BIGINT) AS data_size, c_name AS payload FROM c""")
def wav_headers(spark, sf_dir):
    """Files of samples: the header written as little-endian numbers, and read again."""
    k, channels = F.col("c_custkey"), 1 + F.col("c_nationkey") % 2
    rate, bits, body = 8000 * (1 + k % 6), 8 * (1 + k % 4), F.hex(F.encode("c_name", "utf-8"))
    block = channels * bits / 8
    size = F.length(body) / 2
    file = F.concat(F.hex(F.lit("RIFF")), bx.little(36 + size, 4), F.hex(F.lit("WAVEfmt ")), bx.little(16, 4), bx.little(1, 2), bx.little(channels, 2), bx.little(rate, 4), bx.little(rate * block, 4), bx.little(block, 2), bx.little(bits, 2), F.hex(F.lit("data")), bx.little(size, 4), body)
    df = table(spark, sf_dir, "customer").select(k, file.alias("f"))
    f = F.col("f")
    at = {"tag": (20, 2), "channels": (22, 2), "rate": (24, 4), "byte_rate": (28, 4), "block": (32, 2), "bits": (34, 2), "riff_size": (4, 4), "data_size": (40, 4)}
    sound = (bx.text(f, 0, 4) == "RIFF") & (bx.text(f, 8, 8) == "WAVEfmt ") & (bx.text(f, 36, 4) == "data")
    return df.where(sound).select("c_custkey", *[bx.read_little(f, a, n).alias(name) for name, (a, n) in at.items()], F.decode(F.unhex(F.substring(f, F.lit(89), F.length(f))), "utf-8").alias("payload"))


def _movie(spark, sf_dir):
    """(l_orderkey, file): boxes of a movie with one track, its sample tables made from an order's lines."""
    size, n = F.col("l_quantity").cast("long"), F.col("n")
    sizes = _per_order(spark, sf_dir, bx.big(size, 4)).withColumnRenamed("u", "sizes")
    times = _per_order(spark, sf_dir, F.concat(bx.big(1, 4), bx.big(F.col("l_suppkey") + 1, 4))).select(F.col("l_orderkey").alias("k"), F.col("u").alias("times"))
    df = sizes.join(times, F.col("l_orderkey") == F.col("k"))
    full = bx.big(0, 4)
    stbl = bx.box("stbl", bx.box("stts", full, bx.big(n, 4), F.col("times")), bx.box("stsz", full, bx.big(0, 4), bx.big(n, 4), F.col("sizes")), bx.box("stco", full, bx.big(1, 4), bx.big(F.col("l_orderkey") * 100, 4)))
    mdia = bx.box("mdia", bx.box("mdhd", full, bx.big(0, 8), bx.big(1000 + F.col("l_orderkey") % 7, 4), bx.big(n * 10, 4)), bx.box("minf", stbl))
    file = F.concat(bx.box("ftyp", F.hex(F.lit("isom")), bx.big(512, 4)), bx.box("free"), bx.box("moov", bx.box("mvhd", full, bx.big(0, 8), bx.big(600, 4), bx.big(n, 4)), bx.box("trak", mdia)))
    return df.select("l_orderkey", file.alias("file"))


_boxes = bx.box_tree(frozenset(("moov", "trak", "mdia", "minf", "stbl")))


def _tree(files):
    """(l_orderkey, file, b): a row for each box of a file, at any depth."""
    return files.select("l_orderkey", "file", F.explode(_boxes(F.col("file"))).alias("b"))


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey), s AS (SELECT l_orderkey, n, 8 + 8 + 8 * n AS stts, 8 + 12 + 4 * n AS stsz FROM n), z AS (SELECT *, 8 + stts + stsz + 20 AS stbl FROM s),
b AS (SELECT l_orderkey, n, stts, stsz, stbl, stbl + 8 AS minf, stbl + 8 + 8 + 28 AS mdia FROM z),
r AS (SELECT l_orderkey, unnest([{'p': '/ftyp', 'o': 0, 's': 8}, {'p': '/free', 'o': 16, 's': 0}, {'p': '/moov', 'o': 24, 's': 28 + mdia + 8}, {'p': '/moov/mvhd', 'o': 32, 's': 20}, {'p': '/moov/trak', 'o': 60, 's': mdia}, {'p': '/moov/trak/mdia', 'o': 68, 's': mdia - 8}, {'p': '/moov/trak/mdia/mdhd', 'o': 76, 's': 20}, {'p': '/moov/trak/mdia/minf', 'o': 104, 's': minf - 8},
 {'p': '/moov/trak/mdia/minf/stbl', 'o': 112, 's': stbl - 8}, {'p': '/moov/trak/mdia/minf/stbl/stts', 'o': 120, 's': stts - 8}, {'p': '/moov/trak/mdia/minf/stbl/stsz', 'o': 120 + stts, 's': stsz - 8}, {'p': '/moov/trak/mdia/minf/stbl/stco', 'o': 120 + stts + stsz, 's': 12}]) AS u FROM b)
SELECT l_orderkey, u.p AS path, CAST(u.o AS BIGINT) AS pos, CAST(u.s AS BIGINT) AS size FROM r""")
def movie_boxes(spark, sf_dir):
    """The tree of a movie's boxes: path, place and size of the payload of each."""
    return _tree(_movie(spark, sf_dir)).select("l_orderkey", "b.path", "b.pos", "b.size")


@query(f"""SELECT l_orderkey, row_number() OVER w AS n, CAST(l_quantity AS BIGINT) AS size, l_suppkey + 1 AS delta, CAST(coalesce(sum(l_suppkey + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dts,
 CAST(l_orderkey * 100 + coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place, CAST(1000 + l_orderkey % 7 AS BIGINT) AS timescale FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_ORDER})""")
def movie_samples(spark, sf_dir):
    """Samples of a movie from the leaf boxes of its bytes: sizes, times and places joined by the sample's number."""
    files = _movie(spark, sf_dir).withColumn("tree", _boxes(F.col("file")))
    leaf = lambda x: F.get(F.filter("tree", lambda b: b["kind"] == x), F.lit(0))
    cut = lambda x: F.substring(F.col("file"), (2 * (leaf(x)["pos"] + leaf(x)["head"]) + 1).cast("int"), (2 * leaf(x)["size"]).cast("int"))
    body = F.col
    df = files.select("l_orderkey", *[cut(x).alias(x) for x in ("stts", "stsz", "stco", "mdhd")]).select("l_orderkey", bx.read_big(body("mdhd"), 12, 4).alias("timescale"), bx.read_big(body("stco"), 8, 4).alias("first"), bx.entries(body("stts"), 8, ("count", "delta")).alias("t"), bx.entries(body("stsz"), 12, ("size",)).alias("s"))
    df = df.select("l_orderkey", "timescale", "first", F.posexplode(F.arrays_zip("t", "s")).alias("i", "x")).select("l_orderkey", "timescale", "first", (F.col("i") + 1).cast("long").alias("n"), F.col("x.s.size").alias("size"), F.col("x.t.delta").alias("delta"))
    w = Window.partitionBy("l_orderkey").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return df.select("l_orderkey", "n", "size", "delta", F.coalesce(F.sum("delta").over(w), F.lit(0)).alias("dts"), (F.col("first") + F.coalesce(F.sum("size").over(w), F.lit(0))).alias("place"), "timescale")


@query(f"""WITH l AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) * (1 + l_partkey % 5) AS body, row_number() OVER w - 1 AS n, l_linenumber FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_ORDER})),
h AS (SELECT *, 4 + body AS size, CASE WHEN 4 + body < 127 THEN 2 ELSE 3 END AS head FROM l)
SELECT l_orderkey, CAST(n AS INTEGER) AS n, CAST(coalesce(sum(head + size) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos, 'A3' AS id, CAST(size AS BIGINT) AS size, CAST(1 AS BIGINT) AS track, CAST(l_linenumber AS BIGINT) AS time_, CAST(128 AS BIGINT) AS flags FROM h""")
def cluster_blocks(spark, sf_dir):
    """Blocks of a cluster of elements with variable ids and sizes: track, time and flags of each."""
    body = (F.col("l_quantity").cast("long") * (1 + F.col("l_partkey") % 5)).cast("int")
    block = F.concat(F.lit("A3"), bx.varint((4 + body).cast("long")), F.lit("81"), bx.big(F.col("l_linenumber"), 2), F.lit("80"), F.repeat(F.lit("CD"), body))
    df = _per_order(spark, sf_dir, block).select("l_orderkey", "u", F.posexplode(bx.elements(F.col("u"))).alias("n", "e"))
    at = F.col("e.pos") + F.col("e.head")
    return df.select("l_orderkey", "n", "e.pos", "e.id", "e.size", (bx.read_big(F.col("u"), at, 1) - 0x80).alias("track"), bx.read_big(F.col("u"), at + 1, 2).alias("time_"), bx.read_big(F.col("u"), at + 3, 1).alias("flags"))
