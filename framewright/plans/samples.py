"""Samples and pixels: widening, bias, remix, planes, colour, trim."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import timebase as tb
from ..operators.scan import running_sum
from ..tables import BLOCKS, PACKETS, blocks, packets, table

_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]

#: The 18 speaker positions of a channel mask, in order of their bits.
CHANNELS = ("FL", "FR", "FC", "LFE", "BL", "BR", "FLC", "FRC", "BC", "SL", "SR", "TC", "TFL", "TFC", "TFR", "TBL", "TBC", "TBR")


@query(f"""WITH m AS (SELECT p_partkey, p_partkey * 7919 % 262144 AS mask FROM part)
SELECT p_partkey, mask, array_to_string(list_filter(list_transform(range(0, 18), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN list_extract([{', '.join(f"'{c}'" for c in CHANNELS)}], i + 1) END), lambda x: x IS NOT NULL), '+') AS channels, CAST(bit_count(mask) AS INTEGER) AS n FROM m""")
def channel_mask_expand(spark, sf_dir):
    """A mask's bits as the list of its channels."""
    df = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7919 % 262144).alias("mask"))
    names = F.array(*map(F.lit, CHANNELS))
    picked = F.filter(F.transform(names, lambda c, i: F.when(F.getbit("mask", i) == 1, c)), lambda x: x.isNotNull())
    return df.select("p_partkey", "mask", F.array_join(picked, "+").alias("channels"), F.bit_count("mask").alias("n"))


@query(f"""WITH {BLOCKS}, f AS (SELECT vec_id, unnest(range(0, 10)) AS frame, a FROM blocks)
SELECT vec_id, frame, round(a[frame * 6 + 1] + (a[frame * 6 + 3] + a[frame * 6 + 5]) / sqrt(2), 4) AS l, round(a[frame * 6 + 2] + (a[frame * 6 + 3] + a[frame * 6 + 6]) / sqrt(2), 4) AS r FROM f""")
def channel_remix(spark, sf_dir):
    """Six channels to two: centre and surround at 1/sqrt(2), the low-frequency channel left out."""
    at = lambda i: F.get("a", F.col("frame").cast("int") * 6 + i)
    df = blocks(spark, sf_dir).select("vec_id", "a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("frame"))
    return df.select("vec_id", "frame", F.round(at(0) + (at(2) + at(4)) / F.sqrt(F.lit(2.0)), 4).alias("l"), F.round(at(1) + (at(2) + at(5)) / F.sqrt(F.lit(2.0)), 4).alias("r"))


@query(f"""WITH {BLOCKS}, s AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(a) AS v FROM blocks)
SELECT vec_id, i, v / 32768.0::DOUBLE AS s16, (v % 128) / 128.0::DOUBLE AS u8, v / 2147483648.0::DOUBLE AS s32, v * 3 / 4.0::DOUBLE AS gained FROM s""")
def sample_to_float(spark, sf_dir):
    """Whole samples as fractions of full scale, and with a gain."""
    df = blocks(spark, sf_dir).select("vec_id", F.posexplode("a").alias("i", "v"))
    return df.select("vec_id", F.col("i").cast("long").alias("i"), (F.col("v") / 32768.0).alias("s16"), ((F.col("v") % 128) / 128.0).alias("u8"), (F.col("v") / 2147483648.0).alias("s32"), (F.col("v") * 3 / 4.0).alias("gained"))


@query(f"""WITH s AS (SELECT {', '.join(_KEY)}, l_partkey * 31 % 65536 - 32768 AS v FROM lineitem)
SELECT {', '.join(_KEY)}, ((v + 32768) % 65536 + 65536) % 65536 AS u16, v << 8 AS s24_in_32, (v * 65536) >> 8 AS s24, ((v + 32768) >> 8) - 128 AS s8, v - 32768 AS widened FROM (SELECT {', '.join(_KEY)}, CAST(v AS BIGINT) AS v FROM s)""".replace("v << 8", "v * 256"))
def pcm_bias_pack(spark, sf_dir):
    """Signed and unsigned samples, and 24 bits in 32."""
    v = F.col("v")
    df = table(spark, sf_dir, "lineitem").select(*_KEY, (F.col("l_partkey") * 31 % 65536 - 32768).alias("v"))
    return df.select(*_KEY, F.pmod(v + 32768, F.lit(65536)).alias("u16"), F.shiftleft(v, 8).alias("s24_in_32"), F.shiftright(v * 65536, 8).alias("s24"), (F.shiftright(v + 32768, 8) - 128).alias("s8"), (v - 32768).alias("widened"))


@query("""WITH h AS (SELECT o_orderkey, printf('%08x', o_orderkey * 2654435761 % 4294967296) AS h FROM orders)
SELECT o_orderkey, h, concat(h[7:8], h[5:6], h[3:4], h[1:2]) AS le32, concat(h[3:4], h[1:2], h[7:8], h[5:6]) AS le16 FROM h""")
def byte_swap(spark, sf_dir):
    """Bytes of 4-byte and 2-byte samples in reverse."""
    h = F.lower(F.lpad(F.hex(F.col("o_orderkey") * 2654435761 % 4294967296), 8, "0"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", h.alias("h"))
    pair = lambda i: F.substring("h", 2 * i + 1, 2)
    return df.select("o_orderkey", "h", F.concat(pair(3), pair(2), pair(1), pair(0)).alias("le32"), F.concat(pair(1), pair(0), pair(3), pair(2)).alias("le16"))


@query(f"WITH {BLOCKS} SELECT vec_id, list_transform(range(0, 64), lambda i: a[CASE WHEN i % 2 = 0 THEN i // 2 ELSE 32 + i // 2 END + 1]) AS inter FROM blocks".replace("AS inter", "::VARCHAR AS inter"))
def interleave_planes(spark, sf_dir):
    """Two planes of 32 samples as one interleaved run."""
    pairs = F.arrays_zip(F.slice("a", 1, 32).alias("x"), F.slice("a", 33, 32).alias("y"))
    both = F.flatten(F.transform(pairs, lambda p: F.array(p["x"], p["y"])))
    return blocks(spark, sf_dir).select("vec_id", F.concat(F.lit("["), F.array_join(both, ", "), F.lit("]")).alias("inter"))


@query(f"""WITH {BLOCKS}, p AS (SELECT vec_id, unnest(range(0, 16)) AS i, a FROM blocks), y AS (SELECT vec_id, i, (a[i + 1] % 256 + 256) % 256 AS y, (a[i // 2 + 17] % 256 + 256) % 256 - 128 AS u, (a[i // 2 + 33] % 256 + 256) % 256 - 128 AS v FROM p)
SELECT vec_id, i, least(greatest((298 * (y - 16) + 409 * v + 128) >> 8, 0), 255) AS r, least(greatest((298 * (y - 16) - 100 * u - 208 * v + 128) >> 8, 0), 255) AS g, least(greatest((298 * (y - 16) + 516 * u + 128) >> 8, 0), 255) AS b FROM y""")
def yuv_to_rgb(spark, sf_dir):
    """Limited-range BT.601 pixels as RGB, in whole numbers."""
    df = blocks(spark, sf_dir).select("vec_id", "a", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    byte = lambda at: F.pmod(F.get("a", at), F.lit(256))
    half = F.floor(F.col("i") / 2).cast("int")
    df = df.select("vec_id", F.col("i").cast("long").alias("i"), (byte(F.col("i")) - 16).alias("y"), (byte(half + 16) - 128).alias("u"), (byte(half + 32) - 128).alias("v"))
    y, u, v = F.col("y") * 298, F.col("u"), F.col("v")
    out = lambda x: F.least(F.greatest(F.shiftright(x + 128, 8), F.lit(0)), F.lit(255))
    return df.select("vec_id", "i", out(y + 409 * v).alias("r"), out(y - 100 * u - 208 * v).alias("g"), out(y + 516 * u).alias("b"))


@query(f"WITH {BLOCKS} SELECT vec_id, unnest(range(0, 4)) AS row_, unnest(list_transform(range(0, 4), lambda r: list_sum(a[(label % 4 + r) * 8 + 3:(label % 4 + r) * 8 + 6]))) AS total FROM blocks".replace("AS total", "::BIGINT AS total"))
def plane_crop(spark, sf_dir):
    """Rows of a 4 by 4 window of an 8 by 8 plane, and their sums."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.slice("a", (F.col("label") % 4 + r) * 8 + 3, 4))
    df = blocks(spark, sf_dir).select("vec_id", F.posexplode(rows).alias("row_", "cells"))
    return df.select("vec_id", F.col("row_").cast("long").alias("row_"), F.aggregate("cells", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("""WITH p AS (SELECT p_partkey, p_size * 16 AS sw, p_partkey % 40 * 9 + 90 AS sh FROM part), s AS (SELECT *, least(1280.0::DOUBLE / sw, 720.0::DOUBLE / sh) AS k FROM p)
SELECT p_partkey, CAST(floor(sw * k + 1e-9) AS BIGINT) AS w, CAST(floor(sh * k + 1e-9) AS BIGINT) AS h, round((1280 - sw * k) / 2, 3) AS x, round((720 - sh * k) / 2, 3) AS y FROM s""")
def viewport_fit(spark, sf_dir):
    """The largest rectangle of a picture's shape inside 1280 by 720, centred."""
    df = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 16).alias("sw"), (F.col("p_partkey") % 40 * 9 + 90).alias("sh"))
    df = df.withColumn("k", F.least(1280.0 / F.col("sw"), 720.0 / F.col("sh")))
    w, h = F.col("sw") * F.col("k"), F.col("sh") * F.col("k")
    return df.select("p_partkey", F.floor(w + 1e-9).alias("w"), F.floor(h + 1e-9).alias("h"), F.round((1280 - w) / 2, 3).alias("x"), F.round((720 - h) / 2, 3).alias("y"))


@query(f"""WITH {BLOCKS}, t AS (SELECT vec_id, a, least(vec_id % 40, 64) AS s, greatest(64 - vec_id % 50, 0) AS e FROM blocks)
SELECT vec_id, s AS start_, greatest(e, s) - s AS n, CAST(coalesce(list_sum(a[s + 1:greatest(e, s)]), 0) AS BIGINT) AS kept FROM t""")
def gapless_trim(spark, sf_dir):
    """Samples at the ends that an encoder added go, clamped to what there is."""
    df = blocks(spark, sf_dir).withColumn("s", F.least(F.col("vec_id") % 40, F.lit(64)).cast("int"))
    df = df.withColumn("e", F.greatest(F.greatest(64 - F.col("vec_id") % 50, F.lit(0)), F.col("s")).cast("int"))
    kept = F.aggregate(F.slice("a", F.col("s") + 1, F.col("e") - F.col("s")), F.lit(0).cast("long"), lambda t, x: t + x)
    return df.select("vec_id", F.col("s").cast("long").alias("start_"), (F.col("e") - F.col("s")).cast("long").alias("n"), kept.alias("kept"))


@query(f"""WITH {PACKETS}, r AS (SELECT seq, stream_index, size, coalesce(sum(size) OVER (PARTITION BY stream_index ORDER BY pts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM packets)
SELECT seq, CAST(greatest(0, least(size, 100000 - before)) AS BIGINT) AS trim, CAST(size - greatest(0, least(size, 100000 - before)) AS BIGINT) AS left_ FROM r""")
def trim_budget(spark, sf_dir):
    """An encoder's delay, taken from the first packets of each stream until it is used up."""
    df = running_sum(packets(spark, sf_dir), ["stream_index"], ["pts"], F.col("size"), "before")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), 100_000 - F.col("before")))
    return df.select("seq", cut.alias("trim"), (F.col("size") - cut).alias("left_"))


@query("""WITH t AS (SELECT event_id, user_id, concat(' 00000000 ', printf('%08X', event_id % 5000), ' ', printf('%08X', user_id % 3000), ' 0') AS tag FROM events)
SELECT event_id, tag, event_id % 5000 AS delay, user_id % 3000 AS padding FROM t""")
def gapless_tag_parse(spark, sf_dir):
    """Delay and padding, the first two hexadecimal fields after a tag's mark."""
    tag = F.concat(F.lit(" 00000000 "), F.format_string("%08X", F.col("event_id") % 5000), F.lit(" "), F.format_string("%08X", F.col("user_id") % 3000), F.lit(" 0"))
    df = table(spark, sf_dir, "events").select("event_id", tag.alias("tag")).withColumn("f", F.split(F.trim("tag"), r"\s+"))
    return df.select("event_id", "tag", F.conv(F.get("f", F.lit(1)), 16, 10).cast("long").alias("delay"), F.conv(F.get("f", F.lit(2)), 16, 10).cast("long").alias("padding"))


@query("SELECT o_orderkey, CAST((o_orderkey % 977 * 48000 + CASE WHEN o_custkey % 3 = 0 THEN 44100 ELSE 90000 END // 2) // CASE WHEN o_custkey % 3 = 0 THEN 44100 ELSE 90000 END AS BIGINT) AS movie_duration, CAST(ceil(o_orderkey % 977 * 44100 / 48000.0::DOUBLE) AS BIGINT) AS resampled FROM orders")
def duration_rescale(spark, sf_dir):
    """Media durations in the movie's time scale, and the samples that a resampler gives."""
    df = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderkey") % 977).withColumn("ts", F.when(F.col("o_custkey") % 3 == 0, 44100).otherwise(90000))
    return df.select("o_orderkey", tb.rescale(F.col("d"), F.lit(48000), F.col("ts"), "near").alias("movie_duration"), F.ceil(F.col("d") * 44100 / 48000.0).alias("resampled"))
