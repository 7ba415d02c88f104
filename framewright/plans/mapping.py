"""Maps between the parameters of tracks, streams and channels, first matches in a buffer, and the alignment of two signals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import bits as bt
from ..tables import PACKETS, literal, packets, table

#: Codecs of the tracks made here: interchange names, fixed values.
CODECS = (
    "aac", "opus", "flac", "vorbis", "wavpack", "alac", "mp1", "mp2", "mp3", "adpcm_ima_wav", "adpcm_ms", "ac3", "pcm_u8", "pcm_s16le", "pcm_s16be", "pcm_u16le", "pcm_u16be", "pcm_s24le", "pcm_s24be", "pcm_u24le", "pcm_u24be",
    "pcm_s32le", "pcm_s32be", "pcm_u32le", "pcm_u32be", "pcm_f32le", "pcm_f32be", "pcm_f64le", "pcm_f64be",
)


@query(f"""WITH t AS (SELECT o_orderkey, {list(CODECS)}[o_orderkey % {len(CODECS)} + 1] AS codec, CASE WHEN o_custkey % 7 = 0 THEN concat(1001, '/', 1000 * (1 + o_custkey % 60)) END AS base, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 8 + 1 END AS declared, o_custkey % 9 AS hint, [8, 16, 24, 32, 64][o_custkey % 5 + 1] AS bits, CASE WHEN o_custkey % 5 > 0 THEN 8000 * (o_custkey % 5) END AS rate FROM orders),
c AS (SELECT *, CAST(coalesce(declared, CASE codec WHEN 'aac' THEN CASE WHEN hint BETWEEN 1 AND 6 THEN hint WHEN hint = 7 THEN 8 ELSE 0 END WHEN 'opus' THEN hint ELSE 0 END) AS BIGINT) AS channels FROM t)
SELECT o_orderkey, codec, channels, CASE channels WHEN 0 THEN NULL WHEN 1 THEN 'mono' WHEN 2 THEN 'stereo' WHEN 6 THEN '5.1' WHEN 8 THEN '7.1' ELSE concat(channels, ' channels') END AS layout,
 CASE WHEN codec = 'pcm_u8' THEN 'u8' WHEN codec IN ('pcm_s16le', 'pcm_s16be', 'pcm_u16le', 'pcm_u16be', 'adpcm_ima_wav', 'adpcm_ms') THEN 's16' WHEN codec IN ('pcm_f32le', 'pcm_f32be', 'aac', 'opus', 'vorbis', 'mp1', 'mp2', 'mp3') THEN 'flt' WHEN codec IN ('pcm_f64le', 'pcm_f64be') THEN 'dbl'
 WHEN codec IN ('flac', 'alac', 'wavpack') AND bits <= 16 THEN 's16' ELSE 's32' END AS sample_format, coalesce(base, '1/' || rate) AS time_base FROM c""")
def track_parameters(spark, sf_dir):
    """Streams from tracks: channels as declared, else from the codec's own bytes; sample format by the codec's name and depth; the track's time base, else one by its rate."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    codec = F.get(F.array(*map(F.lit, CODECS)), (k % len(CODECS)).cast("int"))
    hint = (c % 9).cast("int")
    own = F.when(codec == "aac", F.concat(F.lit("12"), F.lpad(F.hex(F.shiftleft(hint, 3)), 2, "0"))).when(codec == "opus", F.concat(F.hex(F.lit("OpusHead")), F.lit("01"), F.lpad(F.hex(hint), 2, "0")))
    df = table(spark, sf_dir, "orders").select(k, codec.alias("codec"), F.when(c % 3 == 0, c % 8 + 1).alias("declared"), F.unhex(own).alias("extra"), F.get(F.array(*map(F.lit, (8, 16, 24, 32, 64))), (c % 5).cast("int")).alias("bits"), F.when(c % 5 > 0, 8000 * (c % 5)).alias("rate"), F.when(c % 7 == 0, F.concat(F.lit("1001/"), (1000 * (1 + c % 60)).cast("string"))).alias("base"))
    setting = F.shiftright(bt.uint("extra", 1, 1), 3).bitwiseAND(15)
    aac = F.when(setting.between(1, 6), setting).when(setting == 7, 8).otherwise(0)
    opus = F.when(F.substring("extra", 1, 8) == F.encode(F.lit("OpusHead"), "utf-8"), bt.uint("extra", 9, 1)).otherwise(0)
    df = df.withColumn("channels", F.coalesce("declared", F.when(F.col("codec") == "aac", aac).when(F.col("codec") == "opus", opus), F.lit(0)).cast("long"))
    n, name = F.col("channels"), F.col("codec")
    layout = F.when(n == 1, "mono").when(n == 2, "stereo").when(n == 6, "5.1").when(n == 8, "7.1").when(n > 0, F.concat(n.cast("string"), F.lit(" channels")))
    width = F.regexp_extract(name, "^pcm_[suf]([0-9]+)", 1)
    form = F.when(width == "8", "u8").when((width == "16") | name.startswith("adpcm_"), "s16").when(name.startswith("pcm_f"), F.when(width == "32", "flt").otherwise("dbl"))
    form = form.when(name.isin("aac", "opus", "vorbis", "mp1", "mp2", "mp3"), "flt").when(name.isin("flac", "alac", "wavpack") & (F.col("bits") <= 16), "s16").otherwise("s32")
    return df.select("o_orderkey", "codec", "channels", layout.alias("layout"), form.alias("sample_format"), F.coalesce("base", F.concat(F.lit("1/"), F.col("rate").cast("string"))).alias("time_base"))


@query("""WITH t AS (SELECT p_partkey, ['h264', 'av1', 'vp9', 'aac', 'pcm_s16le', 'opus', 'pcm_f64be', 'subrip'][p_partkey % 8 + 1] AS codec, CASE WHEN p_size % 4 > 0 THEN p_size * 1000 ELSE 0 END AS rate, CASE WHEN p_size % 3 > 0 THEN p_size * 30 ELSE 0 END AS den FROM part)
SELECT p_partkey, codec, codec IN ('h264', 'av1', 'aac', 'pcm_s16le', 'pcm_f64be') AS supported, CAST(CASE WHEN codec = 'subrip' THEN 1000 WHEN codec IN ('h264', 'av1', 'vp9') THEN CASE WHEN den > 0 THEN den ELSE 90000 END WHEN rate > 0 THEN rate ELSE 44100 END AS INTEGER) AS timescale FROM t""")
def muxer_choice(spark, sf_dir):
    """Whether a container takes a codec, and the time scale of its track."""
    codec = F.get(F.array(*map(F.lit, ("h264", "av1", "vp9", "aac", "pcm_s16le", "opus", "pcm_f64be", "subrip"))), (F.col("p_partkey") % 8).cast("int"))
    size = F.col("p_size")
    rate, den = F.when(size % 4 > 0, size * 1000).otherwise(0), F.when(size % 3 > 0, size * 30).otherwise(0)
    taken = ("h264", "av1", "aac", *(f"pcm_{x}" for x in ("s16be", "s16le", "s24be", "s24le", "s32be", "s32le", "f32be", "f32le", "f64be", "f64le")))
    df = table(spark, sf_dir, "part").select("p_partkey", codec.alias("codec"), rate.alias("rate"), den.alias("den"))
    name = F.col("codec")
    scale = F.when(name == "subrip", 1000).when(name.isin("h264", "av1", "vp9"), F.when(F.col("den") > 0, F.col("den")).otherwise(90_000)).when(F.col("rate") > 0, F.col("rate")).otherwise(44_100)
    return df.select("p_partkey", "codec", name.isin(*taken).alias("supported"), scale.alias("timescale"))


#: Numbers and names of pixel formats: fixed values for exchange.
PIXELS = (
    (0, "yuv420p"), (1, "yuyv422"), (2, "rgb24"), (3, "bgr24"), (4, "yuv422p"), (5, "yuv444p"), (6, "yuv410p"), (7, "yuv411p"), (8, "gray8"), (9, "monowhite"), (10, "monoblack"), (11, "pal8"),
    (12, "yuvj420p"), (13, "yuvj422p"), (14, "yuvj444p"), (15, "uyvy422"), (23, "nv12"), (24, "nv21"), (25, "argb"), (26, "rgba"), (27, "abgr"), (28, "bgra"), (29, "gray16be"), (30, "gray16le"),
)
#: Numbers and names of colour primaries, and of chroma places: fixed values for exchange.
PRIMARIES = ((1, "bt709"), (2, "unknown"), (4, "bt470m"), (5, "bt470bg"), (6, "smpte170m"), (7, "smpte240m"), (8, "film"), (9, "bt2020"), (10, "smpte428"), (11, "smpte431"), (12, "smpte432"), (22, "ebu3213"))
PLACES = ((0, "unspecified"), (1, "left"), (2, "center"), (3, "topleft"), (4, "top"), (5, "bottomleft"), (6, "bottom"))


def _values(rows) -> str:
    return ", ".join(f"({i}, '{n}')" for i, n in rows)


@query(f"""WITH x AS (SELECT * FROM (VALUES {_values(PIXELS)}) t(id, name)), c AS (SELECT * FROM (VALUES {_values(PRIMARIES)}) t(id, name)), l AS (SELECT * FROM (VALUES {_values(PLACES)}) t(id, name))
SELECT p_partkey, x.name AS pixel, c.name AS primaries, l.name AS place, p_size BETWEEN 1 AND 15 AS is_planar FROM part LEFT JOIN x ON p_size = x.id LEFT JOIN c ON p_partkey % 24 = c.id LEFT JOIN l ON p_partkey % 9 = l.id""")
def format_names(spark, sf_dir):
    """Numbers of pixel formats, primaries and chroma places as names; a number without one has none."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 24).alias("c"), (F.col("p_partkey") % 9).alias("l"))
    for rows, key, name in ((PIXELS, "p_size", "pixel"), (PRIMARIES, "c", "primaries"), (PLACES, "l", "place")):
        names = literal(spark, rows, f"{name}_id int, {name} string")
        df = df.join(F.broadcast(names), F.col(key) == F.col(f"{name}_id"), "left")
    return df.select("p_partkey", "pixel", "primaries", "place", F.col("p_size").between(1, 15).alias("is_planar"))


#: Channels, each with its bit in either of two kinds of mask: fixed values for exchange.
CHANNELS = (
    ("FL", 0, 0), ("FR", 1, 1), ("FC", 2, 2), ("LFE", 3, 3), ("BL", 4, 4), ("BR", 5, 5), ("FLC", 6, 6), ("FRC", 7, 7), ("BC", 8, 8), ("SL", 9, 9), ("SR", 10, 10),
    ("TC", 11, 11), ("TFL", 12, 12), ("TFC", 13, 13), ("TFR", 14, 14), ("TBL", 15, 15), ("TBC", 16, 16), ("TBR", 17, 17), ("LFE2", 35, 26),
)
_CHANNELS_SQL = ", ".join(f"('{n}', {a}, {b})" for n, a, b in CHANNELS)


@query(f"""WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE ((o_custkey * 2654435761 + o_orderkey) % 262144) + CASE WHEN o_custkey % 4 = 0 THEN 34359738368 ELSE 0 END END AS mask, o_orderkey % 4 AS n FROM orders),
c AS (SELECT * FROM (VALUES {_CHANNELS_SQL}) t(name, own, other)), j AS (SELECT o_orderkey, mask, n, name, own, other FROM m LEFT JOIN c ON (mask >> own) & 1 = 1)
SELECT o_orderkey, CAST(mask AS BIGINT) AS mask, CAST(CASE WHEN mask = 0 THEN CASE n WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END ELSE sum(CASE WHEN name IS NOT NULL THEN 1::BIGINT << other ELSE 0 END) END AS BIGINT) AS other_mask, coalesce(string_agg(name, '+' ORDER BY own), '') AS channels FROM j GROUP BY o_orderkey, mask, n""")
def channel_sets(spark, sf_dir):
    """A set of channels as the other kind of mask and as names; an empty set of one or two channels is the front ones."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    mask = F.when(k % 11 == 0, F.lit(0)).otherwise((c * 2_654_435_761 + k) % 262_144 + F.when(c % 4 == 0, F.lit(34_359_738_368)).otherwise(0)).cast("long")
    df = table(spark, sf_dir, "orders").select(k, mask.alias("mask"), (k % 4).alias("n"))
    has = lambda own: F.shiftright(F.col("mask"), own).bitwiseAND(1) == 1
    other = sum((F.when(has(a), F.lit(1 << b)).otherwise(0) for _, a, b in CHANNELS), F.lit(0)).cast("long")
    fallback = F.when(F.col("n") == 1, 1).when(F.col("n") == 2, 3).otherwise(0).cast("long")
    return df.select("o_orderkey", "mask", F.when(F.col("mask") == 0, fallback).otherwise(other).alias("other_mask"), F.concat_ws("+", *[F.when(has(a), n) for n, a, _ in CHANNELS]).alias("channels"))


@query("""WITH pics AS (SELECT o_orderkey AS seq, o_orderkey // 64 AS seg, o_orderkey % 16 AS frame_num, o_orderkey % 4 <> 3 AS is_ref, o_custkey % 5 = 0 AS is_long, o_custkey % 16 AS wanted FROM orders),
b AS (SELECT p.seq, p.wanted, q.seq AS ref, q.is_long, q.frame_num, row_number() OVER (PARTITION BY p.seq ORDER BY q.seq) - 1 AS slot FROM pics p JOIN pics q ON p.seg = q.seg AND q.seq < p.seq AND q.seq >= p.seq - 16 AND q.is_ref)
SELECT pics.seq, pics.wanted, CAST(min(slot) FILTER (NOT b.is_long AND b.frame_num = b.wanted) AS INTEGER) AS short_slot, CAST(min(slot) FILTER (b.is_long AND b.frame_num = b.wanted) AS INTEGER) AS long_slot, count(b.ref) >= 12 AS is_full FROM pics LEFT JOIN b ON pics.seq = b.seq GROUP BY pics.seq, pics.wanted""")
def buffer_first_match(spark, sf_dir):
    """The first short-term and the first long-term entry of the buffer with a wanted number, and whether the buffer is full."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    df = table(spark, sf_dir, "orders").select(k.alias("seq"), F.floor(k / 64).alias("seg"), (k % 16).alias("num"), (k % 4 != 3).alias("is_ref"), (c % 5 == 0).alias("is_long"), (c % 16).alias("wanted"))
    entry = F.when(F.col("is_ref"), F.struct("num", "is_long"))
    df = df.withColumn("held", F.collect_list(entry).over(Window.partitionBy("seg").orderBy("seq").rangeBetween(-16, -1)))
    first = lambda long: F.nullif(F.array_position(F.transform("held", lambda x: (x["is_long"] == long) & (x["num"] == F.col("wanted"))), True), F.lit(0).cast("long")).cast("int") - 1
    return df.select("seq", "wanted", first(False).alias("short_slot"), first(True).alias("long_slot"), (F.size("held") >= 12).alias("is_full"))


#: Samples that are compared, and how far apart the signals may be.
WINDOW, SHIFTS = 1000, 264


@query(f"""WITH {PACKETS}, s AS (SELECT seq // 1264 AS seg, seq % 1264 AS i, size FROM packets), n AS (SELECT seg, count(*) AS n FROM s GROUP BY seg), f AS (SELECT seg, seg * 37 % 200 AS delay, n FROM n),
r AS (SELECT s.seg, i - delay AS i, size FROM s JOIN f ON s.seg = f.seg WHERE i >= delay), w AS (SELECT seg, least(1000, n, n - delay) AS win, least(264, n - least(1000, n, n - delay)) AS shifts FROM f),
o AS (SELECT seg, win, unnest(range(0, shifts)) AS off FROM w), d AS (SELECT o.seg, off, CAST(sum(CAST(r.size AS BIGINT) * s.size) AS BIGINT) AS dot FROM o JOIN r ON r.seg = o.seg AND r.i < win JOIN s ON s.seg = o.seg AND s.i = r.i + off GROUP BY o.seg, off)
SELECT seg, CAST(off AS BIGINT) AS off, dot FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY dot DESC, off) AS k FROM d) WHERE k = 1""")
def align_signals(spark, sf_dir):
    """The shift at which 1,000 samples of one signal are most like another; of equals the first. A segment of 1,264 samples is a row."""

    @F.arrow_udf("array<bigint>")
    def products(reference: pa.Array, test: pa.Array) -> pa.Array:
        out = []
        for r, t in zip(reference, test):
            a, b = (np.asarray(x.values, np.int64) for x in (r, t))
            win = min(WINDOW, len(a), len(b))
            out.append([int(a[:win] @ b[o : o + win]) for o in range(min(SHIFTS, len(b) - win))])
        return pa.array(out, pa.list_(pa.int64()))

    df = packets(spark, sf_dir).select(F.floor(F.col("seq") / 1264).alias("seg"), "seq", "size").groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("seq", "size"))).alias("s"))
    df = df.select("seg", F.col("s.size").alias("test"))
    delay = (F.col("seg") * 37 % 200).cast("int")
    df = df.select("seg", products(F.slice("test", delay + 1, F.greatest(F.size("test") - delay, F.lit(0))), F.col("test")).alias("d")).where(F.size("d") > 0)
    return df.select("seg", (F.array_position("d", F.array_max("d")) - 1).alias("off"), F.array_max("d").alias("dot"))
