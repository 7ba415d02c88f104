"""Further operators: graphs of filters, resequencing, relocation, noise, names, taps and masks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import kernels as k
from ..plugins import REGISTRY
from ..tables import BLOCKS, PACKETS, blocks, literal, packets, table


@query(f"WITH {PACKETS} SELECT seq, stream_index::INTEGER AS stream_index, pts + 500 AS pts, size * 2 AS size FROM packets WHERE stream_index IN (0, 2) UNION ALL SELECT seq, stream_index::INTEGER, pts, size FROM packets WHERE stream_index = 3")
def filter_graph(spark, sf_dir):
    """Filters by name as a chain of transforms: two streams amplified and moved, merged with a third."""
    log = packets(spark, sf_dir).select("seq", "stream_index", "pts", "size")
    use = lambda name, **options: REGISTRY.named("filter", name).make(**options)
    loud = log.transform(use("streams", keep=(0, 2))).transform(use("gain", by=2)).transform(use("shift", us=500))
    return loud.transform(use("merge", other=log.transform(use("streams", keep=(3,)))))


@query("""WITH e AS (SELECT event_id, event_id % 32 AS arrival, event_id // 32 AS batch, ((event_id % 32) * 13 + event_id // 32) % 32 AS need FROM events)
SELECT event_id, batch, need, max(arrival) OVER (PARTITION BY batch ORDER BY need) AS released FROM e""")
def fifo_resequence(spark, sf_dir):
    """Results that come out of order leave in order: each when it and all before it are there."""
    from pyspark.sql import Window

    e = F.col("event_id")
    df = table(spark, sf_dir, "events").select(e, F.floor(e / 32).alias("batch"), (e % 32).alias("arrival")).withColumn("need", (F.col("arrival") * 13 + F.col("batch")) % 32)
    return df.select("event_id", "batch", "need", F.max("arrival").over(Window.partitionBy("batch").orderBy("need")).alias("released"))


@query("""WITH f AS (SELECT l_orderkey AS file, count(*) AS n, max(l_partkey) * 1000000 AS top FROM lineitem GROUP BY l_orderkey), a AS (SELECT file, n, top, 100 + n * 4 AS short, 100 + n * 8 AS long FROM f)
SELECT file, CASE WHEN top + short > 130000000 THEN long ELSE short END AS index_size, top + CASE WHEN top + short > 130000000 THEN long ELSE short END AS last_offset, top + short > 130000000 AS wide FROM a""")
def faststart_relocate(spark, sf_dir):
    """Offsets when the index moves before the payload: it grows if its own size makes them need wide fields."""
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.count("*").alias("n"), (F.max("l_partkey") * 1_000_000).alias("top"))
    wide = F.col("top") + 100 + F.col("n") * 4 > 130_000_000
    size = 100 + F.col("n") * F.when(wide, 8).otherwise(4)
    return df.select("file", size.cast("long").alias("index_size"), (F.col("top") + size).cast("long").alias("last_offset"), wide.alias("wide"))


@query("SELECT vec_id, list_reduce(list_concat([vec_id + 1], range(0, 8)), lambda s, x: (s * 314159 + 1) % 4294967296) AS seed, (list_reduce(list_concat([vec_id + 1], range(0, 8)), lambda s, x: (s * 314159 + 1) % 4294967296) >> 16) - 32768 AS noise FROM embeddings")
def lcg_noise(spark, sf_dir):
    """Eight steps of the test source's noise from a seed."""
    seed = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.col("vec_id") + 1, lambda s, _: (s * 314159 + 1) % 4294967296)
    return table(spark, sf_dir, "embeddings").select("vec_id", seed.alias("seed"), (F.shiftright(seed, 16) - 32768).alias("noise"))


@query("SELECT page_id, CASE WHEN regexp_extract(url, '^([a-z]+):', 1) IN ('http', 'https', 'file', 'hdfs', 's3a') THEN regexp_extract(url, '^([a-z]+):', 1) ELSE 'file' END AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages")
def protocol_open(spark, sf_dir):
    """The scheme that opens a path; unknown ones are local paths."""
    scheme = F.regexp_extract("url", "^([a-z]+):", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.when(scheme.isin("http", "https", "file", "hdfs", "s3a"), scheme).otherwise("file").alias("scheme"), F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"))


#: Tags of files under their standard names: fixed values.
TAGS = (("TIT2", "title"), ("TPE1", "artist"), ("TALB", "album"), ("TYER", "date"), ("TDRC", "date"), ("TCON", "genre"), ("TRCK", "track"), ("TPOS", "disc"), ("TCOM", "composer"), ("COMM", "comment"))


@query(f"""WITH n AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(TAGS))}) t(i, raw, std)) SELECT event_id, raw, std, CASE WHEN std IN ('track', 'disc') THEN concat(CAST(event_id % 12 AS VARCHAR), '/', CAST(12 AS VARCHAR)) ELSE event_type END AS value FROM events JOIN n ON event_id % 10 = i""")
def tag_normalise(spark, sf_dir):
    """Raw tag names as standard ones; numbers of tracks and discs take their totals."""
    raw = F.element_at(F.array(*[F.lit(a) for a, _ in TAGS]), (F.col("event_id") % 10 + 1).cast("int"))
    std = F.element_at(F.create_map(*[F.lit(x) for pair in TAGS for x in pair]), raw)
    value = F.when(std.isin("track", "disc"), F.concat((F.col("event_id") % 12).cast("string"), F.lit("/12"))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"), std.alias("std"), value.alias("value"))


#: Codecs by name and class, and names of encoders that mean them: fixed values.
CODECS = (("h264", "video"), ("hevc", "video"), ("vp8", "video"), ("vp9", "video"), ("av1", "video"), ("aac", "audio"), ("mp3", "audio"), ("opus", "audio"), ("vorbis", "audio"), ("flac", "audio"), ("pcm_s16le", "audio"), ("ass", "subtitle"))
ALIASES = (("libx264", "h264"), ("libx265", "hevc"), ("libvpx", "vp8"), ("libvpx-vp9", "vp9"), ("libopus", "opus"), ("libvorbis", "vorbis"), ("librav1e", "av1"), ("libmp3lame", "mp3"))


@query(f"""WITH c AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in CODECS)}) t(codec, media)), a AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(ALIASES))}) t(i, alias, codec))
SELECT p_partkey, alias, a.codec, media FROM part JOIN a ON p_partkey % {len(ALIASES)} = i JOIN c ON a.codec = c.codec""")
def codec_names(spark, sf_dir):
    """The codec that an encoder's name means, and its class."""
    c = literal(spark, CODECS, "codec string, media string")
    a = literal(spark, [(i, *x) for i, x in enumerate(ALIASES)], "i long, alias string, codec string").join(c, "codec")
    df = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(ALIASES)).alias("i"))
    return df.join(F.broadcast(a), "i").select("p_partkey", "alias", "codec", "media")


#: An eight-tap filter of the other codec, at half a sample.
TAPS = (-1, 6, -19, 78, 78, -19, 6, -1)
_TAP = " + ".join(f"{t} * a[i + {j}]" for j, t in enumerate(TAPS))


@query(f"WITH {BLOCKS} SELECT vec_id, array_to_string(list_transform(range(1, 58), lambda i: least(greatest(({_TAP} + 64) >> 7, 0), 255)), ',') AS px FROM blocks")
def fir8_halfpel(spark, sf_dir):
    """Half positions by the eight-tap filter."""
    tap = lambda i: k.clip(F.shiftright(sum((t * F.element_at("a", i + j) for j, t in enumerate(TAPS)), F.lit(0)) + 64, 7))
    return blocks(spark, sf_dir).select("vec_id", k.listed(F.transform(F.sequence(F.lit(1), F.lit(57)), tap)).alias("px"))


@query(f"""WITH {BLOCKS} SELECT vec_id, array_to_string(list_transform(range(0, 16), lambda i: least(greatest(a[i // 4 + 9] + a[i % 4 + 1] - a[33], 0), 255)), ',') AS tm, array_to_string(list_transform(range(1, 7), lambda i: (a[i] + 2 * a[i + 1] + a[i + 2] + 2) >> 2), ',') AS smooth FROM blocks""")
def true_motion(spark, sf_dir):
    """Prediction from the gradient of both edges, and an edge smoothed by three taps."""
    a = [F.col("a")[i] for i in range(33)]
    tm = F.array(*[k.clip(a[8 + i // 4] + a[i % 4] - a[32]) for i in range(16)])
    smooth = F.array(*[F.shiftright(a[i] + 2 * a[i + 1] + a[i + 2] + 2, 2) for i in range(6)])
    return blocks(spark, sf_dir).select("vec_id", k.listed(tm).alias("tm"), k.listed(smooth).alias("smooth"))


@query(f"""WITH {BLOCKS}, s AS (SELECT vec_id, unnest(range(0, 8)) AS r, a FROM blocks), x AS (SELECT vec_id, r, a[r * 8 + 1] AS p3, a[r * 8 + 2] AS p2, a[r * 8 + 3] AS p1, a[r * 8 + 4] AS p0, a[r * 8 + 5] AS q0, a[r * 8 + 6] AS q1, a[r * 8 + 7] AS q2, a[r * 8 + 8] AS q3 FROM s)
SELECT vec_id, r, greatest(abs(p1 - p0), abs(q1 - q0), abs(p2 - p0), abs(q2 - q0), abs(p3 - p0), abs(q3 - q0)) <= 60 AS flat, greatest(abs(p3 - p2), abs(p2 - p1), abs(p1 - p0), abs(q1 - q0), abs(q2 - q1), abs(q3 - q2)) <= 120 AND 2 * abs(p0 - q0) + (abs(p1 - q1) >> 1) <= 300 AS mask, (p3 + p3 + p3 + 2 * p2 + p1 + p0 + q0 + 4) >> 3 AS wide_p2 FROM x""")
def flatness_gate(spark, sf_dir):
    """Where the other codec's edge filter acts, and where it takes its wide form."""
    df = blocks(spark, sf_dir).select("vec_id", F.posexplode(k.rows("a", 8)).alias("r", "x")).select("vec_id", F.col("r").cast("long").alias("r"), *[F.col("x")[i].alias(n) for i, n in enumerate(("p3", "p2", "p1", "p0", "q0", "q1", "q2", "q3"))])
    p3, p2, p1, p0, q0, q1, q2, q3 = (F.col(c) for c in ("p3", "p2", "p1", "p0", "q0", "q1", "q2", "q3"))
    d = lambda x, y: F.abs(x - y)
    flat = F.greatest(d(p1, p0), d(q1, q0), d(p2, p0), d(q2, q0), d(p3, p0), d(q3, q0)) <= 60
    mask = (F.greatest(d(p3, p2), d(p2, p1), d(p1, p0), d(q1, q0), d(q2, q1), d(q3, q2)) <= 120) & (2 * d(p0, q0) + F.shiftright(d(p1, q1), 1) <= 300)
    return df.select("vec_id", "r", flat.alias("flat"), mask.alias("mask"), F.shiftright(3 * p3 + 2 * p2 + p1 + p0 + q0 + 4, 3).alias("wide_p2"))


@query("""WITH c AS (SELECT o_orderkey // 64 AS seg, list(CASE WHEN o_custkey % 7 = 0 THEN -1 ELSE o_orderkey % 16 END ORDER BY o_orderkey) AS cmds FROM orders GROUP BY 1)
SELECT seg, array_to_string(list_reduce(list_concat([CAST([] AS BIGINT[])], list_transform(cmds, lambda x: [x])), lambda s, x: CASE WHEN x[1] = -1 THEN CAST([] AS BIGINT[]) ELSE list_concat(list_filter(s, lambda v: v <> x[1]), x)[-6:] END), ',') AS held FROM c""")
def marking_commands(spark, sf_dir):
    """Marks of references as a fold over a segment's commands: a reset, or a number that becomes the latest of six."""
    cmd = F.when(F.col("o_custkey") % 7 == 0, F.lit(-1)).otherwise(F.col("o_orderkey") % 16)
    c = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 64).alias("seg")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", cmd.alias("c")))).alias("s"))
    empty = F.array().cast("array<bigint>")

    def step(s, x):
        more = F.concat(F.filter(s, lambda v: v != x), F.array(x))
        return F.when(x == -1, empty).otherwise(F.slice(more, F.greatest(F.size(more) - 5, F.lit(1)), F.lit(6)))

    return c.select("seg", F.array_join(F.aggregate(F.col("s.c"), empty, step).cast("array<string>"), ",").alias("held"))


@query("""SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'PASS' ELSE 'FAIL' END AS status, doc_id // 4096 AS range_, count(*) AS n, md5(array_to_string(list(doc_id ORDER BY doc_id), ',')) AS names FROM labels GROUP BY 1, 2""")
def passing_list(spark, sf_dir):
    """Each status with digests of its sorted names, one for each range of 4,096: no task holds a status."""
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "PASS").otherwise("FAIL")
    g = table(spark, sf_dir, "labels").groupBy(status.alias("status"), F.floor(F.col("doc_id") / 4096).alias("range_")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return g.select("status", "range_", "n", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("names"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') IS NULL AS absent FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 50""")
def manifest_vectors(spark, sf_dir):
    """Rows of a manifest in JSON that a field selects."""
    df = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int, missing string").alias("p"))
    return df.where("p.k > 50").select("event_id", "p.k", F.col("p.missing").isNull().alias("absent"))


@query("SELECT p_partkey, CAST(CASE WHEN v > 254 THEN 254 WHEN d % 2 = 0 THEN least(v + d // 2, 254) ELSE greatest(v - (d + 1) // 2, 1) END AS BIGINT) AS prob FROM (SELECT p_partkey, p_partkey % 254 + 1 AS v, CAST(p_size AS BIGINT) AS d FROM part)")
def prob_delta(spark, sf_dir):
    """Probabilities moved by coded differences around their place, within their bounds."""
    v, d = F.col("p_partkey") % 254 + 1, F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(v > 254, 254).when(d % 2 == 0, F.least(v + F.floor(d / 2), F.lit(254))).otherwise(F.greatest(v - F.floor((d + 1) / 2), F.lit(1))).cast("long").alias("prob"))


@query(f"""WITH {BLOCKS} SELECT vec_id, a[1:32] = a[33:64] AS same, len(list_distinct(a)) AS distinct_, CAST(list_sum(list_distinct(a)) AS BIGINT) AS total FROM blocks""")
def list_equality(spark, sf_dir):
    """Whether two lists are the same, and the different values of both."""
    d = F.array_distinct("a")
    return blocks(spark, sf_dir).select("vec_id", (F.slice("a", 1, 32) == F.slice("a", 33, 32)).alias("same"), F.size(d).cast("long").alias("distinct_"), F.aggregate(d, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS inside FROM lineitem")
def chunk_offsets(spark, sf_dir):
    """Places of samples within their chunks."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    before = Window.partitionBy("l_orderkey").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # a chunk is small
    df = table(spark, sf_dir, "lineitem").withColumn("inside", F.coalesce(F.sum(F.col("l_quantity").cast("long")).over(before), F.lit(0)))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "inside")
