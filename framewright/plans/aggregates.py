"""Aggregation: signal quality, histograms, run lengths, summaries, comparison of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators.matching import run_lengths
from ..tables import BLOCKS, PACKETS, blocks, packets, table


@query(f"""WITH {BLOCKS}, p AS (SELECT b.label, unnest(b.a) AS r, unnest(list_transform(b.a, lambda x: CAST(round(x / 8.0) * 8 AS BIGINT))) AS t FROM blocks b)
SELECT label, CASE WHEN sum((r - t) * (r - t)) = 0 THEN NULL ELSE round(10 * log10(sum(r * r) / sum((r - t) * (r - t))), 4) END AS snr_db, CAST(max(abs(r - t)) AS BIGINT) AS max_err FROM p GROUP BY label""")
def snr(spark, sf_dir):
    """Signal to noise of quantised samples in dB, and the largest error; null without noise."""
    pair = F.transform("a", lambda x: F.struct(x.alias("r"), (F.round(x / 8.0) * 8).cast("long").alias("t")))
    df = blocks(spark, sf_dir).select("label", F.explode(pair).alias("p")).select("label", "p.r", "p.t")
    noise = F.sum((F.col("r") - F.col("t")) * (F.col("r") - F.col("t")))
    g = df.groupBy("label").agg(F.sum(F.col("r") * F.col("r")).alias("s"), noise.alias("n"), F.max(F.abs(F.col("r") - F.col("t"))).alias("max_err"))
    return g.select("label", F.when(F.col("n") != 0, F.round(10 * F.log10(F.col("s") / F.when(F.col("n") != 0, F.col("n"))), 4)).alias("snr_db"), "max_err")


@query(f"""WITH {BLOCKS}, o AS (SELECT vec_id, a, unnest(range(-8, 9)) AS off FROM blocks), d AS (SELECT vec_id, off, CAST(list_sum(list_transform(range(8, 56), lambda i: a[i + 1] * a[i + off + 1])) AS BIGINT) AS dot FROM o WHERE off <> 0)
SELECT vec_id, off, dot FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dot DESC, off) AS n FROM d) WHERE n = 1""")
def xcorr_argmax(spark, sf_dir):
    """The shift at which a signal is most like itself; of equals the first. All shifts of a row are tried within it."""
    offs = [o for o in range(-8, 9) if o]
    dot = lambda o: F.aggregate(F.zip_with(F.slice("a", 9, 48), F.slice("a", 9 + o, 48), lambda x, y: x * y), F.lit(0).cast("long"), lambda s, v: s + v)
    best = F.array_max(F.array(*[F.struct(dot(o).alias("dot"), F.lit(-o).cast("long").alias("neg")) for o in offs]))
    return blocks(spark, sf_dir).select("vec_id", best.alias("b")).select("vec_id", (-F.col("b.neg")).alias("off"), "b.dot")


@query(f"""WITH {BLOCKS}, p AS (SELECT b.vec_id, unnest(range(0, 64)) AS i, unnest(b.a) AS x, unnest(c.a) AS y FROM blocks b JOIN blocks c ON c.vec_id = b.vec_id + 1)
SELECT vec_id, CASE WHEN i < 32 THEN 'Y' WHEN i < 48 THEN 'U' ELSE 'V' END AS plane, max(abs(x - y)) AS diff, CAST(sum(x) AS BIGINT) AS total FROM p GROUP BY 1, 2""")
def plane_max_diff(spark, sf_dir):
    """The largest difference to the next picture in each plane, and the plane's sum."""
    a = blocks(spark, sf_dir).select("vec_id", "a")
    b = a.select((F.col("vec_id") - 1).alias("k"), F.col("a").alias("b"))
    planes = F.array(*[F.struct(F.lit(n).alias("plane"), F.slice("a", at, size).alias("x"), F.slice("b", at, size).alias("y")) for n, at, size in (("Y", 1, 32), ("U", 33, 16), ("V", 49, 16))])
    df = a.join(b, F.col("vec_id") == F.col("k")).select("vec_id", F.inline(planes))
    return df.select("vec_id", "plane", F.array_max(F.zip_with("x", "y", lambda p, q: F.abs(p - q))).alias("diff"), F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


@query("""WITH e AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events),
r AS (SELECT event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM e GROUP BY event_type, g) SELECT row_number() OVER (ORDER BY first) AS run, event_type, n, first, last FROM r""")
def rle_encode(spark, sf_dir):
    """Runs of equal kinds of events."""
    return run_lengths(table(spark, sf_dir, "events").select("event_id", "event_type"), [], ["event_id"], "event_type")


@query(f"""WITH {PACKETS}, h AS (SELECT *, pts // 3600000000 AS hour, seq // 256 AS part FROM packets) SELECT stream_index::INTEGER AS stream_index, hour, part, count(*) AS samples, CAST(sum(size) AS BIGINT) AS bytes, array_to_string(list(size ORDER BY pts), ',') AS sizes, array_to_string(list(seq ORDER BY pts) FILTER (is_key), ',') AS keys, bool_or(user_id % 10 = 0) AS has_cts FROM h GROUP BY 1, 2, 3""")
def track_accumulate(spark, sf_dir):
    """What a writer keeps for a fragment of each track: counts, sizes, key indices, and whether any has an offset. A fragment is an hour's part of 256 packets of the log, so that no list grows."""
    df = packets(spark, sf_dir).withColumn("hour", F.floor(F.col("pts") / 3_600_000_000)).withColumn("part", F.floor(F.col("seq") / 256))
    lists = lambda c, keep: F.array_sort(F.collect_list(F.when(keep, F.struct("pts", c))))
    g = df.groupBy("stream_index", "hour", "part").agg(F.count("*").alias("samples"), F.sum("size").alias("bytes"), lists("size", F.lit(True)).alias("s"), lists("seq", F.col("is_key")).alias("k"), F.bool_or(F.col("user_id") % 10 == 0).alias("has_cts"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return g.select("stream_index", "hour", "part", "samples", "bytes", text("s.size").alias("sizes"), F.when(F.size("k") > 0, text("k.seq")).alias("keys"), "has_cts")


@query(f"WITH {PACKETS} SELECT user_id % 16 AS symbol, count(*) AS total, CAST(count_if(stream_index = 0) AS BIGINT) AS t0, CAST(count_if(stream_index = 1) AS BIGINT) AS t1, CAST(count_if(stream_index > 1) AS BIGINT) AS rest FROM packets GROUP BY 1")
def histogram_merge(spark, sf_dir):
    """Symbol counts of all tiles as one histogram."""
    s = F.col("stream_index")
    return packets(spark, sf_dir).groupBy((F.col("user_id") % 16).alias("symbol")).agg(F.count("*").alias("total"), F.count_if(s == 0).alias("t0"), F.count_if(s == 1).alias("t1"), F.count_if(s > 1).alias("rest"))


@query(f"""WITH {PACKETS}, c AS (SELECT user_id % 64 AS ctx, CAST(count_if(is_key) AS BIGINT) AS c0, CAST(count_if(NOT is_key) AS BIGINT) AS c1 FROM packets GROUP BY 1), f AS (SELECT *, 128 AS p, 112 * least(c0 + c1, 20) // 20 AS uf, least(greatest((256 * c0 + (c0 + c1) // 2) // (c0 + c1), 1), 255) AS p2 FROM c)
SELECT ctx, c0, c1, CAST(least(greatest(p + (((p2 - p) * uf + 128) >> 8), 1), 255) AS BIGINT) AS prob FROM f""")
def prob_adapt(spark, sf_dir):
    """Probabilities moved towards what was counted, the less the fewer the counts."""
    c = packets(spark, sf_dir).groupBy((F.col("user_id") % 64).alias("ctx")).agg(F.count_if("is_key").alias("c0"), F.count_if(~F.col("is_key")).alias("c1"))
    n = F.col("c0") + F.col("c1")
    uf = F.floor(112 * F.least(n, F.lit(20)) / 20)
    p2 = F.least(F.greatest(F.floor((256 * F.col("c0") + F.floor(n / 2)) / n), F.lit(1)), F.lit(255))
    return c.select("ctx", "c0", "c1", F.least(F.greatest(128 + F.shiftright((p2 - 128) * uf + 128, 8), F.lit(1)), F.lit(255)).cast("long").alias("prob"))


@query("SELECT o_orderkey // 64 AS seg, CAST(count_if(o_orderkey % 4 <> 3) AS BIGINT) AS refs, CAST(count_if(o_orderkey % 4 <> 3 AND o_custkey % 5 = 0) AS BIGINT) AS long_refs, CAST(count_if(o_orderkey % 4 = 3) AS BIGINT) AS waiting, least(greatest(CAST(8160 // (64 + o_orderkey // 64 % 400 * 40) AS BIGINT), 1), 16) AS capacity FROM orders GROUP BY o_orderkey // 64")
def dpb_counts(spark, sf_dir):
    """What each segment's buffer holds, and its capacity by level."""
    k = F.col("o_orderkey")
    g = table(spark, sf_dir, "orders").groupBy(F.floor(k / 64).alias("seg")).agg(F.count_if(k % 4 != 3).alias("refs"), F.count_if((k % 4 != 3) & (F.col("o_custkey") % 5 == 0)).alias("long_refs"), F.count_if(k % 4 == 3).alias("waiting"))
    return g.withColumn("capacity", F.least(F.greatest(F.floor(8160 / (64 + F.col("seg") % 400 * 40)), F.lit(1)), F.lit(16)))


@query("SELECT lang, CASE WHEN quality = 1 THEN 'PASS' WHEN quality = 0 THEN 'FAIL' ELSE 'SKIP' END AS status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY lang), 3) AS pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def passfail_summary(spark, sf_dir):
    """Counts and shares by status."""
    from pyspark.sql import Window

    status = F.when(F.col("quality") == 1, "PASS").when(F.col("quality") == 0, "FAIL").otherwise("SKIP")
    df = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    g = df.groupBy("lang", status.alias("status")).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("lang")), 3))


@query("""WITH a AS (SELECT p_partkey % 40 AS name, avg(p_retailprice) AS old FROM part GROUP BY 1), b AS (SELECT s_suppkey % 40 + 5 AS name, avg(abs(s_acctbal)) AS new FROM supplier GROUP BY 1)
SELECT coalesce(a.name, b.name) AS name, round(new / old, 5) AS ratio, CASE WHEN old IS NULL THEN 'NEW' WHEN new IS NULL THEN 'GONE' WHEN new > old * 1.05 THEN 'SLOWER' WHEN new < old * 0.95 THEN 'FASTER' ELSE 'SAME' END AS band FROM a FULL JOIN b ON a.name = b.name""")
def bench_compare(spark, sf_dir):
    """Two runs side by side: ratio, what is new or gone, and bands of 5 %."""
    a = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 40).alias("name")).agg(F.avg("p_retailprice").alias("old"))
    b = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 40 + 5).alias("name")).agg(F.avg(F.abs("s_acctbal")).alias("new"))
    band = F.when(F.col("old").isNull(), "NEW").when(F.col("new").isNull(), "GONE").when(F.col("new") > F.col("old") * 1.05, "SLOWER").when(F.col("new") < F.col("old") * 0.95, "FASTER").otherwise("SAME")
    return a.join(b, "name", "full_outer").select("name", F.round(F.col("new") / F.col("old"), 5).alias("ratio"), band.alias("band"))


@query(f"""WITH {PACKETS} SELECT stream_index::INTEGER AS stream_index, epoch_us(time_bucket(INTERVAL '2 hours', ts)) AS start_us, count(*) AS frames, CAST(count_if(size % 7 = 0) AS BIGINT) AS dropped FROM packets GROUP BY 1, 2""")
def fps_tumbling(spark, sf_dir):
    """Packets and drops in intervals of two hours."""
    g = packets(spark, sf_dir).groupBy("stream_index", F.window("ts", "2 hours").alias("w")).agg(F.count("*").alias("frames"), F.count_if(F.col("size") % 7 == 0).alias("dropped"))
    return g.select("stream_index", F.unix_micros("w.start").alias("start_us"), "frames", "dropped")


@query("SELECT o_custkey % 64 AS track, CAST(sum(1 + o_orderkey % 4) AS BIGINT) AS samples, CAST(sum((1 + o_orderkey % 4) * (o_orderkey % 9)) AS BIGINT) AS ticks, CAST((sum((1 + o_orderkey % 4) * (o_orderkey % 9)) * 1000 + 45000) // 90000 AS BIGINT) AS movie_ms FROM orders GROUP BY 1")
def total_samples(spark, sf_dir):
    """Samples and duration that run lengths add up to, and the duration in the movie's scale."""
    n = 1 + F.col("o_orderkey") % 4
    g = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 64).alias("track")).agg(F.sum(n).alias("samples"), F.sum(n * (F.col("o_orderkey") % 9)).alias("ticks"))
    return g.withColumn("movie_ms", F.floor((F.col("ticks") * 1000 + 45_000) / 90_000))


