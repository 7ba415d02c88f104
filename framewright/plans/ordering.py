"""Order: interleaving, reordering, reference lists, gaps, unwrapping, chunks, clocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import timebase as tb
from ..operators.matching import as_of
from ..operators.scan import last_known, neighbour, row_number, running_sum
from ..tables import PACKETS, packets, table

#: Orders as pictures: decode order is the key, display order (poc) is the key moved within a group of eight, and every 64th begins anew.
_PICS = "pics AS (SELECT o_orderkey AS seq, o_orderkey // 64 AS seg, o_orderkey * 2 + (o_orderkey * 5 % 8) * 4 AS poc, o_orderkey % 16 AS frame_num, o_orderkey % 4 <> 3 AS is_ref, o_custkey FROM orders)"


def _pics(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("seq"), F.floor(k / 64).alias("seg"), (k * 2 + (k * 5 % 8) * 4).alias("poc"), (k % 16).alias("frame_num"), (k % 4 != 3).alias("is_ref"), "o_custkey")


@query(f"""WITH {PACKETS}, d AS (SELECT seq, stream_index, pts, CASE WHEN stream_index % 2 = 0 THEN CAST(CAST(pts // 90 AS HUGEINT) * 1000000 // 11111 AS BIGINT) ELSE pts END AS dts_us FROM packets)
SELECT seq, stream_index::INTEGER AS stream_index, CAST(dts_us AS BIGINT) AS dts_us, row_number() OVER (ORDER BY dts_us, stream_index, seq) AS n FROM d""")
def dts_interleave(spark, sf_dir):
    """Packets of all streams merged by time in µs; of equals the lower stream first."""
    pts = F.col("pts")
    us = F.when(F.col("stream_index") % 2 == 0, tb.rescale(F.expr("pts div 90"), F.lit(1_000_000), F.lit(11_111), "zero")).otherwise(pts)
    df = packets(spark, sf_dir).select("seq", "stream_index", us.alias("dts_us"))
    return row_number(df, [], ["dts_us", "stream_index", "seq"], "n").select("seq", "stream_index", "dts_us", "n")


@query(f"WITH {_PICS} SELECT seq, seg, poc, row_number() OVER (PARTITION BY seg ORDER BY poc, seq) AS n FROM pics")
def reorder_batch(spark, sf_dir):
    """Display order: by picture order within segments that no picture leaves."""
    w = Window.partitionBy("seg").orderBy("poc", "seq")
    return _pics(spark, sf_dir).select("seq", "seg", "poc", F.row_number().over(w).cast("long").alias("n"))


@query(f"""WITH {_PICS}, o AS (SELECT *, (SELECT count(*) FROM pics q WHERE q.seg = p.seg AND q.seq < p.seq AND q.poc > p.poc) AS ahead FROM pics p)
SELECT seq, ahead, CAST(max(ahead) OVER (PARTITION BY seg ORDER BY seq) AS BIGINT) AS depth FROM o""")
def reorder_depth(spark, sf_dir):
    """How many pictures came earlier and are shown later, and the depth that this asks for so far. Segments have 64 pictures at most."""
    w = Window.partitionBy("seg").orderBy("seq")
    df = _pics(spark, sf_dir).withColumn("before", F.collect_list("poc").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("ahead", F.size(F.filter("before", lambda p: p > F.col("poc"))).cast("long"))
    return df.select("seq", "ahead", F.max("ahead").over(w).alias("depth"))


@query(f"""WITH {_PICS}, c AS (SELECT a.seq, b.seq AS ref, CASE WHEN b.frame_num > a.frame_num THEN b.frame_num - 16 ELSE b.frame_num END AS pic_num, b.o_custkey % 5 = 0 AS is_long FROM pics a JOIN pics b ON a.seg = b.seg AND b.seq < a.seq AND b.seq >= a.seq - 16 AND b.is_ref),
r AS (SELECT seq, ref, pic_num, is_long, row_number() OVER (PARTITION BY seq ORDER BY is_long, CASE WHEN is_long THEN 0 ELSE -pic_num END, ref) AS n FROM c)
SELECT seq, ref, pic_num, is_long, n FROM r WHERE n <= 4""")
def ref_list_p(spark, sf_dir):
    """References of a forward picture: short-term by wrapped number falling, then long-term rising; four at most are active. A segment's last sixteen pictures are one window, so that no join is needed."""
    w = Window.partitionBy("seg").orderBy("seq").rangeBetween(-16, -1)
    ref = F.when(F.col("is_ref"), F.struct(F.col("seq").alias("ref"), F.col("frame_num").alias("num"), (F.col("o_custkey") % 5 == 0).alias("is_long")))
    df = _pics(spark, sf_dir).withColumn("refs", F.collect_list(ref).over(w))
    number = lambda x: F.when(x["num"] > F.col("frame_num"), x["num"] - 16).otherwise(x["num"])
    keyed = F.transform("refs", lambda x: F.struct(x["is_long"].alias("is_long"), F.when(x["is_long"], F.lit(0).cast("long")).otherwise(-number(x)).alias("o"), x["ref"].alias("ref"), number(x).alias("pic_num")))
    df = df.select("seq", F.posexplode(F.slice(F.array_sort(keyed), 1, 4)).alias("n", "x"))
    return df.select("seq", "x.ref", "x.pic_num", "x.is_long", (F.col("n") + 1).cast("long").alias("n"))


@query(f"""WITH {_PICS}, c AS (SELECT a.seq, a.poc, b.seq AS ref, b.poc AS rpoc FROM pics a JOIN pics b ON a.seg = b.seg AND b.seq < a.seq AND b.seq >= a.seq - 16 AND b.is_ref),
l AS (SELECT seq, list(ref ORDER BY CASE WHEN rpoc <= poc THEN 0 ELSE 1 END, CASE WHEN rpoc <= poc THEN -rpoc ELSE rpoc END, ref) AS l0, list(ref ORDER BY CASE WHEN rpoc > poc THEN 0 ELSE 1 END, CASE WHEN rpoc > poc THEN rpoc ELSE -rpoc END, ref) AS l1 FROM c GROUP BY seq)
SELECT seq, array_to_string(l0, ',') AS l0, array_to_string(CASE WHEN len(l1) > 1 AND l0 = l1 THEN list_concat([l1[2], l1[1]], l1[3:]) ELSE l1 END, ',') AS l1 FROM l""")
def ref_list_b(spark, sf_dir):
    """Both lists of a two-way picture: past by order falling, then future rising, and the other way round; equal lists swap their first two."""
    cur = _pics(spark, sf_dir).select("seq", "seg", "poc")
    ref = _pics(spark, sf_dir).where("is_ref").select(F.col("seq").alias("ref"), F.col("seg").alias("rseg"), F.col("poc").alias("rpoc"))
    both = cur.join(ref, (F.col("seg") == F.col("rseg")) & (F.col("ref") < F.col("seq")) & (F.col("ref") >= F.col("seq") - 16))
    past = F.col("rpoc") <= F.col("poc")
    key = lambda first, mark: F.struct(F.when(first, 0).otherwise(1).alias("h"), mark.alias("o"), F.col("ref"))
    lists = both.groupBy("seq").agg(F.array_sort(F.collect_list(key(past, F.when(past, -F.col("rpoc")).otherwise(F.col("rpoc"))))).alias("a"), F.array_sort(F.collect_list(key(~past, F.when(past, -F.col("rpoc")).otherwise(F.col("rpoc"))))).alias("b"))
    lists = lists.select("seq", F.col("a.ref").alias("l0"), F.col("b.ref").alias("l1"))
    swapped = F.concat(F.array(F.get("l1", F.lit(1)), F.get("l1", F.lit(0))), F.slice(F.col("l1"), F.lit(3), F.size("l1")))
    l1 = F.when((F.size("l1") > 1) & (F.col("l0") == F.col("l1")), swapped).otherwise(F.col("l1"))
    return lists.select("seq", F.array_join("l0", ",").alias("l0"), F.array_join(l1, ",").alias("l1"))


@query("""WITH d AS (SELECT o_orderkey, list_transform(range(0, 6), lambda i: (o_orderkey * 7 + i * 5) % 6) AS l, o_custkey % 6 AS v, o_orderkey % 3 AS p0 FROM orders),
p AS (SELECT *, list_position(l[p0 + 1:], v) AS hit FROM d)
SELECT o_orderkey, array_to_string(CASE WHEN hit IS NULL OR hit = 0 THEN list_concat(list_append(l[1:p0], v), l[p0 + 1:5]) ELSE list_concat(list_append(l[1:p0], v), list_concat(l[p0 + 1:p0 + hit - 1], l[p0 + hit + 1:])) END, ',') AS list_ FROM p""")
def list_modify(spark, sf_dir):
    """An entry moves to a place in its list; what it displaces moves up to where it was, or to the end."""
    six = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (F.col("o_orderkey") * 7 + i * 5) % 6)
    df = table(spark, sf_dir, "orders").select("o_orderkey", six.alias("l"), (F.col("o_custkey") % 6).alias("v"), (F.col("o_orderkey") % 3).cast("int").alias("at"))
    head, tail = F.slice("l", F.lit(1), F.col("at")), F.slice("l", F.col("at") + 1, F.lit(6))
    df = df.withColumn("head", head).withColumn("tail", tail).withColumn("hit", F.array_position("tail", F.col("v")).cast("int"))
    rest = F.when(F.col("hit") == 0, F.slice("tail", F.lit(1), F.size("tail") - 1)).otherwise(F.concat(F.slice("tail", F.lit(1), F.greatest(F.col("hit") - 1, F.lit(0))), F.slice("tail", F.col("hit") + 1, F.lit(6))))
    return df.select("o_orderkey", F.array_join(F.concat("head", F.array("v"), rest), ",").alias("list_"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS first_mb FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT l_orderkey, l_linenumber, first_mb, lead(first_mb, 1, 100000000) OVER (PARTITION BY l_orderkey ORDER BY first_mb, l_linenumber) AS end_mb FROM s""")
def slice_lead(spark, sf_dir):
    """Slices of a picture in order, each with where the next begins."""
    w = Window.partitionBy("l_orderkey").orderBy("first_mb", "l_linenumber")
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("first_mb"))
    return s.withColumn("end_mb", F.lead("first_mb", 1, 100_000_000).over(w))


@query(f"WITH {PACKETS}, n AS (SELECT seq, stream_index, row_number() OVER (PARTITION BY stream_index ORDER BY pts) AS n FROM packets) SELECT seq, stream_index::INTEGER AS stream_index, n FROM n WHERE n <= 25")
def frame_limit(spark, sf_dir):
    """The first 25 packets of each stream. The rank is cut before the shuffle too, so no stream meets in one task."""
    w = Window.partitionBy("stream_index").orderBy("pts")
    return packets(spark, sf_dir).select("seq", "stream_index", "pts").withColumn("n", F.row_number().over(w).cast("long")).where("n <= 25").select("seq", "stream_index", "n")


@query(f"""WITH {PACKETS}, g AS (SELECT seq, stream_index, pts, (lead(pts) OVER (PARTITION BY stream_index ORDER BY pts) - pts) / 1000000.0::DOUBLE AS gap FROM packets),
v AS (SELECT *, CASE WHEN gap > 0 AND gap < 10000 THEN gap END AS ok FROM g)
SELECT seq, round(last_value(ok IGNORE NULLS) OVER (PARTITION BY stream_index ORDER BY pts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3) AS duration FROM v""")
def pts_gap(spark, sf_dir):
    """Durations from the next packet's time; a gap out of range takes the duration before."""
    df = neighbour(packets(spark, sf_dir).select("seq", "stream_index", "pts"), ["stream_index"], ["pts"], F.col("pts"), "next")
    gap = (F.col("next") - F.col("pts")) / 1_000_000
    df = df.withColumn("ok", F.when((gap > 0) & (gap < 10_000), gap))
    return last_known(df, ["stream_index"], ["pts"], F.col("ok"), "d").select("seq", F.round("d", 3).alias("duration"))


@query("""WITH c AS (SELECT o_orderkey AS seq, o_orderkey * 3 % 256 AS counter FROM orders), w AS (SELECT seq, counter, CASE WHEN counter < lag(counter) OVER (ORDER BY seq) THEN 1 ELSE 0 END AS wrap FROM c)
SELECT seq, counter, CAST(counter + 256 * sum(wrap) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS unwrapped FROM w""")
def counter_unwrap(spark, sf_dir):
    """A counter modulo 256 as one that only grows."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") * 3 % 256).alias("counter"))
    df = neighbour(df, [], ["seq"], F.col("counter"), "before", step=-1)
    df = running_sum(df, [], ["seq"], F.when(F.col("counter") < F.col("before"), 1).otherwise(0).cast("long"), "wraps", inclusive=True)
    return df.select("seq", "counter", (F.col("counter") + 256 * F.col("wraps")).alias("unwrapped"))


@query("""WITH p AS (SELECT o_orderkey AS seq FROM orders WHERE o_orderkey % 5 <> 2 AND o_orderkey % 5 <> 3), n AS (SELECT seq, lag(seq) OVER (ORDER BY seq) AS prev FROM p)
SELECT seq AS n, seq, false AS filled, seq * 2 AS poc FROM n UNION ALL SELECT m AS n, prev AS seq, true AS filled, prev * 2 + 2 * (m - prev) AS poc FROM (SELECT prev, unnest(range(prev + 1, seq)) AS m FROM n WHERE seq - prev > 1)""")
def gap_fill(spark, sf_dir):
    """Placeholders for missing counters, made from the last picture before them."""
    p = table(spark, sf_dir, "orders").where("o_orderkey % 5 not in (2, 3)").select(F.col("o_orderkey").alias("seq"))
    p = neighbour(p, [], ["seq"], F.col("seq"), "prev", step=-1)
    there = p.select(F.col("seq").alias("n"), "seq", F.lit(False).alias("filled"), (F.col("seq") * 2).alias("poc"))
    gaps = p.where("seq - prev > 1").select("prev", F.explode(F.sequence(F.col("prev") + 1, F.col("seq") - 1)).alias("m"))
    return there.unionByName(gaps.select(F.col("m").alias("n"), F.col("prev").alias("seq"), F.lit(True).alias("filled"), (F.col("prev") * 2 + 2 * (F.col("m") - F.col("prev"))).alias("poc")))


@query("SELECT o_orderkey, i, CAST(year(o_orderdate) AS INTEGER) AS value FROM (SELECT o_orderkey, o_orderdate, unnest(range(1, 2 + o_orderkey % 4)) AS i FROM orders)")
def rle_expand(spark, sf_dir):
    """Run lengths as rows."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k, F.explode(F.sequence(F.lit(1).cast("long"), 1 + k % 4)).alias("i"), F.year("o_orderdate").alias("value"))


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) AS is_sync FROM orders")
def sync_flags(spark, sf_dir):
    """Samples that a list names; an empty list names all."""
    named = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("k")).distinct()
    some = named.limit(1).agg(F.count("*")).scalar()
    df = table(spark, sf_dir, "orders").select("o_orderkey").join(named, F.col("o_orderkey") == F.col("k"), "left")
    return df.select("o_orderkey", (F.col("k").isNotNull() | (some == 0)).alias("is_sync"))


@query(f"""WITH {PACKETS}, n AS (SELECT stream_index, size, row_number() OVER (PARTITION BY stream_index ORDER BY pts) - 1 AS i FROM packets)
SELECT stream_index::INTEGER AS stream_index, i // 64 AS block, count(*) AS n, CAST(sum(size) AS BIGINT) AS total, CAST(64 - count(*) AS BIGINT) AS padding, md5(array_to_string(list(size ORDER BY i), ',')) AS digest FROM n GROUP BY stream_index, i // 64""")
def chunk_fixed(spark, sf_dir):
    """Blocks of 64 packets of each stream; the last one is padded."""
    df = row_number(packets(spark, sf_dir), ["stream_index"], ["pts"], "n").withColumn("i", F.col("n") - 1)
    g = df.groupBy("stream_index", F.floor(F.col("i") / 64).alias("block")).agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.array_sort(F.collect_list(F.struct("i", "size"))).alias("s"))
    return g.select("stream_index", "block", "n", "total", (64 - F.col("n")).alias("padding"), F.md5(F.array_join(F.col("s.size").cast("array<string>"), ",")).alias("digest"))


@query(f"WITH {PACKETS} SELECT seq, CAST(coalesce(sum(size) OVER (PARTITION BY stream_index ORDER BY pts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dts FROM packets")
def cumulative_dts(spark, sf_dir):
    """Decode times from durations."""
    return running_sum(packets(spark, sf_dir), ["stream_index"], ["pts"], F.col("size"), "dts").select("seq", "dts")


@query("SELECT p_partkey, array_to_string(list_transform(range(0, 8), lambda i: CASE WHEN (p_size * 5 >> CAST(i AS INTEGER)) & 1 = 1 THEN p_partkey ELSE i END), ',') AS slots FROM part")
def slot_refresh(spark, sf_dir):
    """A new picture in every slot whose bit is set."""
    slots = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(F.getbit(F.col("p_size") * 5, i) == 1, F.col("p_partkey")).otherwise(i.cast("long")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(slots, ",").alias("slots"))


@query("SELECT p_partkey, i, CAST((i * p_size) >> 2 AS BIGINT) AS begin_, CAST(((i + 1) * p_size) >> 2 AS BIGINT) AS end_ FROM (SELECT p_partkey, p_size, unnest(range(0, 4)) AS i FROM part)")
def tile_offsets(spark, sf_dir):
    """Where the four tiles of a row begin and end."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("i"))
    return df.select("p_partkey", "i", F.shiftright(F.col("i") * F.col("p_size"), 2).alias("begin_"), F.shiftright((F.col("i") + 1) * F.col("p_size"), 2).alias("end_"))


@query(f"""WITH {_PICS}, r AS (SELECT seg, seq, row_number() OVER (PARTITION BY seg ORDER BY seq) AS n FROM pics WHERE is_ref)
SELECT p.seq, CAST(count(*) AS BIGINT) AS held, min(r.seq) AS oldest FROM pics p JOIN r ON r.seg = p.seg AND r.seq <= p.seq AND r.n > (SELECT coalesce(max(n), 0) FROM r q WHERE q.seg = p.seg AND q.seq <= p.seq) - 4 GROUP BY p.seq""")
def sliding_window_evict(spark, sf_dir):
    """References held after each picture: the latest four of its segment."""
    refs = F.collect_list(F.when(F.col("is_ref"), F.col("seq"))).over(Window.partitionBy("seg").orderBy("seq"))  # a segment has 64 pictures at most
    df = _pics(spark, sf_dir).withColumn("refs", refs).where(F.size("refs") > 0)
    last = F.slice("refs", -F.least(F.size("refs"), F.lit(4)), F.lit(4))
    return df.select("seq", F.size(last).cast("long").alias("held"), F.get(last, F.lit(0)).alias("oldest"))


@query(f"""WITH {PACKETS}, a AS (SELECT pts, size FROM packets WHERE kind = 'view'), v AS (SELECT seq, pts FROM packets WHERE kind = 'click')
SELECT v.seq, a.size AS audio_size, round((v.pts - a.pts) / 1000000.0::DOUBLE, 4) AS ahead FROM v ASOF LEFT JOIN a ON v.pts >= a.pts""")
def av_clock_interp(spark, sf_dir):
    """The audio clock at each picture: the last audio packet, and how far time has run since."""
    df = packets(spark, sf_dir)
    audio = df.where("kind = 'view'").select("pts", F.struct("size", "pts").alias("v"))
    found = as_of(df.where("kind = 'click'").select("pts", "seq"), audio, [], "pts", F.col("v"), "a", ties=("seq",))
    return found.select("seq", F.col("a.size").alias("audio_size"), F.round((F.col("pts") - F.col("a.pts")) / 1_000_000, 4).alias("ahead"))


@query("""WITH d AS (SELECT event_id, (event_id % 25) / 100.0::DOUBLE AS delay, (event_id % 400 - 200) / 500.0::DOUBLE AS diff, event_id % 9 = 0 AS mute FROM events), t AS (SELECT *, least(greatest(delay, 0.04), 0.1) AS th FROM d)
SELECT event_id, round(CASE WHEN mute OR abs(diff) >= 10 THEN delay WHEN diff <= -th THEN greatest(0, delay + diff) WHEN diff >= th AND delay > 0.1 THEN delay + diff WHEN diff >= th THEN 2 * delay ELSE delay END, 6) AS wait FROM t""")
def sync_delay(spark, sf_dir):
    """How long a picture waits, so that it follows the audio clock."""
    e = F.col("event_id")
    df = table(spark, sf_dir, "events").select(e, (e % 25 / 100.0).alias("delay"), ((e % 400 - 200) / 500.0).alias("diff"), (e % 9 == 0).alias("mute"))
    delay, diff = F.col("delay"), F.col("diff")
    th = F.least(F.greatest(delay, F.lit(0.04)), F.lit(0.1))
    wait = F.when(F.col("mute") | (F.abs(diff) >= 10), delay).when(diff <= -th, F.greatest(F.lit(0.0), delay + diff)).when((diff >= th) & (delay > 0.1), delay + diff).when(diff >= th, 2 * delay).otherwise(delay)
    return df.select("event_id", F.round(wait, 6).alias("wait"))


@query(f"""WITH {PACKETS}, n AS (SELECT seq, pts, lead(pts) OVER (PARTITION BY stream_index ORDER BY pts) AS next, pts + size * 100000 AS shown FROM packets)
SELECT seq, coalesce(shown > next, false) AS dropped FROM n""")
def late_drop(spark, sf_dir):
    """Pictures that come so late that the next one is due."""
    df = neighbour(packets(spark, sf_dir).select("seq", "stream_index", "pts", "size"), ["stream_index"], ["pts"], F.col("pts"), "next")
    return df.select("seq", F.coalesce(F.col("pts") + F.col("size") * 100_000 > F.col("next"), F.lit(False)).alias("dropped"))


@query(f"""WITH {PACKETS}, p AS (SELECT seq, stream_index, pts, CASE WHEN is_key THEN size * 1000 ELSE 0 END AS pause FROM packets)
SELECT seq, CAST(pts + sum(pause) OVER (PARTITION BY stream_index ORDER BY pts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS shifted FROM (SELECT seq, 0 AS stream_index, pts, pause FROM p)""")
def pause_resume(spark, sf_dir):
    """The timeline moved by all pauses so far."""
    pause = F.when(F.col("is_key"), F.col("size") * 1000).otherwise(0)
    df = running_sum(packets(spark, sf_dir).select("seq", "pts", "is_key", "size"), [], ["pts"], pause, "p", inclusive=True)
    return df.select("seq", (F.col("pts") + F.col("p")).alias("shifted"))
