"""Matching: as-of lookups, seeks, parameter sets, comparison, neighbours, the sample index."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators.matching import as_of, ordinal_compare
from ..operators.scan import last_known, row_number, running_sum
from ..tables import BLOCKS, PACKETS, blocks, packets, table

_LINE = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate"


@query("""WITH runs AS (SELECT o_orderkey AS first_chunk, 1 + o_orderkey % 4 AS per_chunk FROM orders WHERE o_orderkey % 5 = 0),
c AS (SELECT DISTINCT l_orderkey AS chunk FROM lineitem)
SELECT chunk, first_chunk, per_chunk FROM c ASOF LEFT JOIN runs ON c.chunk >= runs.first_chunk""")
def asof_chunk_run(spark, sf_dir):
    """Each chunk takes the last run that begins no later."""
    runs = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("chunk"), F.struct(F.col("o_orderkey").alias("first_chunk"), (1 + F.col("o_orderkey") % 4).alias("per_chunk")).alias("v"))
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk")).distinct()
    found = as_of(chunks, runs, [], "chunk", F.col("v"), "run")
    return found.select("chunk", "run.first_chunk", "run.per_chunk")


@query(f"""WITH {PACKETS}, k AS (SELECT stream_index, pts, seq AS key_seq FROM packets WHERE size % 5 = 0), t AS (SELECT seq, stream_index, pts FROM packets)
SELECT t.seq, k.key_seq, t.pts - k.pts AS behind FROM t ASOF LEFT JOIN k ON t.stream_index = k.stream_index AND t.pts >= k.pts""")
def asof_keyframe_seek(spark, sf_dir):
    """A seek to each packet of each stream lands on the last key packet at or before its target; without one it has none."""
    df = packets(spark, sf_dir)
    keys = df.where("size % 5 = 0").select("stream_index", "pts", F.struct(F.col("seq").alias("key_seq"), F.col("pts").alias("key_pts")).alias("v"))
    targets = df.select("stream_index", "pts", "seq")
    found = as_of(targets, keys, ["stream_index"], "pts", F.col("v"), "key", ties=("seq",))
    return found.select("seq", "key.key_seq", (F.col("pts") - F.col("key.key_pts")).alias("behind"))


@query(f"WITH {PACKETS} SELECT stream_index::INTEGER AS stream_index, min(pts) AS pts, min_by(seq, pts) AS seq FROM packets WHERE pts >= (SELECT (min(pts) + max(pts)) // 2 FROM packets) GROUP BY stream_index")
def accurate_seek(spark, sf_dir):
    """The first packet of each stream at or after the middle of the log."""
    df = packets(spark, sf_dir)
    middle = df.agg(F.floor((F.min("pts") + F.max("pts")) / 2)).scalar()
    after = df.where(F.col("pts") >= middle)
    return after.groupBy("stream_index").agg(F.min("pts").alias("pts"), F.min_by("seq", "pts").alias("seq"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, c_custkey AS sps, o_orderkey AS pps, c_mktsegment AS profile FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def parameter_set_join(spark, sf_dir):
    """Slices with their picture's and their sequence's parameters; slices without go."""
    pps = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    found = table(spark, sf_dir, "lineitem").join(pps, F.col("l_orderkey") == F.col("o_orderkey"))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", F.col("c_custkey").alias("sps"), F.col("o_orderkey").alias("pps"), F.col("c_mktsegment").alias("profile"))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, CAST(round(length(text) / 100) AS BIGINT) AS v FROM documents), b AS (SELECT row_number() OVER (ORDER BY page_id) AS n, CAST(round(length(html) / 100) AS BIGINT) AS v FROM pages)
SELECT coalesce(a.n, b.n) AS n, a.v AS left_value, b.v AS right_value, a.n IS NOT NULL AND b.n IS NOT NULL AND a.v IS NOT DISTINCT FROM b.v AS same FROM a FULL JOIN b ON a.n = b.n""")
def ordinal_compare_listing(spark, sf_dir):
    """Row by row comparison of two listings; missing rows differ."""
    listing = lambda name, key, text: table(spark, sf_dir, name).select(F.col(key).alias("k"), F.round(F.length(text) / 100).cast("long").alias("v"))
    number = lambda df: row_number(df, [], ["k"], "n").select("n", "v")
    return ordinal_compare(number(listing("documents", "doc_id", "text")), number(listing("pages", "page_id", "html")), "n", "v")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def snapshot_semi(spark, sf_dir):
    """Only what passed before."""
    passed = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(passed, "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def snapshot_anti(spark, sf_dir):
    """What was never tried."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT quality, count(*) AS now, CAST(count_if(toxic = 1) AS BIGINT) AS regressions FROM labels GROUP BY quality")
def snapshot_gate(spark, sf_dir):
    """Regressions against a snapshot, by state."""
    return table(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("now"), F.count_if(F.col("toxic") == 1).alias("regressions"))


@query(f"""WITH {BLOCKS}, g AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(a) AS v FROM blocks), n AS (SELECT vec_id, i, v, CASE WHEN i % 8 > 0 THEN lag(v) OVER w END AS l, lag(v, 8) OVER w AS t, CASE WHEN i % 8 < 7 THEN lag(v, 7) OVER w END AS tr, CASE WHEN i % 8 > 0 THEN lag(v, 9) OVER w END AS tl FROM g WINDOW w AS (PARTITION BY vec_id ORDER BY i))
SELECT vec_id, i, v, l, t, CASE WHEN i < 8 THEN NULL ELSE coalesce(tr, tl) END AS c FROM n""")
def neighbour_grid(spark, sf_dir):
    """Left, top and top-right neighbours of the cells of an 8 by 8 grid; top-left stands in for a missing top-right. The grid is one row, so no join or window is needed."""
    at = lambda i: F.get("a", i)
    df = blocks(spark, sf_dir).select("vec_id", "a", F.posexplode("a").alias("i", "v"))
    i, x = F.col("i"), F.col("i") % 8
    top = i >= 8
    right = F.when(top & (x < 7), at(i - 7))
    return df.select("vec_id", i.cast("long").alias("i"), "v", F.when(x > 0, at(i - 1)).alias("l"), F.when(top, at(i - 8)).alias("t"), F.when(top, F.coalesce(right, F.when(x > 0, at(i - 9)))).alias("c"))


@query(f"""WITH l AS (SELECT *, row_number() OVER w AS n, CAST(l_quantity AS BIGINT) AS size, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_LINE})),
o AS (SELECT o_orderkey, o_orderkey * 100000 AS chunk_offset, 1 + o_orderkey % 4 AS delta FROM orders),
r AS (SELECT first_chunk, descr FROM (SELECT o_orderkey AS first_chunk, o_orderkey % 3 AS descr FROM orders WHERE o_orderkey % 7 = 0)),
j AS (SELECT l_orderkey, n, chunk_offset + inside AS offset_, size, delta, coalesce(sum(delta) OVER (ORDER BY l_orderkey, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dts, CASE WHEN l_orderkey % 2 = 0 THEN n % 3 ELSE 0 END AS cts, n = 1 OR (l_orderkey + n) % 4 = 0 AS is_key FROM l JOIN o ON l_orderkey = o_orderkey)
SELECT l_orderkey AS chunk, n, CAST(offset_ AS BIGINT) AS offset_, size, CAST(dts AS BIGINT) AS dts, CAST(dts + cts AS BIGINT) AS pts, delta AS duration, is_key, descr FROM j ASOF LEFT JOIN r ON j.l_orderkey >= r.first_chunk""")
def sample_index(spark, sf_dir):
    """One row per sample from the side tables of a container: offsets, times, key flags and the description of its chunk's run."""
    w = Window.partitionBy("l_orderkey").orderBy(*[c.strip() for c in _LINE.split(",")])  # a chunk is small
    size = F.col("l_quantity").cast("long")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).cast("long").alias("n"), size.alias("size"), F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inside"))
    orders = table(spark, sf_dir, "orders")
    chunks = orders.select("o_orderkey", (F.col("o_orderkey") * 100_000).alias("chunk_offset"), (1 + F.col("o_orderkey") % 4).alias("delta"))
    df = lines.join(chunks, F.col("l_orderkey") == F.col("o_orderkey"))
    runs = orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("chunk"), (F.col("o_orderkey") % 3).alias("v"))
    # runs are rows that come before their chunk's samples and take no time: both scans share one table
    both = df.withColumnRenamed("l_orderkey", "chunk").unionByName(runs, allowMissingColumns=True)
    df = running_sum(both, [], ["chunk", "n"], F.col("delta"), "dts")
    df = last_known(df, [], ["chunk", "n"], F.col("v"), "descr").where("n is not null")
    cts = F.when(F.col("chunk") % 2 == 0, F.col("n") % 3).otherwise(0)
    return df.select("chunk", "n", (F.col("chunk_offset") + F.col("inside")).alias("offset_"), "size", "dts", (F.col("dts") + cts).alias("pts"), F.col("delta").alias("duration"), ((F.col("n") == 1) | ((F.col("chunk") + F.col("n")) % 4 == 0)).alias("is_key"), "descr")


@query("""SELECT a.o_orderkey, b.o_orderkey AS colocated, CAST(round(b.o_totalprice * 100) AS BIGINT) AS motion FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey + 1""")
def colocated_join(spark, sf_dir):
    """Pictures with the motion that the picture before them stored."""
    orders = table(spark, sf_dir, "orders")
    b = orders.select(F.col("o_orderkey").alias("colocated"), (F.col("o_orderkey") + 1).alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("motion"))
    return orders.join(b, F.col("o_orderkey") == F.col("k")).select("o_orderkey", "colocated", "motion")
