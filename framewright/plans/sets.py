"""Sets of rows, and the relational operators that come with Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..tables import PACKETS, packets, table


@query("SELECT src, id, round(v, 4) AS v FROM (SELECT 'order' AS src, o_orderkey AS id, o_totalprice AS v FROM orders UNION ALL SELECT 'part', p_partkey, p_retailprice FROM part UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer)")
def suite_union(spark, sf_dir):
    """Rows of several suites in one."""
    take = lambda name, i, v, src: table(spark, sf_dir, name).select(F.lit(src).alias("src"), F.col(i).alias("id"), F.round(F.col(v), 4).alias("v"))
    return take("orders", "o_orderkey", "o_totalprice", "order").unionByName(take("part", "p_partkey", "p_retailprice", "part")).unionByName(take("customer", "c_custkey", "c_acctbal", "customer"))


@query(f"WITH {PACKETS} SELECT seq, stream_index::INTEGER AS stream_index, pts FROM packets WHERE stream_index = 0 UNION ALL SELECT seq, stream_index::INTEGER, pts FROM packets WHERE stream_index = 4")
def interleave_union(spark, sf_dir):
    """Two streams as one log."""
    df = packets(spark, sf_dir).select("seq", "stream_index", "pts", "kind")
    return df.where("kind = 'click'").unionByName(df.where("kind = 'view'")).drop("kind")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def registry_intersect(spark, sf_dir):
    """Keys that both have."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def registry_except(spark, sf_dir):
    """Keys that only the first has."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, sf_dir, "orders").select("o_custkey").distinct())


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_states(spark, sf_dir):
    """Distinct states of lines."""
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_states(spark, sf_dir):
    """Counts of all combinations of states."""
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_regions(spark, sf_dir):
    """Sums by nation, by region, and in all."""
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    df = table(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey"))
    return df.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '6 hours' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS events FROM s GROUP BY user_id, n""")
def session_windows(spark, sf_dir):
    """Sessions of users: gaps of six hours part them."""
    df = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("events"))
    return df.select("user_id", F.unix_micros("a").alias("start_us"), F.unix_micros("b").alias("last_us"), "events")


@query("SELECT page_id, url, md5(html) AS digest, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages WHERE starts_with(url, 'https')")
def discovery_filter(spark, sf_dir):
    """Files of one scheme, with digest and size."""
    return table(spark, sf_dir, "pages").where(F.col("url").startswith("https")).select("page_id", "url", F.md5("html").alias("digest"), F.octet_length("html").cast("long").alias("size"))
