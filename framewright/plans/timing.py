"""Rational time, rescaling and text forms of time and options."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import timebase as tb
from ..tables import PACKETS, packets, table

#: A line as a pair of fractions: quantity over line number, and order key over quantity.
_PAIR = "l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) * 6 AS an, CAST(l_linenumber AS BIGINT) * 4 - 12 AS ad, l_orderkey % 97 - 48 AS bn, CAST(l_quantity AS BIGINT) % 7 AS bd, l_suppkey, l_extendedprice"
_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _pairs(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(*_KEY, (q * 6).alias("an"), (F.col("l_linenumber").cast("long") * 4 - 12).alias("ad"), (F.col("l_orderkey") % 97 - 48).alias("bn"), (q % 7).alias("bd"))


@query(f"""WITH p AS (SELECT {_PAIR} FROM lineitem)
SELECT {', '.join(_KEY)}, CAST(CASE WHEN (an < 0) <> (ad < 0) THEN -1 ELSE 1 END * (abs(an) // greatest(gcd(an, ad), 1)) AS BIGINT) AS num,
 CAST(abs(ad) // greatest(gcd(an, ad), 1) AS BIGINT) AS den FROM p""")
def rational_reduce(spark, sf_dir):
    """Fractions in lowest terms."""
    r = tb.reduce(F.col("an"), F.col("ad"))
    return _pairs(spark, sf_dir).select(*_KEY, r["num"].alias("num"), r["den"].alias("den"))


@query(f"""WITH p AS (SELECT {_PAIR} FROM lineitem),
s AS (SELECT *, an * bd + bn * ad AS sn, ad * bd AS sd, an * bn AS mn, ad * bd AS md, an * bd AS dn, ad * bn AS dd FROM p)
SELECT {', '.join(_KEY)},
 CAST(CASE WHEN (sn < 0) <> (sd < 0) THEN -1 ELSE 1 END * (abs(sn) // greatest(gcd(sn, sd), 1)) AS BIGINT) AS sum_num, CAST(abs(sd) // greatest(gcd(sn, sd), 1) AS BIGINT) AS sum_den,
 CAST(CASE WHEN (mn < 0) <> (md < 0) THEN -1 ELSE 1 END * (abs(mn) // greatest(gcd(mn, md), 1)) AS BIGINT) AS mul_num, CAST(abs(md) // greatest(gcd(mn, md), 1) AS BIGINT) AS mul_den,
 CAST(CASE WHEN (dn < 0) <> (dd < 0) THEN -1 ELSE 1 END * (abs(dn) // greatest(gcd(dn, dd), 1)) AS BIGINT) AS div_num, CAST(abs(dd) // greatest(gcd(dn, dd), 1) AS BIGINT) AS div_den,
 -an AS neg_num FROM s""")
def rational_arith(spark, sf_dir):
    """Sum, product, quotient and negative of fractions, in lowest terms."""
    an, ad, bn, bd = (F.col(c) for c in ("an", "ad", "bn", "bd"))
    made = {"sum": (an * bd + bn * ad, ad * bd), "mul": (an * bn, ad * bd), "div": (an * bd, ad * bn)}
    df = _pairs(spark, sf_dir).withColumns({k: tb.reduce(*v) for k, v in made.items()})
    return df.select(*_KEY, *[F.col(f"{k}.{part}").alias(f"{k}_{part}") for k in made for part in ("num", "den")], (-an).alias("neg_num"))


@query(f"""WITH p AS (SELECT {_PAIR} FROM lineitem), t AS (SELECT *, an * bd - bn * ad AS t FROM p)
SELECT {', '.join(_KEY)}, CAST(CASE WHEN t <> 0 THEN sign(t) * CASE WHEN (ad < 0) <> (bd < 0) THEN -1 ELSE 1 END WHEN ad <> 0 AND bd <> 0 THEN 0
 WHEN an <> 0 AND bn <> 0 THEN sign(an) - sign(bn) END AS INTEGER) AS cmp FROM t""")
def rational_compare(spark, sf_dir):
    """Order of two fractions by exact cross products."""
    return _pairs(spark, sf_dir).select(*_KEY, tb.compare(*(F.col(c) for c in ("an", "ad", "bn", "bd"))).cast("int").alias("cmp"))


@query(f"SELECT {', '.join(_KEY)}, concat(CAST(CAST(l_quantity AS BIGINT) * 6 AS VARCHAR), '/', CAST(l_linenumber * 4 - 12 AS VARCHAR)) AS ratio, CASE WHEN l_linenumber * 4 - 12 <> 0 THEN round(l_quantity * 6 / (l_linenumber * 4 - 12), 6) END AS ratio_value FROM lineitem")
def rational_format(spark, sf_dir):
    """Fractions as text and as a double."""
    return _pairs(spark, sf_dir).select(*_KEY, F.concat_ws("/", "an", "ad").alias("ratio"), F.when(F.col("ad") != 0, F.round(F.col("an") / F.when(F.col("ad") != 0, F.col("ad")), 6)).alias("ratio_value"))


@query(f"""WITH {PACKETS}, r AS (SELECT seq, pts - 1700000000000000 AS a, CAST(90 + seq % 7 AS HUGEINT) AS b, CAST(1001 + seq % 13 AS HUGEINT) AS c FROM packets)
SELECT seq, CAST(sign(a) * (abs(a) * b // c) AS BIGINT) AS r_zero, CAST(sign(a) * ((abs(a) * b + c - 1) // c) AS BIGINT) AS r_inf,
 CAST(sign(a) * ((abs(a) * b + CASE WHEN a < 0 THEN c - 1 ELSE 0 END) // c) AS BIGINT) AS r_down, CAST(sign(a) * ((abs(a) * b + CASE WHEN a < 0 THEN 0 ELSE c - 1 END) // c) AS BIGINT) AS r_up,
 CAST(sign(a) * ((abs(a) * b + c // 2) // c) AS BIGINT) AS r_near FROM r""")
def rescale_modes(spark, sf_dir):
    """Timestamps in another time base, under all five roundings."""
    df = packets(spark, sf_dir).select("seq", (F.col("pts") - 1_700_000_000_000_000).alias("a"), (90 + F.col("seq") % 7).alias("b"), (1001 + F.col("seq") % 13).alias("c"))
    return df.select("seq", *[tb.rescale(F.col("a"), F.col("b"), F.col("c"), m).alias(f"r_{m}") for m in ("zero", "inf", "down", "up", "near")])


@query(f"WITH {PACKETS} SELECT seq, CASE WHEN seq % 11 - 1 >= 0 THEN round((seq % 11 - 1) * (pts % 1000003) * 1001.0 / 30000, 4) ELSE 0 END AS sec FROM packets")
def pts_to_seconds(spark, sf_dir):
    """Ticks of 1001/30000 seconds as seconds; negative ones are 0."""
    ticks = (F.col("seq") % 11 - 1) * (F.col("pts") % 1_000_003)
    return packets(spark, sf_dir).select("seq", F.round(tb.seconds(ticks, F.lit(1001), F.lit(30000)), 4).alias("sec"))


@query(f"""WITH {PACKETS}, d AS (SELECT seq, (pts - 1700000000000000) % 360000000000 AS us FROM packets), m AS (SELECT seq, abs(us) // 1000 AS ms FROM d)
SELECT seq, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS hms FROM m""")
def duration_clock(spark, sf_dir):
    """Durations as clock text."""
    return packets(spark, sf_dir).select("seq", tb.clock(F.abs((F.col("pts") - 1_700_000_000_000_000) % 360_000_000_000)).alias("hms"))


@query("""WITH t AS (SELECT p_partkey, concat(CAST(p_size AS VARCHAR), CASE p_partkey % 5 WHEN 0 THEN 'k' WHEN 1 THEN 'K' WHEN 2 THEN 'M' WHEN 3 THEN '' ELSE 'x' END) AS txt FROM part)
SELECT p_partkey, txt, CASE WHEN regexp_full_match(txt, '[0-9]+[kK]') THEN CAST(regexp_extract(txt, '[0-9]+') AS BIGINT) * 1000 WHEN regexp_full_match(txt, '[0-9]+M') THEN CAST(regexp_extract(txt, '[0-9]+') AS BIGINT) * 1000000
 WHEN regexp_full_match(txt, '[0-9]+') THEN CAST(txt AS BIGINT) ELSE 0 END AS bps FROM t""")
def bitrate_parse(spark, sf_dir):
    """Rates such as 128k or 2M as numbers; what can't be read is 0."""
    unit = F.element_at(F.array(*map(F.lit, ("k", "K", "M", "", "x"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    df = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("txt"))
    number, mark = F.regexp_extract("txt", "^([0-9]+)([kKM]?)$", 1), F.regexp_extract("txt", "^([0-9]+)([kKM]?)$", 2)
    times = F.when(mark.isin("k", "K"), 1000).when(mark == "M", 1_000_000).otherwise(1)
    return df.select("p_partkey", "txt", F.coalesce(number.try_cast("long") * times, F.lit(0).cast("long")).alias("bps"))


@query("""WITH o AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), t AS (SELECT event_id, k, CASE k % 7 WHEN 0 THEN '1' WHEN 1 THEN 'true' WHEN 2 THEN 'yes' WHEN 3 THEN '0' WHEN 4 THEN 'false' WHEN 5 THEN 'no' ELSE 'maybe' END AS txt FROM o)
SELECT event_id, k, CASE WHEN txt IN ('1', 'true', 'yes') THEN true WHEN txt IN ('0', 'false', 'no') THEN false END AS flag FROM t""")
def option_bool(spark, sf_dir):
    """Options read as numbers and as booleans; others are null."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    df = table(spark, sf_dir, "events").select("event_id", k.alias("k"))
    txt = F.element_at(F.array(*map(F.lit, ("1", "true", "yes", "0", "false", "no", "maybe"))), F.col("k") % 7 + 1)
    return df.select("event_id", "k", F.when(txt.isin("1", "true", "yes"), True).when(txt.isin("0", "false", "no"), False).alias("flag"))


@query(f"SELECT {', '.join(_KEY)}, CAST(list_sort([l_partkey % 50, l_suppkey % 50, CAST(l_quantity AS BIGINT)])[2] AS BIGINT) AS med, CAST(CASE WHEN l_partkey % 50 - 25 >= 0 THEN (l_partkey % 50 - 25 + l_linenumber // 2) // l_linenumber ELSE -((25 - l_partkey % 50 + l_linenumber // 2) // l_linenumber) END AS BIGINT) AS near, CAST(least(greatest(l_partkey % 300 - 20, 0), 255) AS BIGINT) AS clip FROM lineitem")
def median_clamp_round(spark, sf_dir):
    """Middle of three, rounded division and clamping."""
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    med = F.array_sort(F.array(F.col("l_partkey") % 50, F.col("l_suppkey") % 50, q))[1]
    return table(spark, sf_dir, "lineitem").select(*_KEY, med.alias("med"), tb.round_div(F.col("l_partkey") % 50 - 25, n).alias("near"), F.least(F.greatest(F.col("l_partkey") % 300 - 20, F.lit(0)), F.lit(255)).cast("long").alias("clip"))
