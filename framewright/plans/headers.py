"""Headers of coded pictures: written from the tables as bits, and read field by field as columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import bits as bt
from ..functions import fields
from ..functions.boxes import messages
from ..tables import table


def _bytes(*parts, emulation: bool = True):
    """Bits as bytes: a stop bit, then zeros up to a whole byte, and the bytes that keep start codes out."""
    return bt.packed(F.concat(*parts, F.lit("1")), emulation)


def _u(v, n: int):
    return F.lpad(F.bin(v if not isinstance(v, int) else F.lit(v)), n, "0")


def _se(v):
    return bt.ue_code(F.when(v > 0, 2 * v - 1).otherwise(-2 * v))


@query("""SELECT p_partkey, 66 AS profile, 10 + p_size AS level, CAST(p_partkey % 4 AS INTEGER) AS sps_id, 1 AS chroma, 16 * (1 + p_size) - 2 * CAST(p_partkey % 3 AS INTEGER) AS width, 16 * CAST(1 + p_partkey % 30 AS INTEGER) AS height, CASE WHEN p_partkey % 2 = 0 THEN 30000 ELSE NULL END AS rate_num, CASE WHEN p_partkey % 2 = 0 THEN 2 * 1001 ELSE NULL END AS rate_den FROM part""")
def sequence_header(spark, sf_dir):
    """Sequence headers: profile, size after cropping, and frame rate."""
    k, crop = F.col("p_partkey"), F.col("p_partkey") % 3
    data = _bytes(
        _u(66, 8), _u(0, 8), _u(10 + F.col("p_size"), 8), bt.ue_code(k % 4), bt.ue_code(F.lit(0)), bt.ue_code(F.lit(2)), bt.ue_code(F.lit(4)), F.lit("0"), bt.ue_code(F.col("p_size").cast("long")), bt.ue_code(k % 30), F.lit("11"),
        F.when(crop > 0, F.concat(F.lit("1"), bt.ue_code(F.lit(0)), bt.ue_code(crop), bt.ue_code(F.lit(0)), bt.ue_code(F.lit(0)))).otherwise("0"),
        F.when(k % 2 == 0, F.concat(F.lit("1"), F.lit("0000"), F.lit("1"), _u(1001, 32), _u(30000, 32))).otherwise("0"),
    )
    df = table(spark, sf_dir, "part").select(k, data.alias("data"))
    return fields.sequence(df, "p_partkey").select("p_partkey", "profile", "level", "sps_id", "chroma", "width", "height", "rate_num", "rate_den")


@query("SELECT c_custkey, CAST(c_custkey % 8 AS INTEGER) AS pps_id, CAST(c_nationkey % 4 AS INTEGER) AS sps_id, c_custkey % 2 = 1 AS cabac, CAST(1 + c_custkey % 5 AS INTEGER) AS refs0, 1 AS refs1, CAST(26 + c_custkey % 21 - 10 AS INTEGER) AS qp FROM customer")
def picture_header(spark, sf_dir):
    """Picture headers."""
    k = F.col("c_custkey")
    data = _bytes(bt.ue_code(k % 8), bt.ue_code(F.col("c_nationkey").cast("long") % 4), _u(k % 2, 1), F.lit("0"), bt.ue_code(F.lit(0)), bt.ue_code(k % 5), bt.ue_code(F.lit(0)), F.lit("000"), _se(k % 21 - 10), _se(F.lit(0)), _se(F.lit(2)), F.lit("101"))
    df = table(spark, sf_dir, "customer").select(k, data.alias("data"))
    return fields.picture(df, "c_custkey").select("c_custkey", "pps_id", "sps_id", "cabac", "refs0", "refs1", "qp")


def _sets(spark, sf_dir):
    """(c_custkey, and what a slice of the customer's needs to know): picture headers of customers, joined with the sequence headers of their nations; both read from bits."""
    n = F.col("n_nationkey").cast("long")
    cycle = F.concat(bt.ue_code(F.lit(1)), F.lit("0"), _se(F.lit(-2)), _se(F.lit(1)), bt.ue_code(n % 4), F.array_join(F.transform(F.slice(F.array(*map(F.lit, (3, -1, 7))), F.lit(1), (n % 4).cast("int")), _se), ""))
    poc = F.when(n % 3 == 0, F.concat(bt.ue_code(F.lit(0)), bt.ue_code(n % 5))).when(n % 3 == 1, cycle).otherwise(bt.ue_code(F.lit(2)))
    lists = F.when(n % 2 == 0, F.concat(F.lit("1"), F.lit("0"), F.lit("1"), _se(F.lit(-8)), F.lit("1"), _se(F.lit(8)), _se(F.lit(-16)), F.lit("000"), F.lit("00"))).otherwise("0")
    data = _bytes(_u(100, 8), _u(0, 8), _u(40, 8), bt.ue_code(n), bt.ue_code(F.lit(1)), bt.ue_code(F.lit(0)), bt.ue_code(F.lit(0)), F.lit("0"), lists, bt.ue_code(n % 6), poc, bt.ue_code(F.lit(4)), F.lit("0"), bt.ue_code(F.lit(19)), bt.ue_code(F.lit(14)), F.when(n % 2 == 0, "1").otherwise("00"), F.lit("100"))
    sets = fields.sequence(table(spark, sf_dir, "nation").select("n_nationkey", data.alias("data")), "n_nationkey").where("error is null")
    k = F.col("c_custkey")
    data = _bytes(bt.ue_code(k), bt.ue_code(F.col("c_nationkey").cast("long")), _u(k % 2, 1), _u(F.floor(k / 2) % 2, 1), bt.ue_code(F.lit(0)), bt.ue_code(k % 3), bt.ue_code(k % 2), _u(F.floor(k / 4) % 2, 1), _u(k % 3, 2), _se(k % 21 - 10), _se(F.lit(0)), _se(F.lit(0)), _u(F.floor(k / 8) % 2, 1), F.lit("0"), _u(F.floor(k / 16) % 2, 1))
    pictures = fields.picture(table(spark, sf_dir, "customer").select("c_custkey", data.alias("data")), "c_custkey").where("error is null")
    sets = sets.select(F.col("sps_id").alias("own"), "frame_bits", "frames_only", "poc_type", "poc_bits", "delta_zero", "chroma", "planes", "scaling", "cycle")
    return pictures.join(sets, F.col("sps_id") == F.col("own")).drop("own", "error")


def _slices(spark, sf_dir):
    """(o_orderkey, kind_, data, and CONTEXT): slices written as their parameter sets want them."""
    k, c = F.col("o_orderkey"), F.col
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(_sets(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    kind, idr, field = k % 3, k % 11 == 0, ~c("frames_only") & (k % 2 == 1)
    intra, bi = kind == 2, kind == 1
    on = lambda when, *parts: F.when(when, F.concat(*parts)).otherwise("")
    times = lambda n, f: F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda i: F.when(i <= n, f(i.cast("long"))).otherwise("")), "")
    poc = on(c("poc_type") == 0, F.lpad(F.bin(k % 16), c("poc_bits").cast("int"), "0"), on(c("order") & ~field, _se(k % 5 - 2)))
    poc = F.concat(poc, on((c("poc_type") == 1) & ~c("delta_zero"), _se(k % 7 - 3), on(c("order") & ~field, _se(k % 3 - 1))))
    refs = on(~intra, F.when(k % 2 == 0, F.concat(F.lit("1"), bt.ue_code(k % 4), on(bi, bt.ue_code(k % 3)))).otherwise("0"))
    n0, n1 = F.when(k % 2 == 0, k % 4 + 1).otherwise(c("refs0")), F.when(k % 2 == 0, k % 3 + 1).otherwise(c("refs1"))
    change = lambda n, shift: F.when(n == 0, "0").otherwise(F.concat(F.lit("1"), times(n, lambda i: F.concat(bt.ue_code((i + k) % 3), bt.ue_code(i * 5 + shift))), bt.ue_code(F.lit(3))))
    lists = F.concat(on(~intra, change(k % 5, 0)), on(bi, change(k % 4, 2)))
    weigh = lambda n: times(n, lambda i: F.concat(F.when((i + k) % 2 == 0, F.concat(F.lit("1"), _se(i + 20), _se(k % 9 - 4))).otherwise("0"), F.when((i + k) % 3 == 0, F.concat(F.lit("1"), _se(i - 30), _se(i), _se(k % 8 - 3), _se(-i))).otherwise("0")))
    weights = on(((kind == 0) & c("weighted")) | (bi & (c("bipred") == 1)), bt.ue_code(F.lit(5)), bt.ue_code(F.lit(4)), weigh(n0), on(bi, weigh(n1)))
    mark = lambda i: F.concat(bt.ue_code((i + k) % 6 + 1), on((i + k) % 6 + 1 != 5, bt.ue_code(i)), on((i + k) % 6 + 1 == 3, bt.ue_code(k % 3)))
    marks = on(k % 4 != 0, F.when(idr, "01").when(k % 7 == 0, "0").otherwise(F.concat(F.lit("1"), times(k % 7, mark), bt.ue_code(F.lit(0)))))
    end = F.concat(on(c("cabac") & ~intra, bt.ue_code(k % 3)), _se(k % 13 - 6), on(c("deblock"), bt.ue_code(k % 3), on(k % 3 != 1, _se(k % 5 - 2), _se(1 - k % 3))))
    data = _bytes(
        bt.ue_code(c("o_custkey") % 300), bt.ue_code(kind + 5 * (k % 2)), bt.ue_code(c("pps_id")), F.lpad(F.bin(k % 16), c("frame_bits").cast("int"), "0"), on(~c("frames_only"), F.when(field, F.concat(F.lit("1"), _u(F.floor(k / 2) % 2, 1))).otherwise("0")),
        on(idr, bt.ue_code(k % 9)), poc, on(c("redundant"), bt.ue_code(k % 2)), on(bi, _u(F.floor(k / 3) % 2, 1)), refs, lists, weights, marks, end,
    )
    return df.select("o_orderkey", data.alias("data"), F.when(idr, 5).otherwise(1).alias("unit_type"), (k % 4).alias("ref_idc"), *[n for n in fields.CONTEXT if n not in ("unit_type", "ref_idc")])


_LISTED = """WITH s AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(c_nationkey AS BIGINT) AS n, o_orderkey % 3 AS kind FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT *, k % 11 = 0 AS idr, n % 2 = 1 AND k % 2 = 1 AS field, CASE WHEN kind = 2 THEN 0 WHEN k % 2 = 0 THEN k % 4 + 1 ELSE c % 3 + 1 END AS n0, CASE WHEN kind <> 1 THEN 0 WHEN k % 2 = 0 THEN k % 3 + 1 ELSE c % 2 + 1 END AS n1, (kind = 0 AND (c // 4) % 2 = 1) OR (kind = 1 AND c % 3 = 1) AS told FROM s)"""


@query(f"""{_LISTED}
SELECT k AS o_orderkey, c % 300 AS first_mb, ['P', 'B', 'I'][kind + 1] AS kind, c AS pps_id, k % 16 AS frame_num, field, field AND (k // 2) % 2 = 1 AS bottom, CASE WHEN idr THEN k % 9 END AS idr_id, CASE WHEN n % 3 = 0 THEN k % 16 ELSE 0 END AS poc_lsb, CASE WHEN n % 3 = 0 AND (c // 2) % 2 = 1 AND NOT field THEN k % 5 - 2 ELSE 0 END AS delta_bottom,
 CASE WHEN n % 3 = 1 THEN k % 7 - 3 ELSE 0 END AS delta0, CASE WHEN n % 3 = 1 AND (c // 2) % 2 = 1 AND NOT field THEN k % 3 - 1 ELSE 0 END AS delta1, CASE WHEN (c // 16) % 2 = 1 THEN k % 2 ELSE 0 END AS redundant_no, kind = 1 AND (k // 3) % 2 = 1 AS direct_spatial, n0 AS refs0, n1 AS refs1,
 CASE WHEN c % 2 = 1 AND kind <> 2 THEN k % 3 ELSE 0 END AS cabac_table, 26 + c % 21 - 10 + k % 13 - 6 AS slice_qp, CASE WHEN (c // 8) % 2 = 1 THEN k % 3 ELSE 0 END AS edges_off, CASE WHEN (c // 8) % 2 = 1 AND k % 3 <> 1 THEN 2 * (k % 5 - 2) ELSE 0 END AS alpha, CASE WHEN (c // 8) % 2 = 1 AND k % 3 <> 1 THEN 2 * (1 - k % 3) ELSE 0 END AS beta FROM t""")
def slice_header(spark, sf_dir):
    """Slice headers, read after a join with their parameter sets: what is there, and how wide, depends on these."""
    names = ("first_mb", "kind", "pps_id", "frame_num", "field", "bottom", "idr_id", "poc_lsb", "delta_bottom", "delta0", "delta1", "redundant_no", "direct_spatial", "refs0", "refs1", "cabac_table", "slice_qp", "edges_off", "alpha", "beta")
    return fields.slices(_slices(spark, sf_dir), "o_orderkey", only=names).where("error is null").select("o_orderkey", *names)


@query(f"""{_LISTED}, l AS (SELECT *, CASE WHEN kind = 2 THEN 0 ELSE k % 5 END AS m0, CASE WHEN kind = 1 THEN k % 4 ELSE 0 END AS m1, CASE WHEN k % 4 = 0 OR idr THEN 0 ELSE k % 7 END AS m FROM t)
SELECT k AS o_orderkey, list_transform(range(1, m0 + 1), lambda i: (i + k) % 3) AS ops0, list_transform(range(1, m0 + 1), lambda i: i * 5) AS values0, list_transform(range(1, m1 + 1), lambda i: (i + k) % 3) AS ops1, list_transform(range(1, m1 + 1), lambda i: i * 5 + 2) AS values1,
 k % 4 <> 0 AND idr AS long_term, list_transform(range(1, m + 1), lambda i: (i + k) % 6 + 1) AS commands, list_transform(range(1, m + 1), lambda i: CASE WHEN (i + k) % 6 = 4 THEN 0 ELSE i END) AS a, list_transform(range(1, m + 1), lambda i: CASE WHEN (i + k) % 6 = 2 THEN k % 3 ELSE 0 END) AS b,
 CASE WHEN told THEN list_transform(range(1, n0 + 1), lambda i: CASE WHEN (i + k) % 2 = 0 THEN i + 20 ELSE 32 END) ELSE [] END AS luma0, CASE WHEN told THEN list_transform(range(1, n0 + 1), lambda i: CASE WHEN (i + k) % 3 = 0 THEN i - 30 ELSE 16 END) ELSE [] END AS cb0, CASE WHEN told THEN list_transform(range(1, n1 + 1), lambda i: CASE WHEN (i + k) % 3 = 0 THEN -i ELSE 0 END) ELSE [] END AS cr_offset1 FROM l""")
def slice_lists(spark, sf_dir):
    """Lists in slice headers: changes of both reference lists, marking commands and weights, each as long as it says."""
    found = fields.slices(_slices(spark, sf_dir), "o_orderkey", only=("changes0", "changes1", "long_term", "commands", "weights0", "weights1")).where("error is null")
    return found.select("o_orderkey", F.col("changes0.op").alias("ops0"), F.col("changes0.value").alias("values0"), F.col("changes1.op").alias("ops1"), F.col("changes1.value").alias("values1"), "long_term", F.col("commands.op").alias("commands"), F.col("commands.a").alias("a"), F.col("commands.b").alias("b"), F.col("weights0.luma").alias("luma0"), F.col("weights0.cb").alias("cb0"), F.col("weights1.cr_offset").alias("cr_offset1"))


@query("""SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS sps_id, c_nationkey % 2 = 0 AS frames_only, c_nationkey % 6 + 4 AS frame_bits, CASE WHEN c_nationkey % 3 = 1 THEN list_slice([3, -1, 7], 1, CAST(c_nationkey % 4 AS INTEGER)) ELSE [] END AS cycle, CASE WHEN c_nationkey % 2 = 0 THEN 8 ELSE 0 END AS n_lists,
 CASE WHEN c_nationkey % 2 = 0 THEN list_concat([16], list_transform(range(15), lambda i: 16)) ELSE NULL END AS third_list FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def parameter_sets(spark, sf_dir):
    """Picture headers with their sequence headers: cycles of orders, and scaling lists with their defaults and early ends."""
    scaling = F.col("scaling")
    return _sets(spark, sf_dir).select("c_custkey", "sps_id", "frames_only", "frame_bits", "cycle", F.coalesce(F.when(scaling.isNotNull(), F.size(scaling)), F.lit(0)).alias("n_lists"), F.get(scaling, F.lit(2)).alias("third_list"))


@query("SELECT o_orderkey, CAST(0 AS INTEGER) AS profile, o_orderkey % 2 = 0 AS key, o_custkey % 2 = 0 AS shown, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 1000 + 1 AS INTEGER) END AS width, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 500 + 1 AS INTEGER) END AS height FROM orders")
def frame_header(spark, sf_dir):
    """Frame headers of the other codec."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    size = F.concat(_u(0x498342, 24), F.lit("0100"), _u(c % 1000, 16), _u(k % 500, 16))
    data = _bytes(F.lit("10000"), _u(k % 2, 1), _u(1 - c % 2, 1), F.lit("0"), F.when(k % 2 == 0, size).otherwise("00000000"), emulation=False)
    df = table(spark, sf_dir, "orders").select(k, data.alias("data"))
    return fields.frame_start(df, "o_orderkey").select("o_orderkey", "profile", "key", "shown", "width", "height")


@query("""WITH RECURSIVE b AS (SELECT conv_id, turn, hex(encode(text)) AS h FROM conversations), w AS (SELECT conv_id, turn, 0 AS n, 0 AS pos, h FROM b UNION ALL SELECT conv_id, turn, n + 1, pos + 2 + CAST(('0x' || h[2 * pos + 3:2 * pos + 4]) AS INTEGER), h FROM w WHERE 2 * pos + 4 <= length(h))
SELECT conv_id, turn, CAST(n AS INTEGER) AS n, CAST(('0x' || h[2 * pos + 1:2 * pos + 2]) AS BIGINT) AS kind, CAST(('0x' || h[2 * pos + 3:2 * pos + 4]) AS BIGINT) AS size FROM w WHERE 2 * pos + 4 <= length(h)""")
def side_messages(spark, sf_dir):
    """Kinds and sizes of the messages in a payload, one after the other."""
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(messages(F.hex(F.encode("text", "utf-8")))).alias("n", "m"))
    return df.select("conv_id", "turn", "n", "m.kind", "m.size")


@query("""SELECT o_orderkey, CAST(1 + o_orderkey % 4 AS BIGINT) AS length_size, CAST(66 + o_orderkey % 3 AS BIGINT) AS profile, CAST(10 + o_custkey % 40 AS BIGINT) AS level, CAST(octet_length(encode(o_orderpriority)) AS BIGINT) AS first_set, CAST(o_custkey % 9 AS BIGINT) AS second_set FROM orders""")
def decoder_configuration(spark, sf_dir):
    """Configurations with two parameter sets, written as bytes and read."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    byte = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    wide = lambda v: F.lpad(F.hex(v.cast("long")), 4, "0")
    name, n = F.encode("o_orderpriority", "utf-8"), (c % 9).cast("int")
    data = F.unhex(F.concat(F.lit("01"), byte(66 + k % 3), F.lit("00"), byte(10 + c % 40), byte(252 + k % 4), F.lit("E1"), wide(F.octet_length(name)), F.hex(name), F.lit("01"), wide(n), F.repeat(F.lit("AB"), n)))
    return table(spark, sf_dir, "orders").select("o_orderkey", fields.configuration(data).alias("d")).select("o_orderkey", "d.*")
