"""Bytes and bits: checksums, Exp-Golomb codes, start codes, units and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import bits as bt
from ..operators.scan import running_sum
from ..tables import literal, table

_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
_K = ", ".join(_KEY)

_BYTES = "list_transform(range(0, octet_length(encode({0}))), lambda i: CAST(('0x' || substring(hex(encode({0})), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))"


@query("""WITH b AS (SELECT conv_id, turn, role, octet_length(encode(text)) AS size, text FROM conversations),
s AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY role ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dts FROM b),
x AS (SELECT conv_id, turn, sum(v) AS s1, sum((size - i) * v) AS s2 FROM (SELECT conv_id, turn, size, unnest(range(0, size)) AS i, CAST(('0x' || unnest(regexp_extract_all(hex(encode(text)), '..'))) AS BIGINT) AS v FROM b WHERE size > 0) GROUP BY conv_id, turn)
SELECT s.conv_id, s.turn, role, CAST(dts AS BIGINT) AS dts, CAST(size AS BIGINT) AS size, CAST(coalesce(s2 % 65521 * 65536 + s1 % 65521, 0) AS BIGINT) AS checksum,
 printf('%d, %d, %d, %d, %d, 0x%08x', CASE role WHEN 'assistant' THEN 0 WHEN 'system' THEN 1 ELSE 2 END, CAST(dts AS BIGINT), CAST(dts AS BIGINT), CAST(size AS BIGINT), CAST(size AS BIGINT), CAST(coalesce(s2 % 65521 * 65536 + s1 % 65521, 0) AS BIGINT)) AS line
FROM s LEFT JOIN x ON s.conv_id = x.conv_id AND s.turn = x.turn""")
def packet_listing(spark, sf_dir):
    """The checksum listing: a line for each packet with stream, times, size and Adler-32 of seed 0."""
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.octet_length("text").cast("long").alias("size"), bt.adler32(F.encode("text", "utf-8"), seed=0).alias("checksum"))
    df = running_sum(df, ["role"], ["conv_id", "turn"], F.col("size"), "dts")
    stream = F.when(F.col("role") == "assistant", 0).when(F.col("role") == "system", 1).otherwise(2)
    return df.select("conv_id", "turn", "role", "dts", "size", "checksum", F.format_string("%d, %d, %d, %d, %d, 0x%08x", stream, "dts", "dts", "size", "size", "checksum").alias("line"))


@query("SELECT doc_id, md5(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents")
def payload_md5(spark, sf_dir):
    """Digest and size of payloads."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode("text", "utf-8")).alias("digest"), F.octet_length("text").cast("long").alias("size"))


@query("""WITH h AS (SELECT doc_id, substring(hex(encode(text)), 1, 16) AS h FROM documents WHERE octet_length(encode(text)) >= 8)
SELECT doc_id, CAST(('0x' || h[1:2]) AS BIGINT) AS u8, CAST(('0x' || h[1:4]) AS BIGINT) AS u16be, CAST(('0x' || h[3:4] || h[1:2]) AS BIGINT) AS u16le, CAST(('0x' || h[1:8]) AS BIGINT) AS u32be, CAST(('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2]) AS BIGINT) AS u32le FROM h""")
def endian_ints(spark, sf_dir):
    """The first bytes of payloads as whole numbers of both byte orders; shorter payloads have none."""
    df = table(spark, sf_dir, "documents").where(F.octet_length("text") >= 8).select("doc_id", F.substring(F.encode("text", "utf-8"), 1, 8).alias("b"))
    return df.select("doc_id", bt.uint("b", 0, 1).alias("u8"), bt.uint("b", 0, 2).alias("u16be"), bt.uint("b", 0, 2, little=True).alias("u16le"), bt.uint("b", 0, 4).alias("u32be"), bt.uint("b", 0, 4, little=True).alias("u32le"))


@query(f"WITH v AS (SELECT {_K}, l_partkey * 13 % 5000 AS v FROM lineitem) SELECT {_K}, concat(repeat('0', CAST(floor(log2(v + 1)) AS INTEGER)), CAST(bin(v + 1) AS VARCHAR)) AS code, v AS ue FROM v")
def exp_golomb_ue(spark, sf_dir):
    """Unsigned Exp-Golomb codes, written and read again."""
    df = table(spark, sf_dir, "lineitem").select(*_KEY, bt.ue_code(F.col("l_partkey") * 13 % 5000).alias("code"))
    return df.select(*_KEY, "code", bt.read_ue(F.col("code")).alias("ue"))


@query(f"WITH v AS (SELECT {_K}, l_partkey * 13 % 5000 AS k FROM lineitem) SELECT {_K}, k, CASE WHEN k % 2 = 1 THEN (k + 1) // 2 ELSE -(k // 2) END AS se FROM v")
def exp_golomb_se(spark, sf_dir):
    """Signed Exp-Golomb values."""
    df = table(spark, sf_dir, "lineitem").select(*_KEY, bt.read_ue(bt.ue_code(F.col("l_partkey") * 13 % 5000)).alias("k"))
    return df.select(*_KEY, "k", bt.signed(F.col("k")).alias("se"))


@query(f"WITH v AS (SELECT {_K}, l_linenumber AS range_, l_partkey % 8 AS k FROM lineitem) SELECT {_K}, CASE WHEN range_ = 1 THEN 0 WHEN range_ = 2 THEN 1 - k % 2 ELSE k END AS te FROM v")
def exp_golomb_te(spark, sf_dir):
    """Truncated Exp-Golomb values: nothing for a range of 1, an inverted bit for 2."""
    k = F.col("l_partkey") % 8
    code = F.when(F.col("l_linenumber") == 2, (k % 2).cast("string")).otherwise(bt.ue_code(k))
    return table(spark, sf_dir, "lineitem").select(*_KEY, bt.read_te(code, F.col("l_linenumber")).alias("te"))


@query("""WITH u AS (SELECT page_id, string_split(html, '<p>') AS parts FROM pages), e AS (SELECT page_id, unnest(range(0, len(parts))) AS unit, unnest(parts) AS body FROM u)
SELECT page_id, unit, length(body) AS size, md5(body) AS digest FROM e WHERE unit > 0 AND body <> ''""")
def start_code_split(spark, sf_dir):
    """Units between start codes; what lies before the first code, and empty units, go."""
    df = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "<p>")).alias("unit", "body")).where("unit > 0 and body <> ''")
    return df.select("page_id", F.col("unit").cast("long").alias("unit"), F.length("body").cast("long").alias("size"), F.md5("body").alias("digest"))


@query("""WITH b AS (SELECT doc_id, CAST(('0x' || substring(hex(encode(text)), 1, 2)) AS BIGINT) AS b FROM documents WHERE text <> '')
SELECT doc_id, b >> 7 AS forbidden, (b >> 5) & 3 AS ref_idc, b & 31 AS unit_type, b >> 7 = 0 AS valid FROM b""")
def nal_header_bits(spark, sf_dir):
    """Fields of a unit's first byte."""
    b = F.col("b")
    df = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", bt.uint(F.encode("text", "utf-8"), 0, 1).alias("b"))
    return df.select("doc_id", F.shiftright(b, 7).alias("forbidden"), F.shiftright(b, 5).bitwiseAND(3).alias("ref_idc"), b.bitwiseAND(31).alias("unit_type"), (F.shiftright(b, 7) == 0).alias("valid"))


@query(r"""WITH b AS (SELECT doc_id, translate(text, 'aeiou', chr(1) || chr(2) || chr(3) || chr(3) || chr(3)) AS t FROM documents),
h AS (SELECT doc_id, regexp_replace(regexp_replace(hex(encode(t)), '(..)', '\1 ', 'g'), '(7[0-9A-F]|20) ', '00 ', 'g') AS h FROM b)
SELECT doc_id, replace(h, ' ', '') AS h, replace(regexp_replace(h, '00 00 03 ', '00 00 ', 'g'), ' ', '') AS rbsp, CAST((length(h) - length(regexp_replace(h, '00 00 03 ', '00 00 ', 'g'))) // 3 AS BIGINT) AS gone FROM h""")
def emulation_removal(spark, sf_dir):
    """The byte 3 after two zero bytes goes, from texts in which spaces and some letters are zeros and others small bytes."""
    t = F.translate(F.col("text"), "aeiou", "\x01\x02\x03\x03\x03")
    pairs = F.transform(F.regexp_extract_all(F.hex(F.encode(t, "utf-8")), F.lit("(..)"), F.lit(1)), lambda x: F.when(x.startswith("7") | (x == "20"), "00").otherwise(x))
    df = table(spark, sf_dir, "documents").select("doc_id", F.array_join(pairs, "").alias("h"))
    df = df.withColumn("rbsp", bt.without_emulation(F.col("h")))
    return df.select("doc_id", "h", "rbsp", F.floor((F.length("h") - F.length("rbsp")) / 2).alias("gone"))


@query("""WITH RECURSIVE b AS (SELECT o_orderkey, concat(printf('%02x', o_orderkey % 5), repeat('aa', CAST(o_orderkey % 5 AS INTEGER)), printf('%02x', o_custkey % 4), repeat('bb', CAST(o_custkey % 4 AS INTEGER)), '01cc') AS h FROM orders),
w AS (SELECT o_orderkey, 0 AS box, 0 AS pos, CAST(('0x' || h[1:2]) AS INTEGER) AS size, h FROM b UNION ALL SELECT o_orderkey, box + 1, pos + 1 + size, CAST(('0x' || substring(h, 2 * (pos + 1 + size) + 1, 2)) AS INTEGER), h FROM w WHERE 2 * (pos + 1 + size) < length(h))
SELECT o_orderkey, box, pos, size, substring(h, 2 * pos + 3, 2 * size) AS payload FROM w""")
def tlv_walk(spark, sf_dir):
    """Length-prefixed units of a run of bytes: number, place, size and payload."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.format_string("%02x", F.col("o_orderkey") % 5), F.repeat(F.lit("aa"), (F.col("o_orderkey") % 5).cast("int")), F.format_string("%02x", F.col("o_custkey") % 4), F.repeat(F.lit("bb"), (F.col("o_custkey") % 4).cast("int")), F.lit("01cc")).alias("h"))
    return df.select("o_orderkey", F.posexplode(bt.length_prefixed(F.col("h"))).alias("box", "u")).select("o_orderkey", "box", "u.pos", "u.size", F.col("u.h").alias("payload"))


@query(f"""WITH o AS (SELECT {_K}, CAST(l_quantity AS BIGINT) AS size, row_number() OVER w AS n, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate))
SELECT {_K}, n, CAST(off AS BIGINT) AS off, size FROM o""")
def superframe_offsets(spark, sf_dir):
    """Places of the frames of a superframe, from its index of sizes; an order is small, so a window per order is enough."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    size = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(*_KEY, F.row_number().over(w).cast("long").alias("n"), F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("off"), size.alias("size"))


@query("""WITH t AS (SELECT event_id, event_type, user_id, CASE user_id % 3 WHEN 0 THEN 'Title' WHEN 1 THEN 'ARTIST' ELSE 'album' END AS k FROM events)
SELECT event_id, CASE user_id % 3 WHEN 0 THEN event_type END AS title, CASE user_id % 3 WHEN 1 THEN event_type END AS artist, CASE user_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'artist' ELSE 'album' END AS normal, concat(k, '=', event_type, ';track=', CAST(event_id % 20 AS VARCHAR)) AS tags FROM t""")
def metadata_ci_lookup(spark, sf_dir):
    """Ordered tags, looked up without regard to case, and their names as the standard ones."""
    k = F.element_at(F.array(*map(F.lit, ("Title", "ARTIST", "album"))), (F.col("user_id") % 3 + 1).cast("int"))
    tags = F.array(F.struct(k.alias("k"), F.col("event_type").alias("v")), F.struct(F.lit("track").alias("k"), (F.col("event_id") % 20).cast("string").alias("v")))
    df = table(spark, sf_dir, "events").select("event_id", tags.alias("t"))
    return df.select("event_id", bt.tag("t", "TITLE").alias("title"), bt.tag("t", "artist").alias("artist"), F.lower(F.col("t")[0]["k"]).alias("normal"), F.array_join(F.transform("t", lambda x: F.concat(x["k"], F.lit("="), x["v"])), ";").alias("tags"))


@query("""WITH n AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'a' WHEN length(text) % 3 = 1 THEN 'b' ELSE 'c' END AS kind, length(text) AS v FROM conversations)
SELECT conv_id, count(*) AS entries, min_by(v, turn) FILTER (kind = 'a') AS first_a, CAST(count_if(kind <> 'b') AS BIGINT) AS without_b, array_to_string(list(kind ORDER BY turn), '') AS kinds FROM n GROUP BY conv_id""")
def side_data_multimap(spark, sf_dir):
    """Side data of packets: the first of a kind, all but a kind, and their order. Duplicates stay."""
    kind = F.element_at(F.array(*map(F.lit, "abc")), F.length("text") % 3 + 1)
    df = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", kind.alias("kind"), F.length("text").cast("long").alias("v")))).alias("s"))
    return df.select("conv_id", F.size("s").cast("long").alias("entries"), F.get(F.filter("s", lambda x: x["kind"] == "a"), F.lit(0))["v"].alias("first_a"), F.size(F.filter("s", lambda x: x["kind"] != "b")).cast("long").alias("without_b"), F.array_join(F.transform("s", lambda x: x["kind"]), "").alias("kinds"))


#: A prefix code: bits and symbol.
_CODES = (("1", 0), ("011", 1), ("010", 2), ("0011", 3), ("00101", 4), ("00100", 5), ("000", 6))


@query(f"""WITH c AS (SELECT * FROM (VALUES {', '.join(f"('{b}', {s})" for b, s in _CODES)}) t(bits, symbol)), v AS (SELECT p_partkey, right(concat('0000000', CAST(bin(p_partkey % 128) AS VARCHAR)), 7) AS peek FROM part)
SELECT p_partkey, peek, symbol, CAST(length(bits) AS INTEGER) AS used FROM v JOIN c ON starts_with(peek, bits)""")
def prefix_code(spark, sf_dir):
    """A symbol by the code that begins the next bits. The code is laid out for all peeks, so that it is an equal join."""
    wide = max(len(b) for b, _ in _CODES)
    rows = [(format(i, f"0{wide}b"), s, len(b)) for i in range(1 << wide) for b, s in _CODES if format(i, f"0{wide}b").startswith(b)]
    codes = literal(spark, rows, "head string, symbol int, used int")
    df = table(spark, sf_dir, "part").select("p_partkey", F.lpad(F.bin(F.col("p_partkey") % 128), 7, "0").alias("peek"))
    return df.join(F.broadcast(codes), F.substring("peek", 1, wide) == F.col("head")).select("p_partkey", "peek", "symbol", "used")


@query("SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines, CAST(coalesce(position(chr(10) IN text), 0) AS BIGINT) AS first_break, left(text, 4) AS fourcc FROM documents")
def fourcc_scan(spark, sf_dir):
    """The first four characters, and where the first break is."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"), F.instr(text, "\n").cast("long").alias("first_break"), F.substring(text, 1, 4).alias("fourcc"))
