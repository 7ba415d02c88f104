"""Registries of readers and codecs: ranked lookup, names, classes and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..tables import KINDS, PACKETS, literal, packets, table


@query("""SELECT p_brand, p_partkey, score, p_size AS priority FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_size DESC, p_partkey) AS rn FROM (SELECT *, CAST(p_partkey * 37 % 101 AS BIGINT) AS score FROM part) WHERE score > 0) WHERE rn = 1""")
def probe_argmax(spark, sf_dir):
    """The reader that a probe picks: highest score, then priority, then the first; score 0 never matches."""
    df = table(spark, sf_dir, "part").withColumn("score", F.col("p_partkey") * 37 % 101).where("score > 0")
    best = F.max_by(F.struct("p_partkey", "score", "p_size"), F.struct("score", "p_size", -F.col("p_partkey")))  # an aggregate combines before the shuffle; a ranking window would not
    return df.groupBy("p_brand").agg(best.alias("b")).select("p_brand", "b.p_partkey", F.col("b.score").alias("score"), F.col("b.p_size").alias("priority"))


@query("SELECT p_brand, p_partkey, p_size AS priority FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey DESC) AS rn FROM part) WHERE rn = 1")
def codec_pick_last_tie(spark, sf_dir):
    """The codec of each name with the highest priority; of equals the last registered."""
    best = F.max_by(F.struct("p_partkey", "p_size"), F.struct("p_size", "p_partkey"))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(best.alias("b")).select("p_brand", "b.p_partkey", F.col("b.p_size").alias("priority"))


#: Writers and their extensions.
_WRITERS = (("wav", "wav,wave"), ("mp4", "mp4,m4a,m4v,mov"), ("ivf", "ivf"), ("raw", "h264,264,avc"), ("listing", "crc,framecrc"))
_EXTS = ("WAV", "mov", "264", "xyz", "Crc", "m4a", "ivf")


@query(f"""WITH w AS (SELECT writer, unnest(string_split(exts, ',')) AS ext FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _WRITERS)}) t(writer, exts)),
d AS (SELECT doc_id, CASE doc_id % 7 {' '.join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_EXTS))} END AS ext FROM documents)
SELECT doc_id, d.ext, writer FROM d LEFT JOIN w ON lower(d.ext) = w.ext""")
def writer_by_extension(spark, sf_dir):
    """The writer whose list of extensions holds a file's, in any case."""
    writers = literal(spark, _WRITERS, "writer string, exts string").select("writer", F.explode(F.split("exts", ",")).alias("e"))
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % 7 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", ext.alias("ext"))
    return docs.join(F.broadcast(writers), F.lower("ext") == F.col("e"), "left").select("doc_id", "ext", "writer")


@query("""SELECT name, bool_or(d) AS can_decode, bool_or(e) AS can_encode, count(*) AS entries, min(note) AS note FROM (
 SELECT p_brand AS name, true AS d, false AS e, CASE WHEN p_size > 25 THEN p_type END AS note FROM part UNION ALL SELECT concat('Brand#', CAST(10 + s_suppkey % 50 AS VARCHAR)), false, true, NULL FROM supplier) GROUP BY name""")
def codec_catalogue_flags(spark, sf_dir):
    """Names of two catalogues as one: what each can do, and its first note."""
    dec = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.lit(True).alias("d"), F.lit(False).alias("e"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("note"))
    enc = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Brand#"), (10 + F.col("s_suppkey") % 50).cast("string")).alias("name"), F.lit(False).alias("d"), F.lit(True).alias("e"), F.lit(None).cast("string").alias("note"))
    return dec.unionByName(enc).groupBy("name").agg(F.bool_or("d").alias("can_decode"), F.bool_or("e").alias("can_encode"), F.count("*").alias("entries"), F.min("note").alias("note"))


@query("SELECT name FROM (SELECT p_brand AS name FROM part UNION SELECT concat('Brand#', CAST(10 + s_suppkey % 50 AS VARCHAR)) FROM supplier)")
def registry_union(spark, sf_dir):
    """The distinct names of two catalogues."""
    a = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Brand#"), (10 + F.col("s_suppkey") % 50).cast("string")).alias("name"))
    return a.union(b).distinct()


@query("SELECT p_partkey, CASE WHEN p_size % 9 IN (0, 1, 2, 3) THEN 'video' WHEN p_size % 9 IN (4, 5, 6) THEN 'audio' WHEN p_size % 9 = 7 THEN 'subtitle' ELSE 'data' END AS media FROM part")
def media_type_classify(spark, sf_dir):
    """Codec ids as video, audio, subtitle or data."""
    c = F.col("p_size") % 9
    return table(spark, sf_dir, "part").select("p_partkey", F.when(c.isin(0, 1, 2, 3), "video").when(c.isin(4, 5, 6), "audio").when(c == 7, "subtitle").otherwise("data").alias("media"))


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def name_map_broadcast(spark, sf_dir):
    """Ids to names and names to classes, by the two dimension tables (25 and 5 rows, fixed)."""
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return table(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


#: Sample formats: bytes a sample, and the planar counterpart's mark.
_FORMATS = (("u8", 1), ("s16", 2), ("s32", 4), ("flt", 4), ("dbl", 8), ("s64", 8))


@query(f"""WITH f AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{a}', {b})" for i, (a, b) in enumerate(_FORMATS))}) t(id, name, bytes))
SELECT vec_id, name, CAST(bytes AS INTEGER) AS bytes, CASE WHEN label % 2 = 1 THEN concat(name, 'p') ELSE name END AS form, CASE WHEN label % 2 = 1 THEN name ELSE concat(name, 'p') END AS other FROM embeddings JOIN f ON vec_id % 6 = id""")
def sample_format_traits(spark, sf_dir):
    """Size, layout and counterpart of sample formats."""
    f = literal(spark, [(i, a, b) for i, (a, b) in enumerate(_FORMATS)], "id long, name string, bytes int")
    df = table(spark, sf_dir, "embeddings").join(F.broadcast(f), F.col("vec_id") % 6 == F.col("id"))
    planar = F.concat("name", F.lit("p"))
    return df.select("vec_id", "name", "bytes", F.when(F.col("label") % 2 == 1, planar).otherwise(F.col("name")).alias("form"), F.when(F.col("label") % 2 == 1, F.col("name")).otherwise(planar).alias("other"))


@query("""SELECT page_id, CASE WHEN starts_with(html, '<!DOCTYPE html>') THEN 90 WHEN starts_with(html, '<html') THEN 70 WHEN ends_with(regexp_replace(url, '[?#].*', ''), '.html') THEN 50 ELSE 0 END AS score,
 CASE WHEN contains(substring(html, 1, 4096), 'charset') THEN 'text' ELSE 'binary' END AS kind FROM pages""")
def magic_probe(spark, sf_dir):
    """Scores of a format by the first bytes, else by the extension."""
    ext = F.regexp_replace("url", "[?#].*", "").endswith(".html")
    score = F.when(F.col("html").startswith("<!DOCTYPE html>"), 90).when(F.col("html").startswith("<html"), 70).when(ext, 50).otherwise(0)
    return table(spark, sf_dir, "pages").select("page_id", score.alias("score"), F.when(F.contains(F.substring("html", 1, 4096), F.lit("charset")), "text").otherwise("binary").alias("kind"))


@query(f"""WITH {PACKETS} SELECT CAST(stream_index AS INTEGER) AS stream_index, kind, count(*) AS packets, min(pts) AS start_pts, max(pts) - min(pts) AS duration, CAST(sum(size) AS BIGINT) AS bytes, CAST(count_if(is_key) AS BIGINT) AS keys,
 printf('Stream #%d: %s, %d packets', stream_index, kind, count(*)) AS line FROM packets GROUP BY stream_index, kind""")
def stream_probe(spark, sf_dir):
    """What a probe says of each stream."""
    df = packets(spark, sf_dir).groupBy("stream_index", "kind").agg(F.count("*").alias("packets"), F.min("pts").alias("start_pts"), (F.max("pts") - F.min("pts")).alias("duration"), F.sum("size").alias("bytes"), F.count_if("is_key").alias("keys"))
    return df.withColumn("line", F.format_string("Stream #%d: %s, %d packets", "stream_index", "kind", "packets"))


@query(f"""WITH {PACKETS} SELECT CASE WHEN stream_index < 2 THEN 'video' ELSE 'audio' END AS media, CAST(min(stream_index) AS INTEGER) AS first_stream, count(*) AS packets FROM packets GROUP BY 1""")
def stream_pick(spark, sf_dir):
    """The first stream of each media type."""
    media = F.when(F.col("stream_index") < 2, "video").otherwise("audio")
    return packets(spark, sf_dir).groupBy(media.alias("media")).agg(F.min("stream_index").alias("first_stream"), F.count("*").alias("packets"))


@query(f"WITH {PACKETS} SELECT seq, CAST(stream_index AS INTEGER) AS stream_index, pts, size, is_key FROM packets WHERE stream_index IN (1, 3)")
def stream_select(spark, sf_dir):
    """The packets of chosen streams; the choice reaches the scan as a filter on the stored column."""
    return packets(spark, sf_dir).where(F.col("kind").isin(*[KINDS[i] for i in (1, 3)])).select("seq", "stream_index", "pts", "size", "is_key")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'bt709' ELSE 'bt601' END AS matrix, CASE WHEN o_orderpriority LIKE '1%' THEN 'full' ELSE 'limited' END AS range_ FROM orders")
def colour_space_choice(spark, sf_dir):
    """The matrix and range that a picture's tags ask for."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "bt709").otherwise("bt601").alias("matrix"), F.when(F.col("o_orderpriority").like("1%"), "full").otherwise("limited").alias("range_"))


@query("SELECT c_custkey, concat_ws('+', CASE WHEN c_nationkey & 1 > 0 THEN 'FL' END, CASE WHEN c_nationkey & 2 > 0 THEN 'FR' END, CASE WHEN c_nationkey & 4 > 0 THEN 'FC' END, CASE WHEN c_nationkey & 8 > 0 THEN 'LFE' END, CASE WHEN c_nationkey & 16 > 0 THEN 'BL' END) AS channels, CASE c_nationkey WHEN 4 THEN 'mono' WHEN 3 THEN 'stereo' WHEN 11 THEN '2.1' ELSE concat(CAST(bit_count(c_nationkey) AS VARCHAR), ' channels') END AS layout FROM customer")
def channel_layout(spark, sf_dir):
    """A mask's channels joined by +, and its layout's name or only their number."""
    names = ("FL", "FR", "FC", "LFE", "BL")
    m = F.col("c_nationkey")
    parts = F.concat_ws("+", *[F.when(m.bitwiseAND(1 << i) > 0, n) for i, n in enumerate(names)])
    layout = F.when(m == 4, "mono").when(m == 3, "stereo").when(m == 11, "2.1").otherwise(F.concat(F.bit_count(m).cast("string"), F.lit(" channels")))
    return table(spark, sf_dir, "customer").select("c_custkey", parts.alias("channels"), layout.alias("layout"))


@query("SELECT p_brand, p_type, p_partkey FROM part WHERE p_partkey IN (SELECT max(p_partkey) FROM part GROUP BY p_brand, p_type)")
def catalogue_last(spark, sf_dir):
    """The last entry of each name and kind in a catalogue."""
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.max("p_partkey").alias("p_partkey"))


