"""Byte streams in chunks: the texts of a source, one after the other, with some letters as the bytes of start codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import prefix
from ..operators import bytestream
from ..tables import table


def _chunks(spark, sf_dir):
    """(source, doc_id, bytes): blanks and e are zeros, t is one; codes lie over the ends of texts too."""
    text = F.replace(F.regexp_replace("text", "[ e]", "\x00"), F.lit("t"), F.lit("\x01"))
    return table(spark, sf_dir, "documents").select("source", "doc_id", F.encode(text, "utf-8").alias("bytes"))


_UNITS = r"""t AS (SELECT source, doc_id, hex(encode(translate(text, ' et', chr(0) || chr(0) || chr(1)))) AS h FROM documents WHERE text <> ''),
s AS (SELECT source, string_agg(h, '' ORDER BY doc_id) AS h FROM t GROUP BY source),
c AS (SELECT source, h, array_to_string(list_transform(regexp_extract_all(h, '..'), lambda x: CASE x WHEN '00' THEN '0' WHEN '01' THEN '1' ELSE '.' END), '') AS c FROM s),
p AS (SELECT source, h, string_split(c, '001') AS parts FROM c),
e AS (SELECT source, h, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part, len(parts) AS n FROM p),
o AS (SELECT source, h, i, n, part, sum(length(part) + 3) OVER (PARTITION BY source ORDER BY i) - length(part) - 3 AS pos FROM e),
z AS (SELECT source, i, CAST(pos AS BIGINT) AS pos, length(part) - CASE WHEN i < n AND part LIKE '%0' THEN 1 ELSE 0 END AS size, substring(h, CAST(2 * pos + 1 AS BIGINT), 2 * length(part)) AS h FROM o WHERE i > 1),
u AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY i) AS unit, pos, CAST(size AS BIGINT) AS size, CAST(('0x' || h[1:2]) AS INTEGER) AS first, CASE WHEN size > 1 THEN CAST(('0x' || h[3:4]) AS INTEGER) ELSE -1 END AS second,
 CAST(list_sum(list_transform(regexp_extract_all(h[1:2 * size], '..'), lambda x: CAST(('0x' || x) AS INTEGER))) AS BIGINT) AS total FROM z WHERE size > 0)"""


@query(f"WITH {_UNITS} SELECT source, unit, pos, size, (first >> 5) & 3 AS ref_idc, first & 31 AS unit_type, first < 128 AND first & 31 BETWEEN 1 AND 12 AS valid, second, total FROM u")
def start_code_units(spark, sf_dir):
    """Units between start codes of three or four bytes in streams of chunks; what lies before a stream's first code, and empty units, go."""
    first, kind = F.col("first"), F.col("first").bitwiseAND(31)
    found = bytestream.units(_chunks(spark, sf_dir), ["source"], ["doc_id"], "bytes")
    return found.select("source", "unit", "pos", "size", F.shiftright(first, 5).bitwiseAND(3).alias("ref_idc"), kind.alias("unit_type"), ((first < 128) & kind.between(1, 12)).alias("valid"), "second", "total")


@query(f"""WITH {_UNITS},
k AS (SELECT *, first & 31 IN (1, 5) AS slice, first & 31 IN (6, 7, 8, 9, 14, 15) AS head FROM u),
m AS (SELECT *, coalesce(max(CASE WHEN slice THEN unit END) OVER w, 0) AS s, coalesce(max(CASE WHEN head THEN unit END) OVER w, 0) AS d FROM k WINDOW w AS (PARTITION BY source ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(CASE WHEN unit = 1 OR (s > d AND (head OR (slice AND second >= 128))) THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY unit) AS picture FROM m)
SELECT source, CAST(picture AS BIGINT) AS unit, CAST(picture - 1 AS BIGINT) AS pts, min(unit) AS first_unit, count(*) AS parts, CAST(sum(size) AS BIGINT) AS bytes, bool_or(first & 31 = 5) AS is_key FROM g GROUP BY source, picture""")
def access_units(spark, sf_dir):
    """Pictures of a byte stream: one begins at a header, or at a first slice, that follows a slice; gaps and islands over the units of its bytes."""
    found = bytestream.pictures(bytestream.units(_chunks(spark, sf_dir), ["source"], ["doc_id"], "bytes"), ["source"])
    return found.select("source", F.col("picture").alias("unit"), (F.col("picture") - 1).alias("pts"), "first_unit", "parts", "bytes", "is_key")


_CODES = r"""d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text <> ''),
y AS (SELECT doc_id, unnest(range(0, length(h) // 2)) AS i, CAST(('0x' || unnest(regexp_extract_all(h, '..'))) AS INTEGER) AS symbol FROM d),
x AS (SELECT doc_id, CAST(i // 4096 AS INTEGER) AS block, i, symbol, CASE WHEN i % 4096 = 0 THEN 0 ELSE lag(symbol) OVER (PARTITION BY doc_id ORDER BY i) END AS b FROM y),
c AS (SELECT doc_id, block, i, symbol, CASE WHEN b <= 32 THEN 0 WHEN b BETWEEN 97 AND 122 THEN 1 WHEN b < 128 THEN 2 ELSE 3 END AS context FROM x),
n AS (SELECT context, symbol, count(*) AS n FROM c GROUP BY context, symbol),
r AS (SELECT *, greatest(n, (CAST(sum(n) OVER (PARTITION BY context) AS BIGINT) + 65535) // 65536) AS m FROM n),
l AS (SELECT *, (CAST(sum(m) OVER (PARTITION BY context) AS BIGINT) + m - 1) // m - 1 AS most FROM r),
s AS (SELECT context, symbol, n, CAST(CASE WHEN most > 0 THEN length(bin(most)) ELSE 1 END AS INTEGER) AS length FROM l),
k AS (SELECT context, symbol, n, length, left(lpad(bin(CAST(coalesce(sum(1::BIGINT << (18 - length)) OVER (PARTITION BY context ORDER BY length, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)), 18, '0'), length) AS code FROM s)"""


def _pieces(spark, sf_dir):
    return prefix.blocks(table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query(f"WITH {_CODES} SELECT context, symbol, n, length, code FROM k")
def prefix_tables(spark, sf_dir):
    """Prefix codes of bytes by context, from the counts of all documents."""
    return prefix.codes(prefix.counts(_pieces(spark, sf_dir)))


@query(f"""WITH {_CODES},
b AS (SELECT doc_id, block, count(*) AS n_bytes, CAST(sum(length) AS BIGINT) AS n_bits, string_agg(code, '' ORDER BY i) AS bits, string_agg(printf('%02X', symbol), '' ORDER BY i) AS raw FROM c JOIN k USING (context, symbol) GROUP BY doc_id, block),
p AS (SELECT *, rpad(bits, CAST((n_bits + 7) // 8 * 8 AS INTEGER), '0') AS full_ FROM b)
SELECT doc_id, block, n_bytes, n_bits, md5(array_to_string(list_transform(regexp_extract_all(full_, '....'), lambda x: substr('0123456789ABCDEF', 1 + 8 * CAST(x[1] AS INTEGER) + 4 * CAST(x[2] AS INTEGER) + 2 * CAST(x[3] AS INTEGER) + CAST(x[4] AS INTEGER), 1)), '')) AS packed, md5(raw) AS decoded FROM p""")
def prefix_round_trip(spark, sf_dir):
    """All documents in prefix codes of their own counts, and read back by two lookups a symbol."""
    pieces = _pieces(spark, sf_dir)
    found = prefix.round_trip(pieces, prefix.codes(prefix.counts(pieces)))
    return found.select("doc_id", "block", "n_bytes", "n_bits", F.md5(F.hex("packed")).alias("packed"), F.md5(F.hex("decoded")).alias("decoded"))
