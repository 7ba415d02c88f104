"""Signals in chunks: all vectors of a label, one after the other, as one signal; and noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import noise
from ..operators import resample
from ..operators.scan import running_sum
from ..tables import BLOCKS, blocks, table


def _resampled(rate: int, to: int) -> str:
    """SQL: samples by place, outputs by number, and a row of weights for each phase, joined and summed."""
    cut = f"({resample.CUTOFF}::DOUBLE * least(1.0::DOUBLE, {to}.0::DOUBLE / {rate}))"
    return f"""WITH {BLOCKS}, o AS (SELECT vec_id, label, a, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS c FROM blocks),
s AS (SELECT label, c * 64 + i AS pos, a[i + 1] AS v FROM o, range(64) t(i)),
e AS (SELECT label, (max(pos) + 1) * {to} AS n FROM s GROUP BY label),
n AS (SELECT label, unnest(range(0, (n + {rate} - 1) // {rate})) AS n FROM e),
x AS (SELECT p, j, j - 63 - p / {to}.0::DOUBLE AS x FROM range({to}) q(p), range(128) r(j)),
y AS (SELECT p, j, CASE WHEN x = 0 THEN 1.0::DOUBLE ELSE sin(pi() * {cut} * x) / (pi() * {cut} * x) END * pow(0.35875 - 0.48829 * cos(2 * pi() * (x + 64) / 128) + 0.14128 * cos(4 * pi() * (x + 64) / 128) - 0.01168 * cos(6 * pi() * (x + 64) / 128), 2) AS w FROM x),
w AS (SELECT p, j, CAST(floor(w / sum(w) OVER (PARTITION BY p) * 16777216 + 0.5) AS BIGINT) AS w FROM y),
t AS (SELECT label, n, n * {rate} // {to} AS pos, n * {rate} % {to} AS p FROM n),
r AS (SELECT t.label, t.n, t.pos, CAST(sum(w.w * coalesce(s.v, 0)) AS BIGINT) AS total FROM t JOIN w USING (p) LEFT JOIN s ON s.label = t.label AND s.pos = t.pos + w.j - 63 GROUP BY t.label, t.n, t.pos),
g AS (SELECT label, pos // 64 AS c, min(n) AS first, list((total + 8388608) >> 24 ORDER BY n) AS samples FROM r GROUP BY label, pos // 64)
SELECT o.label, o.vec_id, first, samples FROM g JOIN o ON g.label = o.label AND g.c = o.c"""


@query(_resampled(160, 147))
def resample_down(spark, sf_dir):
    """Long signals from 48,000 to 44,100 in chunks that share their ends, by 128 taps."""
    return resample.resample(blocks(spark, sf_dir), ["label"], ["vec_id"], "a", 48_000, 44_100)


@query(_resampled(2, 3))
def resample_up(spark, sf_dir):
    """Long signals from two to three samples in chunks that share their ends, by 128 taps."""
    return resample.resample(blocks(spark, sf_dir).select("label", "vec_id", F.col("a")), ["label"], ["vec_id"], "a", 32_000, 48_000)


#: Samples of a row of the noise; the rate of the sweep.
_ROW, _RATE = 256, 8000


@query(f"""WITH RECURSIVE p AS (SELECT 0 AS k, 314159::HUGEINT AS a, 1::HUGEINT AS c UNION ALL SELECT k + 1, a * a % 4294967296, (c * a + c) % 4294967296 FROM p WHERE k < 31),
s AS (SELECT o_orderkey AS n, -1 AS k, 1::HUGEINT AS x FROM orders UNION ALL SELECT n, p.k, CASE WHEN (n * {_ROW} >> p.k) & 1 = 1 THEN (x * a + c) % 4294967296 ELSE x END FROM s JOIN p ON p.k = s.k + 1),
w AS (SELECT n, 0 AS i, x FROM s WHERE k = 31 UNION ALL SELECT n, i + 1, (x * 314159 + 1) % 4294967296 FROM w WHERE i < {_ROW}),
v AS (SELECT n, i, CAST(x % 20000 - 10000 AS BIGINT) AS v FROM w WHERE i > 0)
SELECT n AS o_orderkey, CAST(n * {_ROW} AS BIGINT) AS first_sample, CAST(sum(v) AS BIGINT) AS total, md5(string_agg(v, ',' ORDER BY i)) AS digest FROM v GROUP BY n""")
def noise_source(spark, sf_dir):
    """A long signal of noise, 256 samples for each order: any row begins at its own sample by powers of the step."""
    at = F.col("o_orderkey") * _ROW
    df = table(spark, sf_dir, "orders").select("o_orderkey", at.alias("first_sample"), noise.state_at(at).alias("x"))
    df = df.withColumn("v", noise.noise_from(F.col("x"), _ROW, 20_000))
    return df.select("o_orderkey", "first_sample", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.md5(F.array_join(F.col("v").cast("array<string>"), ",")).alias("digest"))


@query(f"""WITH f AS (SELECT o_orderkey AS n, (100 + 9900 * o_orderkey // {_RATE}) * 65536 // {_RATE} AS step FROM orders),
a AS (SELECT n, coalesce(sum(step) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 65536 AS a FROM f),
h AS (SELECT n, a, CASE WHEN a >= 32768 THEN 65536 - a ELSE a END AS b FROM a),
q AS (SELECT n, a, b > 16384 AS low, CASE WHEN b > 16384 THEN 32768 - b ELSE b END AS c FROM h),
t AS (SELECT n, a, low, c, CAST(round(32768 * cos(pi() * (c // 128) / 256)) AS BIGINT) AS p, CASE WHEN c // 128 = 128 THEN 0 ELSE CAST(round(32768 * cos(pi() * (c // 128 + 1) / 256)) AS BIGINT) END AS q FROM q),
v AS (SELECT n, a, low, p + CAST(((q - p) * (c % 128) + 64) >> 7 AS BIGINT) AS v FROM t)
SELECT n AS o_orderkey, CAST(a AS BIGINT) AS angle, CAST(((CASE WHEN low THEN -v ELSE v END) * 2 * 10000) >> 16 AS BIGINT) AS sample FROM v""")
def sweep_source(spark, sf_dir):
    """A cosine whose frequency rises from 100 Hz on: angles are running sums of whole steps, samples from a quarter wave."""
    n = F.col("o_orderkey")
    step = F.floor((100 + F.floor(9900 * n / _RATE)) * 65_536 / _RATE).cast("long")
    df = running_sum(table(spark, sf_dir, "orders").select("o_orderkey"), [], ["o_orderkey"], step, "angle")
    return df.select("o_orderkey", (F.col("angle") % 65_536).alias("angle"), F.floor(noise.cosine(F.col("angle")) * 10_000 / 65_536).cast("long").alias("sample"))
