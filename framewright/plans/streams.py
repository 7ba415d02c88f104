"""The stateful operators, run over all there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..scratch import shared_dir
from ..streaming import state
from .ordering import _PICS


def _pictures(spark, sf_dir):
    k = F.col("o_orderkey")
    return state.open_stream(spark, f"{sf_dir}/orders.parquet").select(k.alias("seq"), F.floor(k / 64).alias("seg"), (k * 2 + (k * 5 % 8) * 4).alias("poc"), (k % 4 != 3).alias("is_ref"))


#: Segments that have ended: all 64 pictures are there, or the watermark, 64 pictures behind the last, has passed.
_ENDED = "ended AS (SELECT seg FROM pics GROUP BY seg HAVING count(*) = 64 OR seg * 64 + 63 < (SELECT max(seq) FROM pics) - 64)"


@query(f"WITH {_PICS}, {_ENDED} SELECT seg, seq, poc, row_number() OVER (PARTITION BY seg ORDER BY poc, seq) AS n FROM pics WHERE seg IN (SELECT seg FROM ended)")
def reorder_stream(spark, sf_dir):
    """Display order of the segments that have ended, from a stream."""
    return state.run_available(state.reorder(_pictures(spark, sf_dir), late="64 seconds"), shared_dir(spark))


@query(f"""WITH {_PICS}, {_ENDED}, r AS (SELECT seg, seq, row_number() OVER (PARTITION BY seg ORDER BY seq) AS n FROM pics WHERE is_ref AND seg IN (SELECT seg FROM ended))
SELECT p.seq, CAST(count(*) AS BIGINT) AS held, min(r.seq) AS oldest FROM pics p JOIN r ON r.seg = p.seg AND r.seq <= p.seq AND r.n > (SELECT coalesce(max(n), 0) FROM r q WHERE q.seg = p.seg AND q.seq <= p.seq) - 4 GROUP BY p.seq""")
def dpb_stream(spark, sf_dir):
    """References held after each picture, from a stream."""
    return state.run_available(state.reference_buffer(_pictures(spark, sf_dir), late="64 seconds"), shared_dir(spark))


@query("""SELECT o_orderkey % 8 AS stream, o_orderkey // 8 AS seq, CAST(round(o_totalprice * 100) AS BIGINT) AS value FROM orders""")
def resequence_stream(spark, sf_dir):
    """Rows of eight streams by number, from a stream in any order: map state holds what is ahead of the number that is due."""
    state.with_rocks(spark)
    k = F.col("o_orderkey")
    rows = state.open_stream(spark, f"{sf_dir}/orders.parquet").select((k % 8).alias("stream"), F.floor(k / 8).alias("seq"), F.round(F.col("o_totalprice") * 100).alias("value"))
    return state.run_available(state.resequence(rows), shared_dir(spark))


@query("""WITH m AS (SELECT max(ts) - INTERVAL '1 day' AS mark FROM events), w AS (SELECT event_type, time_bucket(INTERVAL '2 hours', ts) AS start, count(*) AS frames FROM events GROUP BY 1, 2)
SELECT event_type, epoch_us(start) AS start_us, frames FROM w, m WHERE start + INTERVAL '2 hours' <= mark""")
def fps_stream(spark, sf_dir):
    """Counts in windows that the watermark has passed, from a stream."""
    stream = state.open_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    found = state.run_available(state.late_windows(stream, "ts", "event_type"), shared_dir(spark))
    return found.select("event_type", F.unix_micros("start").alias("start_us"), "frames")


