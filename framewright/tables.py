"""Reading the tables, and the media relations that queries take from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL for what ``packets`` reads: one row per event as a packet of the stream of its type.
PACKETS = """packets AS (SELECT event_id AS seq, dense_rank() OVER (ORDER BY event_type) - 1 AS stream_index, event_type AS kind, epoch_us(ts) AS pts,
 CAST(round(value * 100) AS BIGINT) AS size, event_type = 'signup' AS is_key, user_id, ts FROM events)"""
#: SQL for what ``blocks`` reads: 64 whole numbers per vector.
BLOCKS = "blocks AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS a FROM embeddings)"
#: Streams of a packet log, in order of their names: these five kinds are fixed values.
KINDS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, its zone-less times read as UTC (the session's zone must be UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, stream_index, kind, pts (µs), size, is_key, user_id, ts. Streams are a fixed dimension, so no pass finds them."""
    index = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")).cast("int") - 1
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), index.alias("stream_index"), F.col("event_type").alias("kind"), F.unix_micros("ts").alias("pts"), F.round(F.col("value") * 100).cast("long").alias("size"), (F.col("event_type") == "signup").alias("is_key"), "user_id", "ts")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and a: 64 whole numbers, thousandths of the vector."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("a"))


def literal(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small fixed table as a part of the plan itself: no task has to make it."""
    text = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    fields = [f.strip().split() for f in schema.split(",")]
    df = spark.sql(f"SELECT * FROM VALUES {text} AS t({', '.join(n for n, _ in fields)})")
    return df.select(*[F.col(n).cast(kind).alias(n) for n, kind in fields])
