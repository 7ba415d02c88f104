"""Media files written from whole tables by the data source's sink, and read back by their sample indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..scratch import shared_dir
from ..sources import datasource
from ..tables import BLOCKS, blocks, table


def _there_and_back(df: DataFrame, range_bytes: int, **options: str | int) -> DataFrame:
    """df written as media files in the shared folder, a file for each task, and read back in ranges."""
    spark = df.sparkSession
    datasource.register(spark)
    path = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    df.write.format(datasource.NAME).options(**options).mode("append").save(path)
    return spark.read.format(datasource.NAME).option("rangeBytes", range_bytes).options(**options).load(path)


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.encode("text", "utf-8").alias("payload"))


@query("SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS pts, md5(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM conversations")
def ivf_round_trip(spark, sf_dir):
    """Turns of conversations, empty ones too, as frame files; ranges of their bytes are read back."""
    df = _turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pts"), "payload")
    return _there_and_back(df, 100_000, layout="ivf").select("pts", F.md5("payload").alias("digest"), "size")


@query("""SELECT conv_id, turn, CAST(1 + turn % 3 AS BIGINT) AS duration, CASE WHEN turn % 2 = 0 THEN 5 ELSE 0 END AS shift, role = 'user' AS is_key, md5(text) AS digest FROM conversations""")
def mp4_round_trip(spark, sf_dir):
    """Turns of conversations as samples of movies; tables of runs, chunks, shifts and key samples give them back."""
    turn = F.col("turn")
    tagged = F.concat(F.encode(F.concat_ws(":", "conv_id", "turn"), "utf-8"), F.encode(F.lit("|"), "utf-8"), F.col("payload"))
    df = _turns(spark, sf_dir).select(tagged.alias("payload"), (1 + turn % 3).alias("duration"), F.when(turn % 2 == 0, 5).otherwise(0).alias("shift"), (F.col("role") == "user").alias("is_key"))
    text = F.decode("payload", "utf-8")
    back = _there_and_back(df, 100_000, layout="mp4").withColumn("tag", F.substring_index(text, "|", 1))
    body = F.substring(F.col("payload"), F.length("tag") + 2, F.octet_length("payload"))
    part = F.split("tag", ":")
    return back.select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("turn"), "duration", (F.col("pts") - F.col("dts")).alias("shift"), "is_key", F.md5(body).alias("digest"))


@query(f"WITH {BLOCKS} SELECT array_to_string(list_transform(a, lambda x: x % 32768), ',') AS samples, CAST(64 AS BIGINT) AS duration FROM blocks")
def wav_round_trip(spark, sf_dir):
    """Vectors as wave files of 16-bit samples, read back in packets of 64."""
    clipped = F.transform("a", lambda x: x % 32_768)
    hexed = F.transform(clipped, lambda x: F.lpad(F.hex(F.pmod(x, F.lit(65_536))), 4, "0"))
    little = F.array_join(F.transform(hexed, lambda h: F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))), "")
    back = _there_and_back(blocks(spark, sf_dir).select(F.unhex(little).alias("payload")), 100_000, layout="wav", packet=64)
    each = F.transform(F.regexp_extract_all(F.hex("payload"), F.lit("(....)"), F.lit(1)), lambda h: F.conv(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("long"))
    signed = F.transform(each, lambda v: F.when(v >= 32_768, v - 65_536).otherwise(v))
    return back.select(F.array_join(signed.cast("array<string>"), ",").alias("samples"), "duration")
