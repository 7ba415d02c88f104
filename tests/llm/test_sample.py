"""The training sample of languages whose characters lie in few texts, or in copies."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framewright.llm import langid


@pytest.mark.parametrize("bits", [12, 2])
def test_every_language_is_learned(spark, monkeypatch, bits):
    monkeypatch.setattr(langid, "_LEVEL_BITS", bits)
    monkeypatch.setattr(langid, "_RANGE_TEXTS", 1)
    long = spark.range(12).select(F.lit("long").alias("lang"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" lorem"), 3_000_000)).alias("text"))
    copies = spark.range(2000).select(F.lit("copies").alias("lang"), F.when(F.col("id") < 1000, "one text again and again").otherwise(F.concat_ws(" ", F.lit("text"), "id")).alias("text"))
    short = spark.createDataFrame([("short", "a b"), ("short", "")], "lang string, text string")
    got = langid.training_text(long.union(copies).union(short), F.lit(True), train_chars=3000)
    assert set(got) == {"long", "copies", "short"}
    assert len(got["long"]) >= 3000 and len(got["copies"]) >= 3000 and got["short"].split() == ["a", "b"]
    assert got["copies"].count("again and again") <= 1


def test_sample_is_of_the_smallest_hashes(spark):
    df = spark.range(5000).select(F.lit("x").alias("lang"), F.concat_ws(" ", F.lit("words"), "id").alias("text"))
    order = df.select("text", F.shiftrightunsigned(F.xxhash64("text", F.lit(9)), 1).alias("h")).orderBy("h").collect()
    got = langid.training_text(df.union(df), F.lit(True), train_chars=400)["x"]
    assert (" " + " ".join(r["text"] for r in order)).startswith(got)
