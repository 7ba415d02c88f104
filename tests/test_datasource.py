"""The data source: ranges of files, sample tables, and writes that are whole or not at all."""

from __future__ import annotations

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.sources import datasource as ds


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    ds.register(spark)


def packets(spark, n=500, parts=3):
    payload = F.encode(F.repeat(F.concat(F.col("id").cast("string"), F.lit(".")), (F.col("id") % 7).cast("int")), "utf-8")
    return spark.range(n).repartition(parts).select("id", payload.alias("payload"), (F.col("id") * 10).alias("pts"), (1 + F.floor(F.col("id") / 50)).alias("duration"), (F.col("id") % 4 - 1).alias("shift"), (F.col("id") % 9 == 0).alias("is_key"))


def names(path):
    return sorted(x for x in os.listdir(path)) if os.path.exists(path) else []


@pytest.mark.parametrize("layout", ["ivf", "mp4"])
def test_any_ranges_give_all_samples(spark, tmp_path, layout):
    path = f"file://{tmp_path}/out"
    packets(spark).write.format("framewright").option("layout", layout).mode("append").save(path)
    want = sorted((bytes(r["payload"]), r["pts"] if layout == "ivf" else None) for r in packets(spark).collect())
    for size in (100, 1000, 10**9):
        df = spark.read.format("framewright").option("rangeBytes", size).load(path)
        assert df.rdd.getNumPartitions() == sum(max(1, -(-os.path.getsize(f"{tmp_path}/out/{x}") // size)) for x in names(f"{tmp_path}/out") if x.startswith("part"))
        got = sorted((bytes(r["payload"]), r["pts"] if layout == "ivf" else None) for r in df.collect())
        assert got == want, size
        assert df.where("size <> octet_length(payload)").count() == 0


def test_movie_keeps_times_and_keys(spark, tmp_path):
    df = packets(spark, parts=1).withColumn("payload", F.encode(F.col("id").cast("string"), "utf-8")).coalesce(1).sortWithinPartitions("id")
    df.write.format("framewright").mode("append").save(str(tmp_path))
    rows = spark.read.format("framewright").option("rangeBytes", 512).load(str(tmp_path)).orderBy("n").collect()
    dts = 0
    for i, r in enumerate(rows):
        assert (int(bytes(r["payload"])), r["dts"], r["pts"] - r["dts"], r["duration"], r["is_key"]) == (i, dts, i % 4 - 1, 1 + i // 50, i % 9 == 0)
        dts += r["duration"]
    assert len(rows) == 500


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    @F.udf("binary")
    def broken(i):
        if i == 1717:
            raise ValueError("no sample")
        return b"x" * 2000

    path = str(tmp_path / "out")
    bad = spark.range(4000).repartition(4).select(broken("id").alias("payload"))
    for layout in ("mp4", "wav"):
        with pytest.raises(Exception, match="no sample"):
            bad.write.format("framewright").option("layout", layout).mode("append").save(path)
        assert names(path) == []
    packets(spark).write.format("framewright").mode("append").save(path)
    before, count = names(path), spark.read.format("framewright").load(path).count()
    with pytest.raises(Exception, match="no sample"):
        bad.write.format("framewright").mode("append").save(path)
    assert names(path) == before and count == 500
    packets(spark, 100).write.format("framewright").mode("append").save(path)
    assert spark.read.format("framewright").load(path).count() == 600
    packets(spark, 70, 1).write.format("framewright").mode("overwrite").save(path)
    assert spark.read.format("framewright").load(path).count() == 70 and len(names(path)) == 2


def test_parts_that_no_manifest_lists_are_not_read(spark, tmp_path):
    packets(spark).write.format("framewright").mode("append").save(str(tmp_path))
    (tmp_path / "part-of-a-lost-job.ivf").write_bytes(b"DKIF" + b"\0" * 60)
    (tmp_path / "_pending-x").mkdir()
    (tmp_path / "_pending-x" / "part-1.mp4").write_bytes(b"half")
    assert spark.read.format("framewright").load(str(tmp_path)).count() == 500
    (tmp_path / ds.MANIFEST).unlink()
    with pytest.raises(Exception, match="no known format|moov|unpack"):
        (tmp_path / "other.bin").write_bytes(b"what is this file of no format")
        spark.read.format("framewright").load(str(tmp_path)).count()


def test_sample_tables_by_hand():
    """Five samples: chunks of 2, 2 and 1, durations in runs, shifts below zero, two key samples."""
    full = b"\0" * 4
    tables = {
        b"stsz": full + struct.pack(">II5I", 0, 5, 10, 20, 30, 40, 50),
        b"stsc": full + struct.pack(">I6I", 2, 1, 2, 1, 3, 1, 1),
        b"co64": full + struct.pack(">I3Q", 3, 1 << 33, 500, 900),
        b"stts": full + struct.pack(">I4I", 2, 3, 7, 2, 9),
        b"ctts": full + struct.pack(">Iii2i", 2, 1, -4, 4, 6),
        b"stss": full + struct.pack(">I2I", 2, 1, 4),
    }
    x = ds.sample_tables(tables)
    assert x.offset.tolist() == [1 << 33, (1 << 33) + 10, 500, 530, 900]
    assert x.dts.tolist() == [0, 7, 14, 21, 30] and x.duration.tolist() == [7, 7, 7, 9, 9]
    assert (x.pts - x.dts).tolist() == [-4, 6, 6, 6, 6] and np.flatnonzero(x.key).tolist() == [0, 3]
    fixed = ds.sample_tables(tables | {b"stsz": full + struct.pack(">II", 3, 5), b"stco": b"", b"co64": full + struct.pack(">I3Q", 3, 0, 100, 200)})
    assert fixed.offset.tolist() == [0, 3, 100, 103, 200]


def test_waves_in_packets(spark, tmp_path):
    body = np.arange(1000, dtype="<i2").tobytes()
    (tmp_path / "a.wav").write_bytes(ds.wav_head(len(body), 8000, 2, 16) + body)
    rows = spark.read.format("framewright").options(packet=64, rangeBytes=300).load(str(tmp_path)).orderBy("n").collect()
    assert b"".join(bytes(r["payload"]) for r in rows) == body
    assert [r["duration"] for r in rows] == [64] * 7 + [52]
