"""State over several batches in shuffled order gives what one batch gives, and ends with its segment."""

from __future__ import annotations

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from framewright.streaming import state


def _stream(spark, tmp_path, order, step=25):
    """Files of so many pictures each, that come one a batch in the order given."""
    k = F.col("id")
    folder = tmp_path / "in"
    folder.mkdir()
    for turn, i in enumerate(order):
        spark.range(i * step, (i + 1) * step).select(k.alias("seq"), F.floor(k / 64).alias("seg"), (k * 2 + (k * 5 % 8) * 4).alias("poc"), (k % 4 != 3).alias("is_ref")).coalesce(1).write.parquet(str(tmp_path / f"part{turn}"))
        file = next((tmp_path / f"part{turn}").glob("*.parquet"))
        os.utime(file, (1_000_000 + turn, 1_000_000 + turn))
        file.rename(folder / f"{turn:03}.parquet")
    return state.open_stream(spark, f"{folder}/", files_per_batch=1)


@pytest.mark.parametrize("seed", [None, 1])
def test_reorder_over_batches(spark, tmp_path, seed):
    order = list(range(12))
    if seed is not None:
        random.Random(seed).shuffle(order)
    got = state.run_available(state.reorder(_stream(spark, tmp_path, order), late="1 hour"), str(tmp_path)).collect()
    assert {r["seg"] for r in got} == {0, 1, 2, 3}, "the last segment has not ended"
    for seg in range(4):
        pics = sorted((s * 2 + (s * 5 % 8) * 4, s) for s in range(seg * 64, seg * 64 + 64))
        assert [(r["poc"], r["seq"]) for r in sorted(got, key=lambda r: r["n"]) if r["seg"] == seg] == pics


def test_references_over_batches(spark, tmp_path):
    got = {r["seq"]: (r["held"], r["oldest"]) for r in state.run_available(state.reference_buffer(_stream(spark, tmp_path, [2, 0, 1, 5, 4, 3]), late="1 hour"), str(tmp_path)).collect()}
    assert set(got) == set(range(128))
    for s in got:
        refs = [x for x in range(s // 64 * 64, s + 1) if x % 4 != 3][-4:]
        assert got[s] == (len(refs), refs[0])


def test_the_watermark_ends_what_is_not_whole(spark, tmp_path):
    """A segment with a gap leaves when the watermark has passed it; its late pictures are dropped and make no new state."""
    order = [0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 2]
    got = state.run_available(state.reorder(_stream(spark, tmp_path, order), late="64 seconds"), str(tmp_path), allow_late=True).collect()
    first = sorted(r["seq"] for r in got if r["seg"] == 0)
    assert first == list(range(50)) and [r["n"] for r in sorted(got, key=lambda r: r["n"]) if r["seg"] == 0] == list(range(1, 51))


def test_late_rows_are_no_silent_loss(spark, tmp_path):
    with pytest.raises(state.LateRows) as e:
        state.run_available(state.reorder(_stream(spark, tmp_path, [3, 0, 1, 2], step=256), late="64 seconds"), str(tmp_path))
    assert e.value.count >= 512
    kept = state.run_available(state.reorder(state.open_stream(spark, f"{tmp_path}/in/", files_per_batch=1), late="2000 seconds"), str(tmp_path))
    assert kept.count() == 1024


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    state.with_rocks(spark)
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("seed", [None, 5])
def test_resequence_in_any_order(spark, tmp_path, rocks, seed):
    """All rows come out, by number within each batch's output, and at the end nothing is held."""
    order, told = [3, 0, 1, 2], []
    if seed is not None:
        order = list(range(9))
        random.Random(seed).shuffle(order)
    rows = _stream(spark, tmp_path, order, step=60).select((F.col("seq") % 3).alias("stream"), F.floor(F.col("seq") / 3).alias("seq"), F.col("poc").alias("value"))
    got = state.run_available(state.resequence(rows), str(tmp_path), progress=told).collect()
    n = 60 * len(order)
    assert sorted((r["stream"], r["seq"]) for r in got) == sorted((i % 3, i // 3) for i in range(n))
    assert all(r["value"] == (k := r["seq"] * 3 + r["stream"]) * 2 + (k * 5 % 8) * 4 for r in got)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in told if p["stateOperators"]]
    assert held[-1] <= 3 * 2 and max(held) <= n, "what is due, and no row that went out"


def test_resequence_passes_over_what_stays_away(spark, tmp_path, rocks):
    rows = _stream(spark, tmp_path, [0, 2, 3], step=30).select(F.lit(0).alias("stream"), "seq", F.col("poc").alias("value"))
    first = state.run_available(state.resequence(rows), str(tmp_path)).collect()
    assert sorted(r["seq"] for r in first) == list(range(30)), "the rest waits for number 30"
    rows = state.open_stream(spark, f"{tmp_path}/in/").select(F.lit(0).alias("stream"), "seq", F.col("poc").alias("value"))
    out = state.resequence(rows, wait_ms=1).writeStream.option("checkpointLocation", f"{tmp_path}/log").trigger(processingTime="1 second").format("parquet").start(f"{tmp_path}/out")
    try:
        for _ in range(30):  # a stream that goes on: its timer ends in a later batch
            time.sleep(1)
            later = sorted(r["seq"] for r in spark.read.schema("stream long, seq long, value long").parquet(f"{tmp_path}/out").collect()) if (tmp_path / "out").exists() else []
            if len(later) == 90 or out.exception():
                break
    finally:
        out.stop()
    assert later == [*range(30), *range(60, 120)]
