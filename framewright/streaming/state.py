"""Stateful operators on streams of pictures, which may come in any order.

Segments: state is kept for each segment of a stream, a barrier that no picture
crosses. Its pictures wait, SEGMENT at most, until all are there or the watermark has
passed its end; then they are taken in order and the state is removed. How late a picture may come
has to be said; what comes later is dropped by Spark, counted, and a failure unless allowed.

Sequences (``resequence``): rows of a stream go out by number, whatever their order of arrival and
without a watermark, so that none is ever dropped. Held are only those ahead of the one that
is due; a number that stays away for too long is passed over when its timer ends.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Pictures of a segment.
SEGMENT = 64
#: Event time of the first picture in ms: a watermark begins at 0, and what is not after it counts as late.
_START = 86_400_000


def open_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A table as a stream of its files, so many in a batch: what a reader is ahead of its consumer is bounded."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path if path.endswith("/") else f"{path}*")


class LateRows(RuntimeError):
    """Rows came after the watermark and were dropped; ``count`` of them."""

    def __init__(self, count: int):
        super().__init__(f"{count} rows came later than was allowed for")
        self.count = count


def run_available(stream: DataFrame, folder: str, mode: str = "append", allow_late: bool = False, progress: list | None = None) -> DataFrame:
    """Runs a stream over what there is, into Parquet in the shared folder, and reads that.

    Raises LateRows if the watermark has dropped any, unless ``allow_late``. ``progress`` gets what
    Spark tells of each batch.
    """
    spark, where = stream.sparkSession, f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "100000")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}-log").trigger(availableNow=True).format("parquet").start(where)
    q.awaitTermination()
    told = [json.loads(p.json) for p in q.recentProgress]
    if progress is not None:
        progress.extend(told)
    late = sum(op.get("numRowsDroppedByWatermark", 0) for p in told for op in p["stateOperators"])
    if late and not allow_late:
        raise LateRows(late)
    return spark.read.schema(stream.schema).parquet(where)


def by_segment(stream: DataFrame, value: str, late: str, emit: Callable[[int, list[tuple[int, int]]], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``emit`` makes of each segment's pictures (seq, value), in order of seq, once the segment has ended.

    ``stream`` has seg, seq and ``value``; a picture's event time is a second for each
    seq, and ``late`` is how far behind the latest a picture may come.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seg, held = int(key[0]), dict(zip(*state.get, strict=True)) if state.exists else {}
        for part in parts:
            held |= dict(zip(part["seq"].tolist(), part["value"].tolist(), strict=True))
        if state.hasTimedOut or len(held) >= SEGMENT:
            if state.exists:
                state.remove()
            yield pd.DataFrame(emit(seg, sorted(held.items())), columns=names)
            return
        state.update((list(held), list(held.values())))
        end = _START + (seg * SEGMENT + SEGMENT - 1) * 1000 + 1
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    timed = stream.select("seg", "seq", F.col(value).cast("long").alias("value"), F.timestamp_millis(_START + F.col("seq") * 1000).alias("time"))
    return timed.withWatermark("time", late).groupBy("seg").applyInPandasWithState(step, schema, "seqs array<long>, held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def reorder(stream: DataFrame, late: str) -> DataFrame:
    """(seg, seq, poc, n): the pictures of each segment in display order, numbered."""

    def emit(seg: int, rows: list[tuple[int, int]]) -> list[tuple]:
        return [(seg, seq, poc, n + 1) for n, (poc, seq) in enumerate(sorted((poc, seq) for seq, poc in rows))]

    return by_segment(stream, "poc", late, emit, "seg long, seq long, poc long, n long")


def reference_buffer(stream: DataFrame, late: str, capacity: int = 4) -> DataFrame:
    """(seq, held, oldest): the references held after each picture; the oldest goes when there are more than ``capacity``."""

    def emit(seg: int, rows: list[tuple[int, int]]) -> list[tuple]:
        refs: list[int] = []
        out = []
        for seq, is_ref in rows:
            refs = [*refs, seq][-capacity:] if is_ref else refs
            if refs:
                out.append((seq, len(refs), refs[0]))
        return out

    return by_segment(stream, "is_ref", late, emit, "seq long, held long, oldest long")


def late_windows(stream: DataFrame, time: str, key: str, width: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Counts in windows of time; a window is told once the watermark has passed it, and rows that come later are dropped."""
    windows = stream.withWatermark(time, late).groupBy(key, F.window(time, width).alias("w")).agg(F.count("*").alias("frames"))
    return windows.select(key, F.col("w.start").alias("start"), "frames")


class Resequencer(StatefulProcessor):
    """State of a stream: the number that is due, rows ahead of it by number, and whether a timer runs.

    ``wait_ms`` is how long the due number may stay away while others wait.
    """

    def __init__(self, start: int, wait_ms: int | None):
        self.start, self.wait_ms = start, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "seq long, since long, armed boolean")
        self.held = handle.getMapState("held", "seq long", "value long")

    def _out(self, key: tuple, due: int, rows: list[tuple[int, int]], timer, armed: bool, since: int) -> Iterator[pd.DataFrame]:
        """Rows (number, value) from the due one on, and those held that follow."""
        out, first = [], due
        for seq, value in rows:
            if seq == due:
                out.append((seq, value))
                due += 1
            else:
                self.held.updateValue((seq,), (value,))
            due = self._follow(due, out)
        due = self._follow(due, out)
        if self.wait_ms is not None:
            since = timer.getCurrentProcessingTimeInMs() if due != first or not since else since
            if not armed and self._ahead() is not None:
                self.handle.registerTimer(since + self.wait_ms)
                armed = True
        self.due.update((due, since, armed))
        yield pd.DataFrame({"stream": [key[0]] * len(out), "seq": [x[0] for x in out], "value": [x[1] for x in out]}).astype("int64")

    def _follow(self, due: int, out: list[tuple[int, int]]) -> int:
        while self.held.containsKey((due,)):
            out.append((due, self.held.getValue((due,))[0]))
            self.held.removeKey((due,))
            due += 1
        return due

    def _ahead(self) -> int | None:
        return min((k[0] for k in self.held.keys()), default=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, since, armed = self.due.get() if self.due.exists() else (self.start, 0, False)
        found: dict[int, int] = {}
        for part in rows:
            found |= dict(zip(part["seq"].tolist(), part["value"].tolist(), strict=True))
        # what has gone out already comes again: once is enough
        yield from self._out(key, due, sorted(x for x in found.items() if x[0] >= due), timerValues, armed, since)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, since, _ = self.due.get()
        ahead = self._ahead()
        if ahead is not None and timerValues.getCurrentProcessingTimeInMs() >= since + self.wait_ms:
            due = ahead
        yield from self._out(key, due, [], timerValues, False, since)

    def close(self) -> None:
        pass


def resequence(stream: DataFrame, start: int = 0, wait_ms: int | None = None) -> DataFrame:
    """(stream, seq, value): rows of each stream in the order of their numbers, from ``start`` on without gaps; equal numbers count once.

    Needs the RocksDB state store. A row waits while one before it is missing, at most
    ``wait_ms`` of processing time if that is given.
    """
    rows = stream.select(F.col("stream").cast("long").alias("stream"), F.col("seq").cast("long").alias("seq"), F.col("value").cast("long").alias("value"))
    return rows.groupBy("stream").transformWithStateInPandas(statefulProcessor=Resequencer(start, wait_ms), outputStructType="stream long, seq long, value long", outputMode="Append", timeMode="None" if wait_ms is None else "ProcessingTime")


def with_rocks(spark: SparkSession) -> None:
    """State in RocksDB from the next query on: transformWithState needs it, and state is not bounded by a task's memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
