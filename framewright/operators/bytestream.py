"""Byte streams that lie in chunks: start codes, the units between them, and the pictures that units make.

A chunk is a row (keys, order, bytes); a stream is the chunks of its keys in order. A
code may begin in one chunk and end in the next, so each chunk is searched
together with three bytes on either side, which the ordered scan hands on. Places and byte
sums are running sums over chunks, so that no step holds more of a stream than a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .scan import last_knowns, neighbour, ranged, row_number, running_sum, running_sums, settled, with_halo

#: Unit types of slices, and those that begin a picture where one has slices already.
SLICES, HEADS = (1, 5), (6, 7, 8, 9, 14, 15)
_CODE = "array<struct<at:long,len:int,first:int,second:int,upto:long,after:long>>"
_CODES = pa.list_(pa.struct([("at", pa.int64()), ("len", pa.int32()), ("first", pa.int32()), ("second", pa.int32()), ("upto", pa.int64()), ("after", pa.int64())]))


@F.pandas_udf(LongType())
def _byte_sum(data: pd.Series) -> pd.Series:
    return data.map(lambda x: int(np.frombuffer(x, np.uint8).sum(dtype=np.int64)))


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch with four others after each value, and where values begin."""
    joined = [x or b"" for x in column.to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(x) + 4 for x in joined])])
    return np.frombuffer(b"\xff\xff\xff\xff".join([*joined, b""]), np.uint8), starts


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """codes of each row of (before, bytes, after): those whose last byte lies in ``bytes``."""
    for b in batches:
        before, own, after = (b.column(c).cast(pa.binary()) for c in ("before", "bytes", "after"))
        whole = pa.array([x + y + z for x, y, z in zip(before.to_pylist(), own.to_pylist(), after.to_pylist(), strict=True)], pa.binary())
        data, starts = _padded(whole)
        begin = starts[:-1] + pa.compute.binary_length(before).to_numpy()
        end = begin + pa.compute.binary_length(own).to_numpy()
        last = np.flatnonzero((data[:-2] == 0) & (data[1:-1] == 0) & (data[2:] == 1)) + 2 if len(data) > 2 else np.zeros(0, int)
        row = np.searchsorted(starts, last, side="right") - 1
        inside = (last >= begin[row]) & (last < end[row])
        last, row = last[inside], row[inside]
        long = (last - 3 >= starts[row]) & (data[last - 3] == 0)
        sums = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
        stop = starts[row + 1] - 4
        byte = lambda i: np.where(last + i < stop, data[np.minimum(last + i, len(data) - 1)], -1)
        zero = sums[begin[row]]
        columns = [last + 1 - begin[row], 3 + long, byte(1), byte(2), sums[last] - zero, sums[last + 1] - zero]
        fields = pa.StructArray.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, ("int64", "int32", "int32", "int32", "int64", "int64"), strict=True)], fields=list(_CODES.value_type))
        offsets = np.concatenate([np.searchsorted(row, np.arange(b.num_rows)), [len(row)]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in b.schema.names if c not in ("before", "bytes", "after")], pa.ListArray.from_arrays(pa.array(offsets), fields).cast(_CODES)], [*[c for c in b.schema.names if c not in ("before", "bytes", "after")], "codes"])


def start_codes(chunks: DataFrame, keys: list[str], order: list[str], data: str) -> DataFrame:
    """keys, at (place behind the code), len (3 or 4), first and second (the bytes that follow, or -1), upto and after (sums of the stream's bytes before the code's last one, and with it).

    Null and empty chunks are as if they weren't there.
    """
    rows = chunks.select(*keys, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(data).cast("binary").alias("bytes")).where(F.octet_length("bytes") > 0)
    order = [f"_o{i}" for i in range(len(order))]
    rows = ranged(rows.withColumn("sum", _byte_sum("bytes")), keys, order)
    rows = running_sums(rows, keys, order, {"base": F.octet_length("bytes").cast("long"), "base_sum": F.col("sum")})
    rows = with_halo(rows, keys, order, F.substring("bytes", -3, 3), "_b", 3)
    rows = with_halo(rows, keys, order, F.substring("bytes", 1, 3), "_a", 3, step=1)
    join = lambda c: F.unhex(F.array_join(F.transform(c, F.hex), ""))
    before = F.substring(join("_b"), -3, 3)
    cut = rows.select(*keys, "base", "base_sum", before.alias("before"), "bytes", F.substring(join("_a"), 1, 3).alias("after"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields if f.name not in ("before", "bytes", "after"))
    found = cut.mapInArrow(_search, f"{kinds}, codes {_CODE}").select(*keys, "base", "base_sum", F.explode("codes").alias("c"))
    return found.select(*keys, (F.col("base") + F.col("c.at")).alias("at"), "c.len", "c.first", "c.second", (F.col("base_sum") + F.col("c.upto")).alias("upto"), (F.col("base_sum") + F.col("c.after")).alias("after"))


def units(chunks: DataFrame, keys: list[str], order: list[str], data: str) -> DataFrame:
    """keys, unit (from 1), pos, size, first, second, total: what lies between start codes; empty units go.

    ``total`` is the sum of a unit's bytes; second is -1 where it has one byte. Results keep _r.
    """
    codes = ranged(start_codes(chunks, keys, order, data), keys, ["at"])
    ends = chunks.groupBy(*keys).agg(F.sum(F.octet_length(F.col(data).cast("binary"))).alias("_size"), F.sum(_byte_sum(F.coalesce(F.col(data).cast("binary"), F.lit(b"")))).alias("_sum"))
    codes = neighbour(codes, keys, ["at"], F.struct((F.col("at") - F.col("len")).alias("end"), F.col("upto").alias("sum")), "next")
    ends = ends.select(*[F.col(k).alias(f"_k{k}") for k in keys], "_size", "_sum")
    same = F.lit(True)
    for k in keys:
        same = same & codes[k].eqNullSafe(ends[f"_k{k}"])
    found = codes.join(ends, same).withColumn("size", F.coalesce(F.col("next.end"), F.col("_size")) - F.col("at")).where("size > 0")
    found = row_number(found, keys, ["at"], "unit")
    total = F.coalesce(F.col("next.sum"), F.col("_sum")) - F.col("after")
    return settled(found.select(*keys, "_r", "unit", F.col("at").alias("pos"), "size", "first", F.when(F.col("size") > 1, F.col("second")).otherwise(-1).alias("second"), total.alias("total")))


def pictures(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, picture (from 1), first_unit, parts, bytes, is_key: units in groups.

    A group begins at a head, or at a slice whose first payload bit is set, that follows
    a slice of the group before.
    """
    kind = F.col("first").bitwiseAND(31)
    df = ranged(found, keys, ["unit"]).withColumn("slice", kind.isin(*SLICES)).withColumn("head", kind.isin(*HEADS))
    df = last_knowns(df, keys, ["unit"], {"_s": F.when(F.col("slice"), F.col("unit")), "_h": F.when(F.col("head"), F.col("unit"))})
    df = neighbour(df, keys, ["unit"], F.struct(F.coalesce("_s", F.lit(0)).alias("s"), F.coalesce("_h", F.lit(0)).alias("h")), "_before", step=-1)
    begins = F.col("_before").isNull() | ((F.col("_before.s") > F.col("_before.h")) & (F.col("head") | (F.col("slice") & (F.col("second") >= 128))))
    df = running_sum(df, keys, ["unit"], begins.cast("long"), "picture", inclusive=True)
    return df.groupBy(*keys, "picture").agg(F.min("unit").alias("first_unit"), F.count("*").alias("parts"), F.sum("size").alias("bytes"), F.bool_or(kind == 5).alias("is_key"))
