"""Ordered scans that no single task has to do alone.

A window over a whole stream puts the stream into one task. Here rows are dealt once
by ranges of their keys and order (``ranged``); Spark takes the bounds from a sample of the
data, so that ranges have about equally many rows however dense a stretch is, and
equal times are split by what breaks their ties. Windows run within a range, and what a range needs from
those before it comes from a table with a row for each range and key. Scans run over one
ranged table, in the same exchange; each asks twice for what it is given, so a long
chain of them is written in between (``settled``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

#: The range of a row; results keep it, so that scans can follow each other.
RANGE = "_r"


def ranged(df: DataFrame, keys: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """df and _r: rows dealt by ranges of keys and order and written once; so many ranges, or as Spark sees fit. ``order`` should tell all rows of a key apart."""
    if RANGE in df.columns:
        return df
    return materialize(df.repartitionByRange(*([ranges] if ranges else []), *keys, *order).withColumn(RANGE, F.spark_partition_id()), "ranged")


def settled(df: DataFrame) -> DataFrame:
    """What scans have made so far, written, with its ranges."""
    return materialize(df, "settled")


def _within(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys, RANGE).orderBy(*order)


def _between(keys: list[str]) -> Window:
    """Over a table with a row for each range, of which there are as many as shuffle partitions."""
    return Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)])).orderBy(RANGE)


def _join(df: DataFrame, ranges: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df and a column of its range; null keys are a key."""
    ranges = ranges.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, RANGE]], value)
    same = reduce(Column.__and__, [df[k].eqNullSafe(ranges[f"_k_{k}"]) for k in keys], df[RANGE] == ranges[f"_k_{RANGE}"])
    return df.join(ranges, same, "left").drop(*[f"_k_{k}" for k in [*keys, RANGE]])


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], inclusive: bool = False) -> DataFrame:
    """df and a column for each of ``values``: its sum over the rows before (or up to) each row of its keys, in the order given. One scan for all."""
    df = ranged(df, keys, order).withColumn("_v", F.struct(*[v.alias(n) for n, v in values.items()]))
    totals = df.groupBy(*keys, RANGE).agg(F.struct(*[F.sum(F.col("_v")[n]).alias(n) for n in values]).alias("_t"))
    earlier = _between(keys).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_b", F.struct(*[F.sum(F.col("_t")[n]).over(earlier).alias(n) for n in values]))
    upto = _within(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    none = lambda c: F.coalesce(c, F.lit(0))
    sums = {n: none(F.col("_b")[n]) + none(F.sum(F.col("_v")[n]).over(upto)) - (F.lit(0) if inclusive else none(F.col("_v")[n])) for n in values}
    return _join(df, before, keys, "_b").withColumns(sums).drop("_v", "_b")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, inclusive: bool = False) -> DataFrame:
    """df and ``out``: the sum of ``value`` over the rows before (or up to) each row of its keys, in the order given."""
    return running_sums(df, keys, order, {out: value}, inclusive)


def row_number(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """df and ``out``: the number of each row in the order of its keys, from 1."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), out, inclusive=True)


def last_knowns(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """df and a column for each of ``values``: its last one that is not null up to each row. One scan for all."""
    df = ranged(df, keys, order).withColumn("_v", F.struct(*[v.alias(n) for n, v in values.items()]))
    at = lambda n: F.when(F.col("_v")[n].isNotNull(), F.struct(*order))
    lasts = df.groupBy(*keys, RANGE).agg(F.struct(*[F.max_by(F.col("_v")[n], at(n)).alias(n) for n in values]).alias("_l"))
    earlier = _between(keys).rowsBetween(Window.unboundedPreceding, -1)
    before = lasts.withColumn("_b", F.struct(*[F.last(F.col("_l")[n], ignorenulls=True).over(earlier).alias(n) for n in values]))
    upto = _within(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    found = {n: F.coalesce(F.last(F.col("_v")[n], ignorenulls=True).over(upto), F.col("_b")[n]) for n in values}
    return _join(df, before, keys, "_b").withColumns(found).drop("_v", "_b")


def last_known(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """df and ``out``: the last value that is not null up to each row."""
    return last_knowns(df, keys, order, {out: value})


def neighbour(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, step: int = 1) -> DataFrame:
    """df and ``out``: the value of the next row (step 1) or of the one before (step -1); null at the end."""
    df = ranged(df, keys, order).withColumn("_v", value)
    beside = F.lead if step > 0 else F.lag
    edges = df.groupBy(*keys, RANGE).agg((F.min_by if step > 0 else F.max_by)(F.struct("_v"), F.struct(*order)).alias("_e"))
    beyond = edges.withColumn("_n", beside("_e").over(_between(keys)))
    own = beside(F.struct("_v")).over(_within(keys, order))
    return _join(df, beyond, keys, "_n").withColumn(out, F.coalesce(own, F.col("_n"))["_v"]).drop("_v", "_n")


def with_halo(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, rows: int, step: int = -1) -> DataFrame:
    """df and ``out``: the values of up to ``rows`` rows before each row (step -1) or after it (step 1), in order, over the ends of ranges too.

    A range hands on its last (or first) rows; one with fewer rows hands on what it got as well.
    """
    df = ranged(df, keys, order).withColumn("_v", F.struct(value.alias("v")))
    at = F.struct(*order).alias("_at")
    kept = df.select(*keys, RANGE, at, "_v").withColumn("_i", F.row_number().over(Window.partitionBy(*keys, RANGE).orderBy(F.col("_at").asc() if step > 0 else F.col("_at").desc()))).where(F.col("_i") <= rows)
    edges = kept.groupBy(*keys, RANGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias("_e"))
    frame = (1, rows) if step > 0 else (-rows, -1)
    near = F.flatten(F.collect_list("_e").over(_between(keys).rowsBetween(*frame)))
    beyond = edges.withColumn("_n", F.slice(near, 1, rows) if step > 0 else F.slice(near, F.greatest(F.size(near) - rows, F.lit(0)) + 1, F.lit(rows)))
    own = F.collect_list("_v").over(_within(keys, order).rowsBetween(*frame))
    df = _join(df, beyond, keys, "_n").withColumn("_o", own)
    more = F.greatest(F.lit(rows) - F.size("_o"), F.lit(0))
    there = F.coalesce("_n", F.array().cast(f"array<{df.schema['_v'].dataType.simpleString()}>"))
    both = F.concat("_o", F.slice(there, F.lit(1), more)) if step > 0 else F.concat(F.slice(there, F.greatest(F.size(there) - more, F.lit(0)) + 1, more), F.col("_o"))
    return df.withColumn(out, F.transform(both, lambda x: x["v"])).drop("_v", "_n", "_o")
