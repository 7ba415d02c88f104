"""Matching two ordered tables: as-of joins and comparison by ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import last_known


def as_of(left: DataFrame, right: DataFrame, keys: list[str], on: str, value: Column, out: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """left and ``out``: ``value`` of the last row of right with the same keys whose ``on`` is no later.

    A union and a scan instead of an inequality join: rows of right come before
    rows of left of the same time. ``ties`` are columns of left that tell rows of a time apart.
    """
    marked = right.select(*keys, F.col(on), value.alias("_value"), F.lit(0).alias("_side"))
    cols = [c for c in left.columns if c not in keys and c != on]
    rows = left.withColumn("_side", F.lit(1)).unionByName(marked, allowMissingColumns=True)
    found = last_known(rows, keys, [on, "_side", *ties], F.col("_value"), out)
    return found.where("_side = 1").select(*keys, on, *cols, out)


def ordinal_compare(left: DataFrame, right: DataFrame, ordinal: str, value: str) -> DataFrame:
    """ordinal, left_value, right_value, same: full outer by ordinal; a row without a partner differs."""
    a = left.select(ordinal, F.col(value).alias("left_value"), F.lit(True).alias("_a"))
    b = right.select(ordinal, F.col(value).alias("right_value"), F.lit(True).alias("_b"))
    both = a.join(b, ordinal, "full_outer")
    same = F.col("left_value").eqNullSafe(F.col("right_value")) & F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.select(ordinal, "left_value", "right_value", same.alias("same"))


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, run, value, n, first, last: runs of equal consecutive values (nulls are equal), numbered from 1."""
    from .scan import neighbour, running_sum

    marked = neighbour(df.withColumn("_x", F.struct(value)), keys, order, F.col("_x"), "_before", step=-1)
    marked = marked.withColumn("_new", F.when(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("_x")), 1).otherwise(0))
    runs = running_sum(marked, keys, order, F.col("_new").cast("long"), "run", inclusive=True)
    return runs.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))
