"""Connected components of a table of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, sized


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node that can be reached; only nodes with a link.

    Alternates large-star and small-star steps until the links no longer change:
    a number of rounds that grows with the logarithm of the longest path. Each
    round groups links by node; its table is checkpointed. A node's links shrink
    to stars, so that no round holds more links than the first; tasks are as many as links need. Loops and nulls
    are left out.
    """
    edges = checkpoint(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    rows = edges.count()
    edges, state = sized(edges, rows), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sized(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), rows).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = checkpoint(sized(sized(small.union(least.select("u", F.col("m").alias("v"))), 2 * rows).distinct(), rows))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
