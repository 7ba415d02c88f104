"""Mixing sources to target weights by subset-sum budget fitting.

Per source, the histogram of exact document sizes says all that the fit needs: a
proportional share of every size comes first, what is left over at one size being carried to the next
smaller one, up to twice the longest document below the budget; bounded-knapsack
dynamic programming over the documents that are left fills the rest. Which
documents of a size are taken follows from a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Words are runs of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Where a target isn't met yet, so many of a source's smallest documents are chosen anew.
FREE = 64
#: A table of so many sources is broadcast; beyond, it is joined by shuffle.
SMALL = 50_000
#: Documents of one size are counted by so many ranges of their hash.
SLOTS = 1024


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> list[float]:
    """Target of each source, in the order given (code points, null last): weighted shares of all words, none above ``most`` times its own; the excess goes to the others by weight."""
    size = np.array([n for _, n in sizes], float)
    weight = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    out, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while free.any():
        left = size.sum() - out[~free].sum()
        out[free] = left * weight[free] / weight[free].sum()
        over = free & (out > most * size)
        if not over.any():
            break
        out[over] = most * size[over]
        free &= ~over
    return out.tolist()


def knapsack(size: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take, so that the sum is the largest that is no more than the budget."""
    took = np.zeros(len(size), np.int64)
    order = np.argsort(-size, kind="stable")
    budget = int(min(budget, (size * count).sum()))
    last = np.full(budget + 1, -1, np.int32)  # the size that reached a sum first
    last[0] = len(size)
    for i in order:
        left, s = int(count[i]), int(size[i])
        if not 0 < s <= budget or left <= 0:
            continue
        used = np.zeros(budget + 1, np.int32)
        for low in range(s, budget + 1, s):  # sums that one more of this size reaches, one stride at a time
            now = slice(low, min(low + s, budget + 1))
            back = slice(low - s, low - s + now.stop - now.start)
            new = (last[now] < 0) & (last[back] >= 0) & (used[back] < left)
            if new.any():
                last[now] = np.where(new, i, last[now])
                used[now] = np.where(new, used[back] + 1, used[now])
        if last[budget] >= 0:
            break
    at = int(np.flatnonzero(last >= 0)[-1])
    while at > 0:
        took[last[at]] += 1
        at -= int(size[last[at]])
    return took


def fit(size: np.ndarray, count: np.ndarray, target: float, most: int = 3) -> np.ndarray:
    """Copies of each size in all, at most ``most`` of each document, whose sum comes next to the target.

    Whole rounds over all documents first, then a proportional share of every size,
    then the fit of what is left; where once more of each is too little, other
    documents are taken again, and at last the smallest are chosen anew.
    """
    total = int((size * count).sum())
    if total == 0:
        return np.zeros(len(size), np.int64)
    rounds, rest = divmod(round(target), total)
    rounds = min(rounds, most)
    copies = rounds * count
    aim = max(0, rest - 2 * int(size.max()))  # leaves the fit some choice
    if rounds < most and aim:
        due = 0  # words of the share so far, times total
        for i in np.argsort(-size, kind="stable"):
            if size[i] > 0:
                due += int(size[i]) * int(count[i]) * aim
                n = min(int(count[i]), due // (total * int(size[i])))
                copies[i] += n
                due -= n * int(size[i]) * total
    for limit in ((rounds + 1) * count, most * count):
        gap = round(target) - int((copies * size).sum())
        if gap > 0:
            copies = copies + knapsack(size, np.where(size > 0, np.minimum(limit, most * count) - copies, 0), gap)
    gap = round(target) - int((copies * size).sum())
    if gap > 0:  # the smallest documents are free again
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        freed = np.zeros(len(size), np.int64)
        freed[order] = np.diff(np.minimum(np.cumsum(count[order]), FREE), prepend=0)
        base = copies - freed * (copies // np.maximum(count, 1))
        other = base + knapsack(size, np.where(size > 0, most * count - base, 0), round(target) - int((base * size).sum()))
        copies = other if (other * size).sum() > (copies * size).sum() else copies
    return np.where(size > 0, copies, 0)


def source_targets(by_source: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(src, source_size, target) of (src, source_size), as targets() has them, for any number of sources.

    Sources are ranked by ranges of their order; who is held at ``most`` times its
    size follows from the words a weight of 1 gets, which a few sums settle.
    """
    n = int(by_source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(by_source.repartitionByRange(n, "src").withColumn("part", F.spark_partition_id()), "ranged")
    ends = ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # one row a range
    before = np.cumsum([0] + [r["n"] for r in ends])[:-1].tolist() if ends else []
    base = F.create_map(*[F.lit(x) for r, b in zip(ends, before, strict=True) for x in (r["part"], b)]) if ends else F.create_map(F.lit(0), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("src")) - 1 + F.element_at(base, F.col("part"))
    ranked = ranged.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))).select("src", "source_size", "w")
    ranked = materialize(ranked, "ranked")
    high, share = most * F.col("source_size"), None
    while True:
        free = F.lit(True) if share is None else F.lit(share) * F.col("w") <= high
        total, held, w = ranked.agg(F.sum(F.col("source_size").cast("double")), F.sum(F.when(free, F.lit(0.0)).otherwise(high)), F.sum(F.when(free, F.col("w")))).first()
        now = ((total or 0.0) - (held or 0.0)) / w if w else share
        if not w or (share is not None and now <= share * (1 + 1e-12)):  # it only grows
            break
        share = now
    share = F.lit(share if share is not None else 0.0) * F.col("w")
    return ranked.select("src", "source_size", F.least(share, high.cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 10, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, text_hash, size, source_size, target, times, taken) of each row: its words, those of its source, the source's target, how often the mix takes the row, and the words it takes.

    A null text has size 0; documents of size 0 are taken 0 times. Sources are
    ranked by code point, null last. Rows that repeat count each, and among rows of
    equal id and text it is the number of those taken that is defined. An empty
    table gives no rows; other columns of docs are not read. ``most`` is a whole
    number at least 1. apply_mix makes rows of it.
    """
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rank = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit(seed))
    slot = F.shiftrightunsigned(rank, 54)
    rows = materialize(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("src"), size.alias("size"), rank.alias("rank"), slot.alias("slot"), F.col(f"`{text_col}`").alias("text")).select("id", "src", "size", "rank", "slot", F.xxhash64("text").alias("text_hash")), "sizes")
    rows = rows.withColumn("src", F.struct(F.col("src").isNull().alias("none"), F.coalesce("src", F.lit("")).alias("name")))
    slots = materialize(rows.groupBy("src", "size", "slot").agg(F.count("*").alias("n")), "slots")
    plan = materialize(source_targets(slots.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")), weights, most), "targets")
    hint = F.broadcast if plan.count() <= SMALL else (lambda x: x)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        rounds, extra = np.divmod(fit(group["size"].to_numpy(), group["n"].to_numpy(), float(group["target"].iloc[0]), int(most)), group["n"].to_numpy())
        return pd.DataFrame({"none": group["none"], "name": group["name"], "size": group["size"], "source_size": group["source_size"], "target": group["target"], "rounds": rounds, "extra": extra})

    # one row for each source and size: no group is larger than the number of different sizes
    sizes = slots.groupBy("src", "size").agg(F.sum("n").alias("n")).join(hint(plan), "src").select("src.none", "src.name", "size", "n", "source_size", "target")
    fits = sizes.groupBy("none", "name").applyInPandas(one, "none boolean, name string, size long, source_size long, target double, rounds long, extra long")
    fits = materialize(fits.select(F.struct("none", "name").alias("src"), "size", "source_size", "target", "rounds", "extra"), "fits")
    # of the documents of a size that are taken once more than the others, whole hash slots go first; in the slot where they end, rows are ranked
    run = Window.partitionBy("src", "size").orderBy("slot")
    slots = slots.withColumn("before", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    slots = slots.join(fits, ["src", "size"]).select("src", "size", "slot", "source_size", "target", "rounds", F.least(F.greatest(F.col("extra") - F.col("before"), F.lit(0)), F.col("n")).alias("want"), "n")
    rows = rows.join(slots, ["src", "size", "slot"])
    cut = (F.col("want") > 0) & (F.col("want") < F.col("n"))
    cols = ["id", "text_hash", "size", "source_size", "target"]
    whole = rows.where(~cut).select(*cols, (F.col("rounds") + (F.col("want") > 0).cast("long")).alias("times"))
    order = Window.partitionBy("src", "size", "slot").orderBy("rank", "id", "text_hash")
    partly = rows.where(cut).withColumn("r", F.row_number().over(order)).select(*cols, (F.col("rounds") + (F.col("r") <= F.col("want")).cast("long")).alias("times"))
    return whole.union(partly).select(*cols, "times", (F.col("times") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs.

    Rows of equal id and text are told apart by their number only.
    """
    number = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy(F.lit(0)))
    times = mixed.select(F.col("id").alias("__mix_id2"), F.col("text_hash").alias("__mix_hash2"), F.col("times").alias("__mix_times")).where("__mix_times > 0")
    times = times.withColumn("__mix_n2", number("__mix_id2", "__mix_hash2"))
    own = docs.withColumn("__mix_hash", F.xxhash64(F.col(f"`{text_col}`"))).withColumn("__mix_n", number(F.col(f"`{id_col}`"), F.col("__mix_hash")))
    both = own.join(times, F.col(f"`{id_col}`").eqNullSafe(F.col("__mix_id2")) & (F.col("__mix_hash") == F.col("__mix_hash2")) & (F.col("__mix_n") == F.col("__mix_n2")))
    return both.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_times").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
