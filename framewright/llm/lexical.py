"""Ranked lexical search: impact vectors in buckets of their length (norm).

A document is a vector of integer impacts over the terms of the items at hand, an item
a vector of ones. Vectors are dealt by norm into buckets, written once. By the Cauchy-Schwarz
inequality no score in a bucket exceeds the item's norm times the bucket's largest:
buckets below the k-th best score so far are not read. Inside a bucket, the coordinates of the
item's rarest terms bound a score from above (what they give, and the inequality or the largest impacts for the
rest); what may still reach the k-th best is scored exactly, in 64-bit integers.

Items are taken in blocks of about BLOCK_TERMS terms against all rows. Tasks send k rows
an item at most. Nothing is dealt by document content, so equal texts are no hot group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of a term stand, A-Z as small letters; all others are blanks. Those of UTF-8 beyond ASCII belong to terms.
BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: Terms of a block of items, about; what the driver and each task hold.
BLOCK_TERMS = 200_000
#: Vectors of a bucket, about.
BUCKET = 100_000
#: The buckets of largest norms that have this share of the vectors give the first k-th best scores.
HEAD = 1 / 32
#: So many coordinates, those of the largest weights, are looked at first.
FOCUS = 4
#: Room for rounding in bounds, which are doubles.
SLACK = 1 + 1e-9


def terms_of(text: bytes) -> list[bytes]:
    return text.lower().translate(BYTES).split()


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def item_terms(tests: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(no, item_id, terms): the different terms of each row, which has a number."""
    kind = tests.schema[id_col].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms_of(t))) for t in _texts(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    rows = tests.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(step, f"item_id {kind}, terms array<binary>")
    return materialize(found.select(F.monotonically_increasing_id().alias("no"), "item_id", "terms"), "items")


def count_vectors(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs): all terms of the text with repeats, and how often it holds those of the vocabulary (by number, ascending)."""
    shared, size = docs.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        for b in batches:
            n, codes = [], []
            for row, text in enumerate(_texts(b, "text")):
                terms = terms_of(text)
                n.append(len(terms))
                codes.append(np.array([number[t] for t in terms if t in number], np.int64) + row * size)
            pairs, tfs = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(n) + 1, dtype=np.int64) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pairs % max(size, 1), tfs)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(step, "doc_id long, n long, terms array<int>, tfs array<int>")


class Impacts:
    """Weights of the vocabulary and the lengths' share: what turns counts into impacts."""

    def __init__(self, rows: int, total: int, df: np.ndarray):
        self.rows, self.total = rows, max(total, 1)
        self.w = np.array([math.floor(1000 * math.log((2 * rows + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def of(self, terms: np.ndarray, tfs: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n has an entry for each term."""
        m = 10 + 90 * n * self.rows // self.total
        return self.w[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m))


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of each term, terms, counts, and n of each term's row."""
    lists = b.column("terms")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), sizes)
    return rows, lists.flatten().to_numpy(), b.column("tfs").flatten().to_numpy().astype(np.int64), b.column("n").to_numpy()[rows]


def with_norms(vectors: DataFrame, impacts: Impacts) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, terms, tfs, n = _flat(b)
            squares = impacts.of(terms, tfs, n).astype(np.float64) ** 2
            norm = np.sqrt(np.bincount(rows, squares, b.num_rows))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(norm)], [*b.schema.names, "norm"])

    return vectors.mapInArrow(step, "doc_id long, n long, terms array<int>, tfs array<int>, norm double")


class Best:
    """The k best (score, doc_id) of an item so far; ids ascend in ties, null ids come last."""

    def __init__(self, k: int, least: int):
        self.k, self.floor = k, max(least, 1)
        self.scores, self.ids, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        return max(self.floor, int(self.scores[-1])) if len(self.scores) == self.k else self.floor

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        good = scores >= self.least
        scores, ids, none = (np.concatenate([x, y[good]]) for x, y in ((self.scores, scores), (self.ids, ids), (self.none, none)))
        if len(scores) > self.k:
            good = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids, none = scores[good], ids[good], none[good]
        order = np.lexsort((ids, none, -scores))[: self.k]
        self.scores, self.ids, self.none = scores[order], ids[order], none[order]


def _search_bucket(norm: np.ndarray, rows: np.ndarray, terms: np.ndarray, impact: np.ndarray, items: list[np.ndarray], weights: np.ndarray, best: list[Best], ids: np.ndarray, none: np.ndarray) -> None:
    """One batch of a bucket, norms descending, against all items."""
    alive = [q for q, own in enumerate(items) if len(own) and math.sqrt(len(own)) * norm[0] * SLACK >= best[q].least]
    if not alive:
        return
    order = np.argsort(terms, kind="stable")
    terms, rows, impact = terms[order], rows[order], impact[order]
    starts = np.searchsorted(terms, np.arange(len(weights) + 1))
    held = np.flatnonzero(np.diff(starts))
    most = np.zeros(len(weights), np.int64)
    most[held] = np.maximum.reduceat(impact, starts[held])
    for q in alive:
        own = items[q][most[items[q]] > 0]
        if not len(own):
            continue
        own = own[np.argsort(-weights[own], kind="stable")]
        focus, rest = own[:FOCUS], own[FOCUS:]
        first, squares = np.zeros(len(norm), np.int64), np.zeros(len(norm))
        for t in focus:
            at, x = rows[starts[t] : starts[t + 1]], impact[starts[t] : starts[t + 1]]
            first[at] += x
            squares[at] += x.astype(np.float64) ** 2
        other = np.minimum(math.sqrt(len(rest)) * np.sqrt(np.maximum(norm**2 * SLACK - squares, 0)), float(most[rest].sum()))
        may = (first + other) * SLACK + 1 >= best[q].least
        if may.any():
            scores = first
            for t in rest:
                at = rows[starts[t] : starts[t + 1]]
                scores[at] += impact[starts[t] : starts[t + 1]]
            may &= scores > 0
            best[q].add(scores[may], ids[may], none[may])


def best_of(buckets: DataFrame, items: list[np.ndarray], impacts: Impacts, k: int, least: list[int]) -> DataFrame:
    """(q, doc_id, score): for each item by number, the k best that each task has found and that reach ``least``."""
    shared = buckets.sparkSession.sparkContext.broadcast((items, impacts, least))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, impacts, least = shared.value
        best = [Best(k, x) for x in least]
        for b in batches:
            if not b.num_rows:
                continue
            b = b.take(pa.array(np.argsort(-b.column("norm").to_numpy(), kind="stable")))
            rows, terms, tfs, n = _flat(b)
            ids = b.column("doc_id")
            _search_bucket(b.column("norm").to_numpy(), rows, terms, impacts.of(terms, tfs, n), items, impacts.w, best, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        for q, x in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x.ids), q, np.int64)), pa.array(x.ids, mask=x.none), pa.array(x.scores)], ["q", "doc_id", "score"])

    return buckets.drop("bucket").mapInArrow(step, "q long, doc_id long, score long")


def _ranked(found: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, tests: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", test_id: str = "item_id", test_text: str = "text", block_terms: int = BLOCK_TERMS, bucket: int = BUCKET) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of tests the k rows of docs of highest score above 0, all if fewer.

    Equal scores rank by ascending doc_id, null ids last. Ids of docs are whole numbers;
    repeated rows and ids of either table are rows of their own. Null and empty texts
    have no terms: as items they have no rows, as documents they count in nothing. Empty tables give no rows.
    No other column than these is read, so that names can't clash.
    """
    items = item_terms(tests, test_id, test_text)
    total = items.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(total / block_terms))
    mine = [F.pmod(F.xxhash64("no"), F.lit(blocks)) == i for i in range(blocks)]
    found = [x for block in mine if (x := _search_block(docs, items.where(block), k, id_col, text_col, bucket)) is not None]
    if not found:
        return items.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return reduce(DataFrame.union, found)


def _search_block(docs: DataFrame, items: DataFrame, k: int, id_col: str, text_col: str, bucket: int) -> DataFrame | None:
    asked = [(r["no"], [bytes(t) for t in r["terms"]]) for r in items.select("no", "terms").orderBy("no").collect()]
    vocabulary = sorted({t for _, terms in asked for t in terms})
    if not vocabulary:
        return None
    number = {t: i for i, t in enumerate(vocabulary)}
    own = [np.array([number[t] for t in terms], np.int64) for _, terms in asked]
    vectors = materialize(count_vectors(docs, vocabulary, id_col, text_col), "vectors")
    sums = vectors.agg(F.count_if(F.col("n") > 0).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(F.size("terms") > 0).alias("held")).first()
    if not sums["held"]:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    impacts = Impacts(sums["rows"], sums["total"], df)
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(sums["held"] / bucket))
    dealt = with_norms(vectors.where("size(terms) > 0"), impacts).repartitionByRange(parts, F.desc("norm"), F.xxhash64("doc_id", "n"))
    buckets = materialize(dealt.withColumn("bucket", F.spark_partition_id()), "buckets", "bucket")
    sizes = sorted(((r["norm"], r["n"], r["bucket"]) for r in buckets.groupBy("bucket").agg(F.max("norm").alias("norm"), F.count("*").alias("n")).collect()), reverse=True)
    head, n = [], 0
    for _, rows, b in sizes:
        if n < max(HEAD * sums["held"], k):
            head.append(b)
            n += rows
    least = [0] * len(own)
    for r in _ranked(best_of(buckets.where(F.col("bucket").isin(head)), own, impacts, k, least), "q", k).where(F.col("rank") == k).collect():
        least[r["q"]] = r["score"]
    reach = [b for norm, _, b in sizes if any(len(x) and math.sqrt(len(x)) * norm * SLACK >= max(1, y) for x, y in zip(own, least, strict=True))]
    best = _ranked(best_of(buckets.where(F.col("bucket").isin(reach)), own, impacts, k, least), "q", k)
    names = items.select("no", "item_id").join(spark.createDataFrame([(no, q) for q, (no, _) in enumerate(asked)], "no long, q long"), "no")
    return best.join(names, "q").select("item_id", "rank", "doc_id", "score")
