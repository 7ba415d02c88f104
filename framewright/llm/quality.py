"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Each word has a sparse index vector of signs, which follows from its hash; a
word's vector is the sum of the index vectors of the words around it in the whole
corpus. Words share ``BUCKETS`` rows by hash, so that the table has one size
whatever the corpus: a fixed width, at which rare words share a vector with others. A document is the mean and the spread of its words' vectors.
The network learns from a bounded sample of labelled documents; a temperature,
fitted on part of it that was kept apart, calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BUCKETS, DIM, WINDOW, SIGNS = 8192, 32, 2, 4
#: The network learns from so many labelled documents at most, taken by the hash of their id.
MAX_LABELLED = 20_000
#: Rows of the table in one record, and the ways in which tasks' tables are first added up.
_ROWS, _WAYS = 128, 64
_SLICE_BYTES = 2_000_000
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_cache: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("up", ())) < n:
        for name, base in (("up", _P), ("down", _PINV)):
            _cache[name] = np.cumprod(np.append(np.uint64(1), np.full(max(n, _SLICE_BYTES * 2), np.uint64(base))), dtype=np.uint64)
    return _cache["up"], _cache["down"]


def _classes() -> np.ndarray:
    """0 white space and control, 1 letter (all bytes of other scripts too), 2 digit, 3 other."""
    out = np.full(256, 3, np.uint8)
    out[:33] = 0
    out[128:] = 1
    out[48:58] = 2
    out[65:91] = out[97:123] = 1
    return out


_CLASS = _classes()


def tokens(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of the words in joined documents: runs of one class of bytes; all numbers are one word, and all words in capitals another."""
    kind = _CLASS[data]
    first = np.append(True, kind[1:] != kind[:-1])
    first[begin] = True
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(data)))
    own = kind[start] > 0
    upper = (data >= 65) & (data <= 90)
    caps = np.add.reduceat(upper, start, dtype=np.int64) == size
    low = np.where(upper, data + np.uint8(32), data).astype(np.uint64) + np.uint64(1)
    up, down = _powers(len(data))
    total = np.append(np.uint64(0), np.cumsum(low * up[: len(data)], dtype=np.uint64))
    h = (total[start + size] - total[start]) * down[start]
    h = np.where(kind[start] == 2, np.uint64(2), np.where(caps & (size > 1), np.uint64(1), h))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    doc = np.searchsorted(begin, start, side="right") - 1
    return bucket[own], doc[own]


def index_vectors(seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Places [bucket, SIGNS] and signs of the index vectors."""
    if "index" not in _cache:
        rng = np.random.default_rng(seed)
        place = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :SIGNS]
        _cache["index"] = place, np.where(rng.random((BUCKETS, SIGNS)) < 0.5, -1.0, 1.0)
    return _cache["index"]


def contexts(bucket: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Sums [BUCKETS, DIM] of the index vectors of the words within WINDOW of each word, in the same document."""
    place, sign = index_vectors()
    out = np.zeros(BUCKETS * DIM)
    for gap in range(1, WINDOW + 1):
        pair = np.flatnonzero(doc[gap:] == doc[:-gap])
        for word, near in ((bucket[pair], bucket[pair + gap]), (bucket[pair + gap], bucket[pair])):
            for s in range(SIGNS):
                out += np.bincount(word * DIM + place[near, s], weights=sign[near, s], minlength=BUCKETS * DIM)
    return out.reshape(BUCKETS, DIM)


def _joined(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents' indexes, where they begin, bytes) of slices of the texts that are not empty."""
    size = np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in texts], np.int64)
    slot = np.cumsum(size) // _SLICE_BYTES
    for s in np.unique(slot[size > 0]):
        own = np.flatnonzero((slot == s) & (size > 0))
        yield own, np.cumsum(size[own]) - size[own], np.frombuffer(b"".join(bytes(texts[int(i)].as_buffer()) for i in own), np.uint8)


def _added(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """Adds up the records of each row block; what is held is one table at most."""
    held: dict = {}
    for batch in batches:
        for k, block, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            at = (k if key == 0 else 0, block)
            v = np.frombuffer(values.as_buffer(), np.float64)
            held[at] = held[at] + v if at in held else v
    for (k, block), v in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([block], pa.int64()), pa.array([v.tobytes()], pa.binary())], ["way", "block", "sums"])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Table [BUCKETS, DIM] of unit word vectors over all texts. Tasks add up their own, and Spark adds those in two rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, way = None, TaskContext.get().partitionId() % _WAYS
        for batch in batches:
            for _, begin, data in _joined(batch.column(0)):
                one = contexts(*tokens(data, begin))
                total = one if total is None else total + one
        if total is not None:
            blocks = BUCKETS // _ROWS
            yield pa.RecordBatch.from_arrays([pa.array([way] * blocks, pa.int64()), pa.array(range(blocks), pa.int64()), pa.array([total[i * _ROWS : (i + 1) * _ROWS].tobytes() for i in range(blocks)], pa.binary())], ["way", "block", "sums"])

    schema = "way long, block long, sums binary"
    sums = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for key, cols in enumerate((("way", "block"), ("block",))):
        sums = sums.repartition(n, *cols).mapInArrow(lambda it, key=key: _added(it, key), schema)
    table = np.zeros((BUCKETS, DIM))
    for r in sums.collect():  # one table: BUCKETS rows
        table[r["block"] * _ROWS : (r["block"] + 1) * _ROWS] = np.frombuffer(r["sums"], np.float64).reshape(-1, DIM)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<float>): mean and spread of the vectors of each whole text's words, and its number of words. Null as an empty text: zeros."""
    id_type = docs.schema[id_col].dataType.simpleString()
    wide = 2 * DIM + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, wide), np.float32)
            for own, begin, data in _joined(batch.column(1)):
                bucket, doc = tokens(data, begin)
                n = np.bincount(doc, minlength=len(own)).astype(np.float64)
                some = np.maximum(n, 1)
                at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, int)
                has = n > 0
                for d in range(DIM):
                    v = vectors[bucket, d].astype(np.float64)
                    s, q = np.zeros(len(own)), np.zeros(len(own))
                    if len(at):
                        s[has], q[has] = np.add.reduceat(v, at), np.add.reduceat(v * v, at)
                    x[own, d] = s / some
                    x[own, DIM + d] = np.sqrt(np.maximum(q / some - (s / some) ** 2, 0))
                x[own, 2 * DIM] = np.log1p(n)
                x[own, 2 * DIM + 1] = np.log1p(np.diff(np.append(begin, len(data))) / some)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, wide), pa.int32()), pa.array(x.ravel()))], ["doc_id", "x"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, x array<float>")


class Network:
    """Two layers in numpy, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = x.mean(axis=0), x.std(axis=0) + 1e-6, 1.0
        z = self._scaled(x)
        hold = rng.random(len(z)) < 0.2
        if hold.sum() < 20 or len(set(y[~hold].tolist())) < 2:
            hold[:] = False
        a, b = z[~hold], y[~hold].astype(float)
        p = [rng.normal(0, (2 / a.shape[1]) ** 0.5, (a.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        for epoch in range(epochs):
            order = rng.permutation(len(a))
            for i in range(0, len(a), 128):
                q = order[i : i + 128]
                h = np.maximum(a[q] @ p[0] + p[1], 0)
                err = (_sigmoid(h @ p[2] + p[3]) - b[q]) / len(q)
                back = np.outer(err, p[2]) * (h > 0)
                grads, t = [a[q].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ err + 1e-4 * p[2], np.array([err.sum()])], t + 1
                rate = 3e-3 * (1 - epoch / epochs) * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
                for w, g, mm, vv in zip(p, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    w -= rate * mm / (np.sqrt(vv) + 1e-8)
        self.weights = p
        if hold.any():  # the temperature under which the rows kept apart are likeliest
            logit, c = self._logit(z[hold]), y[hold]
            loss = lambda s: -np.log(np.clip(np.where(c == 1, _sigmoid(logit / s), _sigmoid(-logit / s)), 1e-12, 1)).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 101), key=loss))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logit(self, z: np.ndarray) -> np.ndarray:
        w, b, w2, b2 = self.weights
        return np.maximum(z @ w + b, 0) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._logit(self._scaled(x)) / self.temperature)


class Constant:
    """Where labels are missing or all one: one score for all."""

    def __init__(self, value: float):
        self.value = value

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def train(features: DataFrame, labels: DataFrame, label_col: str, max_labelled: int = MAX_LABELLED, seed: int = 3) -> Network | Constant:
    """Learns from the rows of labels (doc_id and a 0/1 column, nulls left out) whose documents are in features."""
    rows = labels.select(F.col("doc_id").alias("l_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    rows = rows.orderBy(F.xxhash64("l_id", F.lit(seed)), "l_id", "y").limit(max_labelled)  # what reaches the driver is bounded by this
    got = rows.join(features, rows["l_id"] == features["doc_id"]).groupBy("l_id", "y").agg(F.min("x").alias("x")).collect()  # ids that repeat count once
    got = sorted(got, key=lambda r: (r["l_id"], r["y"], r["x"]))
    y = np.array([r["y"] for r in got], np.int64)
    if len(set(y.tolist())) < 2:
        return Constant(float(y[0]) if len(y) else 0.5)
    return Network(np.array([r["x"] for r in got], np.float64), y, seed=seed)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score double): how likely label 1 is for every whole text of docs.

    ``labels`` has doc_id and the label, only rows to learn from. Null and empty
    texts get the score of a document without words; with no labels, or one kind
    only, all scores are equal. Other columns are left out; an empty table gives no
    rows, and rows that repeat are scored each.
    """
    vectors = word_vectors(docs, text_col)
    features = materialize(pooled(docs, vectors, id_col, text_col), "pooled")
    model = train(features, labels, label_col, max_labelled)
    id_type = features.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x) if len(x) else np.zeros(0))], ["doc_id", "score"])

    return features.mapInArrow(run, f"doc_id {id_type}, score double")
