"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of its documents' tokens, and has a target weight. Each round
credits queue ``t`` with ``w_t / w_max`` quanta of ``quantum`` tokens and serves as many
whole quanta as its deficit counter covers; what is left stays on the counter. While
all queues last, every window holds the sources in the proportions of their weights, within a quantum;
a queue that is empty drops out, and the others go on by theirs. Without weights a
queue weighs what it holds, so that all drain in the same round.

The counters need no sequential pass. After ``r`` rounds queue ``t`` was served
``floor(r * w_t / w_max)`` quanta (or all it has), and the rest of that product is its deficit.
So quantum ``k`` of queue ``s`` goes out in round ``ceil((k + 1) * w_max / w_s)``
and its place in the output is the sum of what the queues were served before.
A task computes the deficits it starts with and goes on from there: they carry
over windows and over partitions, and no token is shuffled.

Windows are cuts of that stream every ``sequence_length`` tokens. The last,
partial window is cut into powers of two, so that nothing is padded.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Queues of their own go to so many of the largest sources; all others share one more queue, of the sum of their weights.
MAX_QUEUES = 4096
#: Weights are told apart to one part in so many.
SCALE = 1_000_000
#: The table of tasks and sources is broadcast up to so many rows (some 16 MB); beyond that it is joined by shuffle.
MAX_BROADCAST = 200_000
#: Ids of a text that names the special token are left to the tokenizer itself.
SPECIAL = "<|endoftext|>"
_SLICE_CHARS = 4_000_000
_encoders: dict = {}


def encoder(json_path: str, ranks_path: str, pattern: str):
    """text -> list of ids, equal to those of the tokenizer file ``json_path``.

    The rank file holds the same vocabulary for a quicker library. It is used for
    all texts but those that name a special token or that it refuses.
    """
    key = (json_path, ranks_path)
    if key not in _encoders:
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        quick = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        held: dict = {}

        def encode(text: str) -> list[int]:
            if SPECIAL not in text:
                try:
                    return quick.encode_ordinary(text)
                except BaseException as e:  # the library's own panic isn't an Exception
                    if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                        raise
            if "exact" not in held:  # few texts need it, and it is large
                held["exact"] = Tokenizer.from_file(json_path)
            return held["exact"].encode(text, add_special_tokens=False).ids

        _encoders[key] = encode
    return _encoders[key]


def tokenize(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, part, start, n, ids): a document's ids and ``end_id`` as little-endian uint16.

    ``part`` is the task's number and ``start`` the tokens that the task has seen
    of that source before. The table must be written before use (materialize), as
    both follow from how the input was split.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(json_path, ranks_path, pattern), {}, TaskContext.get().partitionId()
        for batch in batches:
            texts, at = batch.column(2), 0
            sources = batch.column(1).to_pylist()
            while at < len(sources):
                starts, sizes, ids, first, chars = [], [], [], at, 0
                while at < len(sources) and chars < _SLICE_CHARS:
                    text = texts[at].as_py() or ""
                    one = encode(text)
                    one.append(end_id)
                    ids.append(np.array(one, dtype="<u2").tobytes())
                    s = sources[at]
                    starts.append(seen.get(s, 0))
                    sizes.append(len(one))
                    seen[s] = starts[-1] + len(one)
                    chars += len(text) + 1
                    at += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), pa.array(sources[first:at], pa.string()), pa.array([part] * len(sizes), pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "part", "start", "n", "ids"])

    return rows.mapInArrow(run, f"doc_id {id_type}, source string, part long, start long, n long, ids binary")


class Schedule:
    """Deficit round-robin over queues of known length and weight, in closed form."""

    def __init__(self, totals: list[int], quantum: int, sequence_length: int, weights: list[float] | None = None):
        self.totals, self.quantum, self.length = totals, quantum, sequence_length
        self.quanta = [-(-n // quantum) for n in totals]
        top = max(weights or [1])
        #: What a round credits each queue with; a whole quantum costs ``most``.
        self.credit = [max(1, round(w / top * SCALE)) for w in weights] if weights else self.quanta
        self.most = max(self.credit, default=1)
        #: Products stay below 2**63, or whole numbers of any size are used.
        rounds = max((-(-q * self.most // c) for q, c in zip(self.quanta, self.credit, strict=True) if c), default=1)
        self.kind = np.int64 if (rounds + 1) * self.most < 1 << 62 else object
        self.windows, rest = divmod(sum(totals), sequence_length)
        ends, at = [], self.windows * sequence_length
        while rest:
            size = 1 << (rest.bit_length() - 1)
            at, rest = at + size, rest - size
            ends.append(at)
        #: Ends of the sequences after the last full window.
        self.tail = np.array(ends, dtype=np.int64)

    def position(self, queue: int | np.ndarray, k: np.ndarray) -> np.ndarray:
        """Where in the stream quanta ``k`` of a queue (or of a queue each) begin."""
        k = k.astype(self.kind)
        own = np.array(self.credit, self.kind)[queue]
        rounds = -((-(k + 1) * self.most) // own)
        place = k * self.quantum
        for t, (n, c) in enumerate(zip(self.totals, self.credit, strict=True)):
            served = np.minimum((rounds - (t > queue)) * c // self.most * self.quantum, n)
            place = place + np.where(queue == t, 0, served)
        return place.astype(np.int64)

    def deficits(self, rounds: int) -> list[float]:
        """Tokens that each queue is owed after so many rounds, while it lasts: under one quantum each."""
        return [(rounds * c % self.most) * self.quantum / self.most for c in self.credit]

    def sequence(self, place: np.ndarray) -> np.ndarray:
        """The sequence that a place in the stream is in."""
        return np.minimum(place // self.length, self.windows) + np.searchsorted(self.tail, place, side="right")

    def begin(self, sequence: np.ndarray) -> np.ndarray:
        """Where a sequence begins in the stream."""
        full = np.minimum(sequence, self.windows) * self.length
        return np.where(sequence > self.windows, self.tail[np.clip(sequence - self.windows - 1, 0, None)], full) if len(self.tail) else full

    def pieces(self, queue: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document's index, start in it, length, sequence, offset) of documents that lie at ``start`` in their queues."""
        q = self.quantum
        first, last = start // q, (start + size - 1) // q
        count = last - first + 1
        doc = np.repeat(np.arange(len(start)), count)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        place = self.position(queue[doc], k)
        a = np.maximum(start[doc], k * q)
        b = np.minimum(start[doc] + size[doc], (k + 1) * q)
        place = place + (a - k * q)
        a = a - start[doc]
        n = b - start[doc] - a
        # consecutive quanta that also follow each other in the stream are one stretch
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + n[:-1])
        at = np.flatnonzero(new)
        doc, a, place, n = doc[at], a[at], place[at], np.add.reduceat(n, at) if len(at) else n
        # cut at the ends of sequences
        seq = self.sequence(place)
        count = self.sequence(place + n - 1) - seq + 1
        j = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        doc, a, place, stop, seq = (np.repeat(x, count) for x in (doc, a, place, place + n, seq))
        seq = seq + j
        since = self.begin(seq)
        at = np.maximum(place, since)
        until = np.minimum(stop, self.begin(seq + 1)) if not len(self.tail) else np.where(seq >= self.windows + len(self.tail) - 1, stop, np.minimum(stop, self.begin(seq + 1)))
        return doc, a + at - place, until - at, seq, at - since


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, sequence_length: int = 1024, quantum: int = 64, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Mapping[str | None, float] | Sequence[float] | None = None) -> DataFrame:
    """Pack all documents into sequences: one row per piece.

    ``weights``: the target of each source (1 where there is none), or numbers that
    repeat over the sources in the order of code points, null last; above 0. Sources
    beyond the MAX_QUEUES largest share a queue and the sum of their weights.

    Returns doc_id, source, start, length, doc_tokens, sequence_id, offset, ids
    (little-endian uint32). A document is its ids and ``end_id``; a null text is
    an empty one; a null source is a queue of its own; rows that repeat are packed
    as often. An empty table gives no rows. Other columns are left out. Ids are below 65,536.
    """
    tokens = materialize(tokenize(docs, json_path, ranks_path, pattern, end_id, id_col, text_col, source_col), "tokens")
    id_type = tokens.schema["doc_id"].dataType.simpleString()
    parts = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    by_source = parts.groupBy("source").agg(F.sum("n").alias("n"))
    # at most MAX_QUEUES rows reach the driver: names and lengths of the queues
    top = by_source.orderBy(F.desc("n"), F.asc_nulls_last("source")).limit(MAX_QUEUES).collect()
    total, sources = by_source.agg(F.sum("n"), F.count("*")).first()
    named = sorted(((r["source"], r["n"]) for r in top), key=lambda x: (x[0] is None, x[0] or ""))
    totals = [n for _, n in named]
    more = sources - len(named)
    if more:
        totals.append(total - sum(totals))
    own = None
    if isinstance(weights, Mapping):
        own = [float(weights.get(s, 1)) for s, _ in named]
        rest = sum(float(w) for s, w in weights.items() if s not in {s for s, _ in named})
        own += [max(rest, 1.0)] if more else []
    elif weights:
        own = [float(weights[i % len(weights)]) for i in range(len(named))] + [more * sum(weights) / len(weights)] * bool(more)
    queue_of = tokens.sparkSession.createDataFrame([(s, i) for i, (s, _) in enumerate(named)], "q_source string, queue int")
    schedule = Schedule(totals, quantum, sequence_length, own)
    parts = parts.join(F.broadcast(queue_of), F.col("source").eqNullSafe(F.col("q_source")), "left").select("source", "part", F.coalesce("queue", F.lit(len(named))).alias("queue"), "n")
    # where a task's tokens of a source begin in their queue: by task, then by source, so that no window holds more than the tasks or a task's sources
    before = lambda w, *order: F.sum("n").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    tasks = parts.groupBy("queue", "part").agg(F.sum("n").alias("n")).select(F.col("queue").alias("t_queue"), F.col("part").alias("t_part"), before(Window.partitionBy("queue"), "part").alias("t_base"))
    base = parts.withColumn("base", before(Window.partitionBy("queue", "part"), "source")).join(tasks, (F.col("queue") == F.col("t_queue")) & (F.col("part") == F.col("t_part")))
    base = base.select(F.col("source").alias("b_source"), F.col("part").alias("b_part"), "queue", (F.col("base") + F.col("t_base")).alias("base"))
    small = base.count() <= MAX_BROADCAST
    base = F.broadcast(base) if small else base
    placed = tokens.join(base, (F.col("part") == F.col("b_part")) & F.col("source").eqNullSafe(F.col("b_source"))).select("doc_id", "source", "queue", (F.col("base") + F.col("start")).alias("start"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(4).to_numpy()
            edges = np.searchsorted(np.cumsum(n) // 1_000_000, np.arange(int(n.sum()) // 1_000_000 + 2))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi > lo:
                    yield from _cut(schedule, batch.slice(lo, hi - lo))

    return placed.mapInArrow(cut, f"doc_id {id_type}, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def _cut(schedule: Schedule, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = batch.column(4).to_numpy()
    doc, start, length, seq, off = schedule.pieces(batch.column(2).to_numpy(), batch.column(3).to_numpy(), size)
    ids = np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype="<u2").astype("<u4").tobytes()
    at = (np.cumsum(size) - size)[doc] + start
    # pieces are in the order of documents and cover them without gaps, so the ids need no copy
    offsets = np.append(at, at[-1] + length[-1]).astype(np.int32) * 4
    data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids)])
    take = pa.array(doc)
    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start), pa.array(length), pa.array(size[doc]), pa.array(seq), pa.array(off), data], ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
