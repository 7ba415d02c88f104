"""Substring dedup by content-defined chunking with a gear rolling hash.

The hash of the last 16 bytes decides whether a chunk ends at a word's start, so
ends depend on the text around them only: after an insertion they fall in place
again, and a passage has the same chunks in every document. Chunks are known by
digest; of all chunks with one digest the first in the order of documents stays.
A stretch of further chunks goes if it holds at least ``min_words`` words, so that
short common lines stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: A word's start ends a chunk once in so many words.
WORDS = 6
#: In runs of over so many bytes without white space, any character may end a chunk.
LONG = 64
#: Bytes that count as one word where there is no white space.
WORD_BYTES = 16
_SLICE_BYTES = 2_000_000
_gear: dict = {}


def gear_table(seed: int = 6) -> np.ndarray:
    """A 16-bit value for each byte."""
    if seed not in _gear:
        _gear[seed] = np.fromiter((xxhash.xxh64_intdigest(bytes([b]), seed) & 0xFFFF for b in range(256)), np.uint16, 256)
    return _gear[seed]


def gear_hash(data: np.ndarray, seed: int = 6) -> np.ndarray:
    """At each byte the gear hash of the 16 bytes that end there: h = 2 * h + table[byte], modulo 2**16."""
    h = gear_table(seed)[data]
    for shift in (1, 2, 4, 8):  # twice as many bytes in each step
        older = np.zeros_like(h)
        older[shift:] = h[:-shift] << np.uint16(shift)
        h = h + older
    return h


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def chunks(data: np.ndarray, doc: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts of chunks in the joined bytes of documents, and the starts of words. ``doc``: where each (non-empty) document begins."""
    space = is_space(data)
    first = np.zeros(len(data), bool)
    first[doc] = True
    before = np.append(True, space[:-1])  # what lies before a byte is white space or another document
    before[doc] = True
    word = ~space & before
    at = np.arange(len(data), dtype=np.int32)
    run = at - np.maximum.accumulate(np.where(before | space, at, 0))
    inside = (run >= LONG) & ((data & 0xC0) != 0x80)
    h = np.append(np.uint16(0), gear_hash(data)[:-1])
    full = at - np.maximum.accumulate(np.where(first, at, 0)) >= 16  # the hash has bytes of this document only
    ends = (word & (h < np.uint16(65536 // words))) | (inside & (h < np.uint16(65536 // 48)))
    return np.flatnonzero((ends & full) | first), np.flatnonzero(word | (inside & (run % WORD_BYTES == 0)))


def _joined(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents' indexes, where they begin, bytes) of slices of the texts that are not empty."""
    size = np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in texts], np.int64)
    slot = np.cumsum(size) // _SLICE_BYTES
    for s in np.unique(slot[size > 0]):
        own = np.flatnonzero((slot == s) & (size > 0))
        data = b"".join(bytes(texts[int(i)].as_buffer()) for i in own)
        yield own, np.cumsum(size[own]) - size[own], np.frombuffer(data, np.uint8)


def digests(raw: bytes, start: np.ndarray) -> np.ndarray:
    """64 bits of XXH3 of each chunk, as signed numbers. Two chunks that share one by chance are no stretch of words, so none goes for it."""
    ends = [*start[1:].tolist(), len(raw)]
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(start.tolist(), ends, strict=True)), np.uint64, len(start)).view(np.int64)


def chunk_table(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): the different chunks of every text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, begin, data in _joined(batch.column(1)):
                start, _ = chunks(data, begin, words)
                digest = digests(data.tobytes(), start)
                doc = np.searchsorted(begin, start, side="right") - 1
                order = np.lexsort((digest, doc))
                new = np.append(True, (doc[order[1:]] != doc[order[:-1]]) | (digest[order[1:]] != digest[order[:-1]]))
                order = order[new]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own[doc[order]])), pa.array(digest[order])], ["doc_id", "digest"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, digest long")


def cut(text: str, known: np.ndarray, min_words: int = 20, words: int = WORDS) -> tuple[str, list[tuple[int, int]]]:
    """The text without its stretches of at least ``min_words`` words in chunks that are ``known`` or that it has before, and these stretches as (start, length) in UTF-8 bytes."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    if not len(data):
        return text, []
    start, word = chunks(data, np.array([0]), words)
    edge = np.append(start, len(data))
    marks = np.zeros(len(start) + 2, np.int8)
    digest = digests(data.tobytes(), start)
    first = np.zeros(len(start), bool)
    first[np.unique(digest, return_index=True)[1]] = True
    marks[1:-1] = ~first | np.isin(digest, known)
    turn = np.diff(marks)
    lo, hi = edge[np.flatnonzero(turn == 1)], edge[np.flatnonzero(turn == -1)]
    held = np.searchsorted(word, hi) - np.searchsorted(word, lo)
    spans = [(int(a), int(b)) for a, b, n in zip(lo, hi, held, strict=True) if n >= min_words]
    if not spans:
        return text, []
    raw, out, at = data.tobytes(), [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out).decode("utf-8"), [(a, b - a) for a, b in spans]


def dedup_substrings(docs: DataFrame, min_words: int = 20, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, with the text cut, and removed: array of (start, length) of what went, in bytes of the old text.

    Documents come in the order of their id: of a passage that occurs several times
    the first stays, also within a text. Rows of equal id are one document, which
    does not cut itself across its rows; rows of null id are the first document and
    only cut within their texts. Null and empty texts stay as they are; a text that
    only repeats others becomes empty. A column named removed is replaced.
    """
    found = materialize(chunk_table(docs, words, id_col, text_col), "chunks")
    first = found.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("early"), F.count("*").alias("n")).where("n > 1").select("digest", "first", "early")
    again = found.join(first, "digest").where(F.col("doc_id").isNotNull() & (F.col("early") | (F.col("doc_id") > F.col("first")))).select("doc_id", "digest")
    lists = again.groupBy("doc_id").agg(F.collect_set("digest").alias("__cut_known")).withColumnRenamed("doc_id", "__cut_id")
    keep = [c for c in docs.columns if c != "removed"]
    own = docs.join(lists, F.col(f"`{id_col}`") == F.col("__cut_id"), "left").select(*[F.col(f"`{c}`") for c in keep], "__cut_known")
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])))
    t = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            texts, gone = batch.column(t).to_pylist(), [[]] * batch.num_rows
            none = np.zeros(0, np.int64)
            for i, text in enumerate(texts):
                if text:
                    known = lists[i].values.to_numpy() if lists[i].is_valid else none
                    texts[i], spans = cut(text, known, min_words, words)
                    gone[i] = [{"start": a, "length": n} for a, n in spans]
            cols = [batch.column(i) for i in range(len(keep))]
            cols[t] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))], [*keep, "removed"])

    return own.mapInArrow(run, schema)
