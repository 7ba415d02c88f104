"""Prefix codes of bytes by what stands before them: tables from a corpus's own counts, and both ways over Arrow batches.

A code's length follows from its share of its context's bytes, codes from lengths in
canonical order. Reading looks up the next eight bits, and the bits after these only where a
code is longer. Texts are cut into blocks that are coded on their own, so that the
blocks of a batch are read side by side, a symbol of each at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Contexts: begin and blanks, small letters, other ASCII, all else. Bytes of a block. Bits of the first lookup.
CONTEXTS, BLOCK, FIRST = 4, 4096, 8
#: A byte counts as if it were at least one in so many of its context, which bounds the length of codes.
RARE = 1 << 16
#: Bits of the longest code.
LONGEST = 18
_CLASS = np.array([0 if b <= 32 else 1 if 97 <= b <= 122 else 2 if b < 128 else 3 for b in range(256)], np.uint8)


def blocks(df: DataFrame, keys: list[str], text: str, size: int = BLOCK) -> DataFrame:
    """keys, block, raw: the UTF-8 bytes of a text in pieces; null and empty texts have none."""
    data = F.encode(F.col(text), "utf-8")
    n = F.octet_length("_d")
    at = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))
    return df.select(*keys, data.alias("_d")).select(*keys, "_d", F.explode(at).alias("block")).select(*keys, "block", F.substring(F.col("_d"), F.col("block") * size + 1, F.lit(size)).alias("raw"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a batch, where its values begin (and end), and the context of each byte."""
    values = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int64)
    data = np.frombuffer(b"".join(values), np.uint8)
    context = np.concatenate([[0], _CLASS[data[:-1]]])[: len(data)].astype(np.int64)
    context[starts[:-1][starts[:-1] < len(data)]] = 0
    return data, starts, context


def counts(pieces: DataFrame) -> DataFrame:
    """(context, symbol, n) of all blocks: a task sends one row for each byte and context at most, batch by batch."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CONTEXTS * 256, np.int64)
        for b in batches:
            data, _, context = _flat(b.column("raw"))
            total += np.bincount(context * 256 + data, minlength=CONTEXTS * 256)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // 256).astype(np.int32)), pa.array((at % 256).astype(np.int32)), pa.array(total[at])], ["context", "symbol", "n"])

    return pieces.select("raw").mapInArrow(step, "context int, symbol int, n long").groupBy("context", "symbol").agg(F.sum("n").alias("n"))


def codes(counted: DataFrame) -> DataFrame:
    """(context, symbol, n, length, code): code as a text of bits; 256 rows a context at most."""
    own = Window.partitionBy("context")
    df = counted.withColumn("_n", F.greatest(F.col("n"), F.floor((F.sum("n").over(own) + RARE - 1) / RARE).cast("long"))).withColumn("_t", F.sum("_n").over(own))
    most = F.expr("(_t + _n - 1) div _n - 1")
    df = df.withColumn("length", F.when(most > 0, F.length(F.bin(most))).otherwise(1))
    before = F.coalesce(F.sum(F.pow(F.lit(2), LONGEST - F.col("length")).cast("long")).over(own.orderBy("length", "symbol").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bits = F.substring(F.lpad(F.bin(before), LONGEST, "0"), F.lit(1), F.col("length"))
    return df.select("context", "symbol", "n", "length", bits.alias("code"))


class Tables:
    """Codes by context and byte, and the lookups that read them."""

    def __init__(self, rows: list[tuple[int, int, int, str]]):
        self.size, self.code = np.zeros((CONTEXTS, 256), np.int64), np.zeros((CONTEXTS, 256), np.uint64)
        #: entry: length << 8 | byte; or -1 - the number of a second table
        self.first, second = np.zeros((CONTEXTS, 1 << FIRST), np.int64), []
        rest = LONGEST - FIRST
        for context, symbol, length, code in rows:
            value = int(code, 2)
            self.size[context, symbol], self.code[context, symbol] = length, value
            entry = length << 8 | symbol
            if length <= FIRST:
                at = value << (FIRST - length)
                self.first[context, at : at + (1 << (FIRST - length))] = entry
                continue
            head = value >> (length - FIRST)
            if self.first[context, head] >= 0:
                self.first[context, head] = -1 - len(second)
                second.append(np.zeros(1 << rest, np.int64))
            at = (value & ((1 << (length - FIRST)) - 1)) << (LONGEST - length)
            second[-1 - self.first[context, head]][at : at + (1 << (LONGEST - length))] = entry
        self.second = np.array(second) if second else np.zeros((1, 1 << rest), np.int64)

    def encode(self, data: np.ndarray, starts: np.ndarray, context: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The bits of each value, filled up to whole bytes with zeros, and how many they are."""
        size, code = self.size[context, data], self.code[context, data]
        if (size == 0).any():
            raise ValueError("a byte without a code in its context")
        ends = np.concatenate([[0], np.cumsum(size)])
        n = ends[starts[1:]] - ends[starts[:-1]]
        begin = np.concatenate([[0], np.cumsum((n + 7) // 8 * 8)])
        place = ends[:-1] + np.repeat(begin[:-1] - ends[starts[:-1]], np.diff(starts))
        bits = np.zeros(int(begin[-1]), np.uint8)
        for i in range(LONGEST):
            on = size > i
            bits[place[on] + i] = (code[on] >> (size[on] - 1 - i).astype(np.uint64)) & np.uint64(1)
        packed = np.packbits(bits).tobytes()
        return [packed[a // 8 : b // 8] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], n

    def decode(self, packed: list[bytes], n: np.ndarray) -> list[bytes]:
        """n bytes from each value's bits, side by side."""
        starts = np.concatenate([[0], np.cumsum([len(x) + 4 for x in packed])]).astype(np.int64)
        data = np.frombuffer((b"\0" * 4).join([*packed, b""]), np.uint8).astype(np.uint32)
        at, context = starts[:-1] * 8, np.zeros(len(packed), np.int64)
        out = np.zeros((len(packed), int(n.max(initial=0))), np.uint8)
        rows = np.argsort(-n, kind="stable")
        left = np.searchsorted(-n[rows], -np.arange(out.shape[1]), side="left")
        for i in range(out.shape[1]):
            r = rows[: left[i]]
            p = at[r]
            byte = p >> 3
            word = data[byte] << 24 | data[byte + 1] << 16 | data[byte + 2] << 8 | data[byte + 3]
            peek = (word << (p & 7).astype(np.uint32)) >> np.uint32(32 - LONGEST)
            entry = self.first[context[r], peek >> np.uint32(LONGEST - FIRST)]
            far = entry < 0
            if far.any():
                entry[far] = self.second[-1 - entry[far], peek[far] & np.uint32((1 << (LONGEST - FIRST)) - 1)]
            out[r, i] = entry & 255
            at[r] = p + (entry >> 8)
            context[r] = _CLASS[entry & 255]
        return [out[i, :k].tobytes() for i, k in enumerate(n.tolist())]


def round_trip(pieces: DataFrame, table: DataFrame) -> DataFrame:
    """pieces without raw, and n_bytes, n_bits, packed, decoded: each block in its code, and read back from it. ``table`` has 1,024 rows at most."""
    tables = Tables([(r["context"], r["symbol"], r["length"], r["code"]) for r in table.collect()])
    kept = [f for f in pieces.schema.fields if f.name != "raw"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, starts, context = _flat(b.column("raw"))
            packed, bits = tables.encode(data, starts, context)
            n = np.diff(starts)
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.array(n), pa.array(bits), pa.array(packed, pa.binary()), pa.array(tables.decode(packed, n), pa.binary())], [*[f.name for f in kept], "n_bytes", "n_bits", "packed", "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return pieces.mapInArrow(step, f"{schema}, n_bytes long, n_bits long, packed binary, decoded binary")
