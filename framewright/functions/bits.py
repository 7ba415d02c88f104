"""Bytes, bits and tags as column expressions."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def uint(data: Column | str, at: int, n: int, little: bool = False) -> Column:
    """``n`` bytes (at most 7) from place ``at`` as a whole number."""
    data = F.col(data) if isinstance(data, str) else data
    order = range(n - 1, -1, -1) if little else range(n)
    return F.conv(F.hex(F.concat(*[F.substring(data, at + i + 1, 1) for i in order])), 16, 10).cast("long")


def adler32(data: Column, seed: int = 1) -> Column:
    """Adler-32 with a seed of 0 or 1, over Arrow batches of bytes; null of null."""

    @F.arrow_udf("bigint")
    def run(data: pa.Array) -> pa.Array:
        return pa.array([None if x is None else zlib.adler32(x, seed) for x in data.to_pylist()], pa.int64())

    return run(data.cast("binary"))


def ue_code(value: Column) -> Column:
    """The unsigned Exp-Golomb code of a whole number, as a text of bits."""
    body = F.bin(value + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(body) - 1), body)


def read_ue(bits: Column) -> Column:
    """The value of the code that begins a text of bits; null without a set bit in the first 32."""
    zeros = F.instr(bits, "1") - 1
    return F.when((zeros >= 0) & (zeros <= 31), F.conv(F.substring(bits, zeros + 1, zeros + 1), 2, 10).cast("long") - 1)


def signed(k: Column) -> Column:
    """0, 1, -1, 2, -2 and so on."""
    return F.when(k % 2 == 1, F.floor((k + 1) / 2)).otherwise(-F.floor(k / 2)).cast("long")


def read_te(bits: Column, range_: Column) -> Column:
    return F.when(range_ == 1, F.lit(0).cast("long")).when(range_ == 2, 1 - F.substring(bits, 1, 1).cast("long")).otherwise(read_ue(bits))


def _bytes_of_hex(change: Callable[[bytes], bytes]) -> Callable[[Column], Column]:
    """A column function that changes bytes, told in hexadecimal, over Arrow batches; null of null."""

    def apply(hex_: Column) -> Column:
        @F.arrow_udf("string")
        def run(hex_: pa.Array) -> pa.Array:
            return pa.array([None if x is None else change(bytes.fromhex(x)).hex().upper() for x in hex_.to_pylist()], pa.string())

        return run(hex_)

    return apply


def _kept_from_starts(x: bytes) -> bytes:
    return re.sub(rb"\x00\x00(?=[\x00-\x03])", b"\0\0\3", x)


#: Hexadecimal bytes without each 03 that follows two zero bytes; zeros are counted anew after it.
without_emulation = _bytes_of_hex(lambda x: x.replace(b"\0\0\3", b"\0\0"))
#: Hexadecimal bytes with a 03 put in after two zero bytes where a byte of at most 3 follows.
with_emulation = _bytes_of_hex(_kept_from_starts)


def packed(bits: Column, emulation: bool = True) -> Column:
    """A text of bits as bytes, over Arrow batches: zeros up to a whole byte, and the bytes that keep start codes out; null of null.

    A long expression is read here once. A lambda over its octets would work it out anew for each of them.
    """

    def pack(x: str) -> bytes:
        rest = -len(x) % 8
        octets = (int(x or "0", 2) << rest).to_bytes((len(x) + rest) // 8, "big")
        return _kept_from_starts(octets) if emulation else octets

    @F.arrow_udf("binary")
    def run(bits: pa.Array) -> pa.Array:
        return pa.array([None if x is None else pack(x) for x in bits.to_pylist()], pa.binary())

    return run(bits)


def length_prefixed(hex_: Column) -> Column:
    """Units (pos, size, h) of bytes in which one byte of length precedes each payload. There are at most as many as bytes."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,size:int,h:string>>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        size = F.conv(F.substring(hex_, 2 * s["at"] + 1, 2), 16, 10).cast("int")
        unit = F.struct(s["at"].alias("pos"), size.alias("size"), F.substring(hex_, 2 * s["at"] + 3, 2 * size).alias("h"))
        more = 2 * s["at"] < F.length(hex_)
        return F.struct(F.when(more, s["at"] + 1 + size).otherwise(s["at"]).alias("at"), F.when(more, F.array_append(s["out"], unit)).otherwise(s["out"]).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.floor(F.length(hex_) / 2).cast("int")), start, step, lambda s: s["out"])


def tag(tags: str, name: str) -> Column:
    """The first value of an ordered list of tags (k, v) under a name, in any case."""
    return F.get(F.filter(tags, lambda x: F.lower(x["k"]) == name.lower()), F.lit(0))["v"]
