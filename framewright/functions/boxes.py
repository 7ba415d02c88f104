"""Container structures as columns: whole numbers as bytes, boxes and elements, and walks over those that follow each other. Bytes are told in hexadecimal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def big(value: Column | int, n: int) -> Column:
    """A whole number as ``n`` bytes, the most significant first."""
    value = F.lit(value) if isinstance(value, int) else value
    return F.lpad(F.hex(value.cast("long")), 2 * n, "0")


def little(value: Column | int, n: int) -> Column:
    """A whole number as ``n`` bytes, the least significant first."""
    text = big(value, n)
    return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in range(n - 1, -1, -1)])


def read_big(data: Column, at: Column | int, n: int) -> Column:
    """``n`` bytes (7 at most) from byte ``at``; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    text = F.substring(data, (2 * at + 1).cast("int"), F.lit(2 * n))
    return F.when(F.length(text) == 2 * n, F.conv(text, 16, 10).cast("long"))


def read_little(data: Column, at: Column | int, n: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    text = F.substring(data, (2 * at + 1).cast("int"), F.lit(2 * n))
    turned = F.concat(*[F.substring(text, 2 * i + 1, 2) for i in range(n - 1, -1, -1)])
    return F.when(F.length(text) == 2 * n, F.conv(turned, 16, 10).cast("long"))


def text(data: Column, at: Column | int, n: int) -> Column:
    """``n`` bytes as characters."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.decode(F.unhex(F.substring(data, (2 * at + 1).cast("int"), F.lit(2 * n))), "utf-8")


def box(kind: str, *parts: Column) -> Column:
    """A box: its size in four bytes, its kind and its payload."""
    body = F.concat(*parts) if parts else F.lit("")
    return F.concat(big(F.length(body) / 2 + 8, 4), F.hex(F.lit(kind)), body)


def varint(value: Column) -> Column:
    """An element's size in as few bytes as hold it: the place of the first set bit tells how many."""
    wide = F.when(value < 127, 1).when(value < 16_383, 2).when(value < 2_097_151, 3).otherwise(4)
    return F.when(wide == 1, big(value + 0x80, 1)).when(wide == 2, big(value + 0x4000, 2)).when(wide == 3, big(value + 0x200000, 3)).otherwise(big(value + 0x10000000, 4))


def _units(of: Callable[[bytes], Iterator[tuple]], names: str) -> Callable[[Column], Column]:
    """A column function that gives the units in a run of bytes as an array of structs; null of null."""
    fields = [f.split(":") for f in names.split(",")]
    kinds = [pa.string() if kind == "string" else pa.int64() for _, kind in fields]

    def apply(data: Column) -> Column:
        @F.arrow_udf(f"array<struct<{names}>>")
        def run(data: pa.Array) -> pa.Array:
            each = [None if x is None else [dict(zip([n for n, _ in fields], u, strict=True)) for u in of(bytes.fromhex(x))] for x in data.to_pylist()]
            return pa.array(each, pa.list_(pa.struct([(n, k) for (n, _), k in zip(fields, kinds, strict=True)])))

        return run(data)

    return apply


def _boxes(b: bytes) -> Iterator[tuple]:
    at = 0
    while at + 8 <= len(b):
        size, head = int.from_bytes(b[at : at + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(b[at + 8 : at + 16], "big"), 16
        size = len(b) - at if size == 0 else size
        if size < head or at + size > len(b):
            return
        yield at, b[at + 4 : at + 8].decode("latin-1"), head, size - head
        at += size


def box_tree(inner: frozenset[str]) -> Callable[[Column], Column]:
    """(path, kind, pos, head, size) of all boxes in a run of bytes, those inside boxes of the kinds ``inner`` too."""

    def walk(b: bytes, path: str = "", base: int = 0) -> Iterator[tuple]:
        for at, kind, head, size in _boxes(b):
            yield f"{path}/{kind}", kind, base + at, head, size
            if kind in inner:
                yield from walk(b[at + head : at + head + size], f"{path}/{kind}", base + at + head)

    return _units(walk, "path:string,kind:string,pos:bigint,head:bigint,size:bigint")


def _messages(b: bytes) -> Iterator[tuple]:
    at, end = 0, len(b) - (b[-1:] == b"\x80")
    while at < end:
        values = []
        for _ in range(2):
            first = at
            while at < len(b) and b[at] == 255:
                at += 1
            if at >= len(b):
                return
            values.append(255 * (at - first) + b[at])
            at += 1
        yield tuple(values)
        at += values[1]


def _number(b: bytes, at: int) -> int:
    """Bytes of the variable number at ``at``: the place of its first set bit; 0 where there is none."""
    return 9 - b[at].bit_length() if at < len(b) and b[at] else 0


def _elements(b: bytes) -> Iterator[tuple]:
    at = 0
    while wide := _number(b, at):
        long = _number(b, at + wide)
        head = wide + long
        size = int.from_bytes(b[at + wide : at + head], "big") - (1 << (7 * long))
        if not long or at + head + size > len(b):
            return
        yield at, b[at : at + wide].hex().upper(), head, size
        at += head + size


def _frames(b: bytes) -> Iterator[tuple]:
    at = 32
    while at + 12 <= len(b):
        size = int.from_bytes(b[at : at + 4], "little")
        if not size or at + 12 + size > len(b):
            return
        yield at, int.from_bytes(b[at + 4 : at + 12], "little", signed=True), 12, size
        at += 12 + size


#: (pos, kind, head, size) of the boxes in a run of bytes. A size of 1 is followed by eight bytes of size; of 0 it reaches to the end; a box that is cut off ends the walk.
boxes = _units(_boxes, "pos:bigint,kind:string,head:bigint,size:bigint")
#: (pos, id, head, size) of the elements in a run of bytes: a variable id, which keeps its mark, and a variable size.
elements = _units(_elements, "pos:bigint,id:string,head:bigint,size:bigint")
#: (pos, pts, head, size) of the frames behind a header of 32 bytes; a frame without bytes ends the walk.
frames = _units(_frames, "pos:bigint,pts:bigint,head:bigint,size:bigint")


#: (kind, size) of the messages of a side unit; bytes of 255 add up, and a last byte 0x80 ends it.
messages = _units(_messages, "kind:bigint,size:bigint")


def entries(data: Column, start: int, names: tuple[str, ...]) -> Column:
    """Rows of a table of big-endian numbers of four bytes each: their count lies four bytes before ``start``."""

    def rows(b: bytes) -> Iterator[tuple]:
        count = int.from_bytes(b[start - 4 : start], "big")
        cells = np.frombuffer(b, ">u4", len(names) * count, start).reshape(count, -1)
        yield from map(tuple, cells.tolist())

    return _units(rows, ",".join(f"{n}:bigint" for n in names))(data)
