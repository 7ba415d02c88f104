"""Plug-ins: readers, codecs and filters under names.

A filter's ``make`` takes its options and gives a function for DataFrame.transform, so
a graph of filters is a chain of transforms that Catalyst sees as one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Descriptor:
    """kind (reader, writer, decoder, encoder or filter), name, and what decides between several."""

    kind: str
    name: str
    make: Callable[..., Transform]
    priority: int = 0
    codec: str = ""
    extensions: tuple[str, ...] = ()
    note: str = ""


class Registry:
    """Descriptors in the order of their registration."""

    def __init__(self) -> None:
        self.entries: list[Descriptor] = []

    def add(self, kind: str, name: str, **facts) -> Callable[[Callable[..., Transform]], Callable[..., Transform]]:
        def put(f: Callable[..., Transform]) -> Callable[..., Transform]:
            self.entries.append(Descriptor(kind, name, f, **facts))
            return f

        return put

    def named(self, kind: str, name: str) -> Descriptor:
        found = next((d for d in self.entries if d.kind == kind and d.name == name), None)
        if not found:
            raise KeyError(f"no {kind} is named {name}")
        return found

    def for_codec(self, kind: str, codec: str) -> Descriptor:
        """The highest priority; of equals the last registered."""
        found = [d for d in self.entries if d.kind == kind and d.codec == codec]
        if not found:
            raise KeyError(f"no {kind} knows {codec}")
        return max(enumerate(found), key=lambda x: (x[1].priority, x[0]))[1]

    def for_extension(self, kind: str, path: str) -> Descriptor:
        ext = path.rpartition(".")[2].lower()
        found = next((d for d in self.entries if d.kind == kind and ext in d.extensions), None)
        if not found:
            raise KeyError(f"no {kind} takes .{ext}")
        return found

    def catalogue(self) -> list[tuple[str, bool, bool, str]]:
        """(name, decodes, encodes, note) by name; the first note that there is."""
        out: dict[str, tuple[bool, bool, str]] = {}
        for d in self.entries:
            if d.kind in ("decoder", "encoder"):
                a, b, note = out.get(d.codec or d.name, (False, False, ""))
                out[d.codec or d.name] = (a or d.kind == "decoder", b or d.kind == "encoder", note or d.note)
        return [(n, *v) for n, v in sorted(out.items())]


REGISTRY = Registry()


@REGISTRY.add("filter", "streams", note="packets of some streams")
def _streams(keep: tuple[int, ...]) -> Transform:
    return lambda df: df.where(df["stream_index"].isin(*keep))


@REGISTRY.add("filter", "gain", note="sizes times a whole factor")
def _gain(by: int) -> Transform:
    return lambda df: df.withColumn("size", df["size"] * by)


@REGISTRY.add("filter", "shift", note="times moved")
def _shift(us: int) -> Transform:
    return lambda df: df.withColumn("pts", df["pts"] + us)


@REGISTRY.add("filter", "merge", note="two logs as one")
def _merge(other: DataFrame) -> Transform:
    return lambda df: df.unionByName(other)
