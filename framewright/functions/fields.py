"""Headers as columns. A field is read for a whole Arrow batch at once: each row has its own place in its bits, and what is not there takes none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import uint

#: Profiles whose headers tell the chroma format: fixed values of the standard.
HIGH = (100, 110, 122, 244, 44, 83, 86, 118, 128)
#: Slice kinds by their number modulo 5: fixed values of the standard.
KINDS = ("P", "B", "I", "SP", "SI")


class Bits:
    """Reads fields in turn from the values of a column of bytes. Without ``where`` a field is in all rows; elsewhere it is 0."""

    def __init__(self, data: pa.Array, emulation: bool = True):
        values = [x or b"" for x in data.to_pylist()]
        if emulation:  # bytes that keep start codes out
            values = [x.replace(b"\0\0\3", b"\0\0") for x in values]
        sizes = np.array([len(x) for x in values], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes + 16)])[: len(values)]
        self.bytes = np.frombuffer((b"\0" * 16).join([*values, b"\0" * 16]), np.uint8).astype(np.uint64)
        self.at, self.end, self.rows = 8 * begin, 8 * (begin + sizes), len(values)
        self.faults: list[str | None] = [None] * self.rows

    def _window(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from each place, from the highest bit on."""
        byte = np.minimum(at >> 3, len(self.bytes) - 8)
        word = np.zeros(len(at), np.uint64)
        for i in range(8):
            word |= self.bytes[byte + i] << np.uint64(56 - 8 * i)
        return word << (at & 7).astype(np.uint64)

    def u(self, n: int | np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
        """A whole number of ``n`` bits, 32 at most."""
        n = np.broadcast_to(np.asarray(n, np.int64), self.rows)
        there = (n > 0) if where is None else where & (n > 0)
        value = self._window(self.at) >> np.where(there, 64 - n, 63).astype(np.uint64)
        self.at = np.minimum(self.at + np.where(there, n, 0), self.end + 64)
        return np.where(there, value.astype(np.int64), 0)

    def flag(self, where: np.ndarray | None = None) -> np.ndarray:
        return self.u(1, where) == 1

    def ue(self, where: np.ndarray | None = None) -> np.ndarray:
        """An unsigned Exp-Golomb code."""
        where = np.ones(self.rows, bool) if where is None else where
        _, size = np.frexp((self._window(self.at) >> np.uint64(11)).astype(np.float64))
        zeros = 53 - size.astype(np.int64)
        self.fault(where & (zeros > 31), "a code without an end")
        zeros = np.minimum(zeros, 31)
        self.at = np.where(where, np.minimum(self.at + zeros, self.end + 64), self.at)
        return np.where(where, self.u(zeros + 1, where) - 1, 0)

    def se(self, where: np.ndarray | None = None) -> np.ndarray:
        v = self.ue(where)
        return np.where(v % 2 == 1, (v + 1) // 2, -(v // 2))

    def fault(self, when: np.ndarray, text: str) -> None:
        """What makes a header unreadable; the first is kept."""
        for i in np.flatnonzero(when):
            self.faults[i] = self.faults[i] or text

    def errors(self) -> list[str | None]:
        cut = self.at > self.end
        return [e or ("the header is cut off" if c else None) for e, c in zip(self.faults, cut.tolist(), strict=True)]


class Lists:
    """Entries that rows get one after the other, some rows more than others, as a column of lists of numbers or of structs."""

    def __init__(self, rows: int, *names: str):
        self.rows, self.names, self.parts = rows, names, []

    def add(self, where: np.ndarray, *values: np.ndarray) -> None:
        at = np.flatnonzero(where)
        self.parts.append((at, [v[at] for v in values]))

    def array(self) -> pa.Array:
        at = np.concatenate([p[0] for p in self.parts]) if self.parts else np.zeros(0, np.int64)
        order = np.argsort(at, kind="stable")
        fields = [pa.array((np.concatenate([p[1][i] for p in self.parts]) if self.parts else np.zeros(0, np.int64))[order], pa.int64()) for i in range(len(self.names) or 1)]
        values = pa.StructArray.from_arrays(fields, names=list(self.names)) if self.names else fields[0]
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(at[order], np.arange(self.rows + 1)).astype(np.int32)), values)


def _reader(df: DataFrame, keep: tuple[str, ...], fields: str, read: Callable[[Bits, dict[str, np.ndarray]], dict], emulation: bool = True, only: tuple[str, ...] | None = None) -> DataFrame:
    """keep, the fields that ``read`` gives, or those in ``only`` (null where there was a fault or the bits ended early), and error. ``read`` gets the other columns of df as numbers, null as 0."""
    kinds = dict(f.split(" ", 1) for f in fields.split(", "))
    names = list(kinds if only is None else only)
    fields = ", ".join(f"{n} {kinds[n]}" for n in names)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = Bits(b.column("data").cast(pa.binary()), emulation)
            given = {n: b.column(n).cast(pa.int64()).fill_null(0).to_numpy() for n in b.schema.names if n != "data" and n not in keep}
            found = read(bits, given)
            errors = bits.errors()
            good = pa.array([e is None for e in errors])
            columns = [found[n].array() if isinstance(found[n], Lists) else found[n] if isinstance(found[n], pa.Array) else pa.array(found[n]) for n in names]
            columns = [pa.compute.if_else(good, c, pa.scalar(None, c.type)) for c in columns]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], *columns, pa.array(errors, pa.string())], [*keep, *names, "error"])

    own = [f.name for f in df.schema.fields if f.name not in keep and f.name != "data"]
    rows = df.select(*keep, "data", *[F.col(n).cast("long").alias(n) for n in own])
    return rows.mapInArrow(step, f"{kept}, {fields}, error string")


def _ints(values: np.ndarray, where: np.ndarray | None = None) -> pa.Array:
    """Numbers, null elsewhere."""
    return pa.array(values.astype(np.int64), mask=None if where is None else ~where)


def sequence(df: DataFrame, *keep: str) -> DataFrame:
    """keep, the fields of a sequence header in the column ``data`` (its unit after the first byte), and error.

    ``scaling`` is null without lists; it has [] for each list that isn't there, [0] for the
    default one, else the list. ``cycle`` are the orders of a cycle.
    """

    def lists(b: Bits, there: np.ndarray, chroma: np.ndarray) -> pa.Array:
        found: list[list[list[int]] | None] = [[] if x else None for x in there.tolist()]
        for i in range(12):
            on = there & ((i < 8) | (chroma == 3))
            present = b.flag(on)
            size = 16 if i < 6 else 64
            last, after, values = np.full(b.rows, 8), np.full(b.rows, 8), np.zeros((b.rows, size), np.int64)
            default = np.zeros(b.rows, bool)
            for j in range(size):
                more = present & (after != 0)
                after = np.where(more, (last + b.se(more)) % 256, after)
                default |= more & (after == 0) & (j == 0)
                last = np.where(after != 0, after, last)
                values[:, j] = last
            for r in np.flatnonzero(on):
                found[r].append([] if not present[r] else [0] if default[r] else values[r].tolist())
        return pa.array(found, pa.list_(pa.list_(pa.int64())))

    def read(b: Bits, _: dict) -> dict:
        profile, _, level, sps_id = b.u(8), b.u(8), b.u(8), b.ue()
        high = np.isin(profile, HIGH)
        chroma = np.where(high, b.ue(high), 1)
        planes = b.flag(high & (chroma == 3))
        luma, chroma_bits, _ = b.ue(high), b.ue(high), b.u(1, high)
        scaling = lists(b, b.flag(high), chroma)
        frame_bits, poc_type = b.ue() + 4, b.ue()
        poc_bits = b.ue(poc_type == 0) + 4
        one = poc_type == 1
        delta_zero, ref, field, n = b.flag(one), b.se(one), b.se(one), b.ue(one)
        b.fault(n > 255, "a cycle of more than 255 orders")
        cycle = Lists(b.rows)
        for i in range(int(np.minimum(n, 255).max(initial=0))):
            cycle.add(n > i, b.se(n > i))
        max_refs, _, wide, high_ = b.ue(), b.u(1), b.ue() + 1, b.ue() + 1
        frames_only = b.flag()
        _, _, crop = b.u(1, ~frames_only), b.u(1), b.flag()
        left, right, top, bottom = (b.ue(crop) for _ in range(4))
        on = b.flag()
        ratio = b.u(8, b.flag(on))
        b.u(32, on & (ratio == 255))
        b.u(1, b.flag(on))
        video = b.flag(on)
        b.u(4, video)
        b.u(24, b.flag(video))
        located = b.flag(on)
        b.ue(located), b.ue(located)
        timed = b.flag(on)
        units, scale = b.u(32, timed), b.u(32, timed)
        rate = units > 0
        x, y = np.where(np.isin(chroma, (0, 3)), 1, 2), np.where(chroma == 1, 2, 1) * (2 - frames_only)
        return {
            "profile": profile, "level": level, "sps_id": sps_id, "chroma": chroma, "planes": planes, "depth_luma": luma + 8, "depth_chroma": chroma_bits + 8, "scaling": scaling, "frame_bits": frame_bits, "max_frame_num": 1 << np.minimum(frame_bits, 62),
            "poc_type": poc_type, "poc_bits": poc_bits, "delta_zero": delta_zero, "off_ref": ref, "off_field": field, "cycle": cycle, "max_refs": max_refs, "frames_only": frames_only,
            "width": wide * 16 - x * (left + right), "height": high_ * 16 * (2 - frames_only) - y * (top + bottom), "rate_num": _ints(scale, rate), "rate_den": _ints(2 * units, rate),
        }

    return _reader(df, keep, "profile long, level long, sps_id long, chroma long, planes boolean, depth_luma long, depth_chroma long, scaling array<array<long>>, frame_bits long, max_frame_num long, poc_type long, poc_bits long, delta_zero boolean, off_ref long, off_field long, cycle array<long>, max_refs long, frames_only boolean, width long, height long, rate_num long, rate_den long", read)


def picture(df: DataFrame, *keep: str) -> DataFrame:
    """keep, the fields of a picture header up to its flags, and error."""

    def read(b: Bits, _: dict) -> dict:
        pps_id, sps_id, cabac, order, groups = b.ue(), b.ue(), b.flag(), b.flag(), b.ue()
        b.fault(groups > 0, "several slice groups")
        refs0, refs1, weighted, bipred, qp, qs = b.ue() + 1, b.ue() + 1, b.flag(), b.u(2), b.se() + 26, b.se() + 26
        chroma, deblock, constrained, redundant = b.se(), b.flag(), b.flag(), b.flag()
        return {"pps_id": pps_id, "sps_id": sps_id, "cabac": cabac, "order": order, "refs0": refs0, "refs1": refs1, "weighted": weighted, "bipred": bipred, "qp": qp, "qs": qs, "chroma_qp": chroma, "deblock": deblock, "constrained": constrained, "redundant": redundant}

    return _reader(df, keep, "pps_id long, sps_id long, cabac boolean, order boolean, refs0 long, refs1 long, weighted boolean, bipred long, qp long, qs long, chroma_qp long, deblock boolean, constrained boolean, redundant boolean", read)


#: What a slice header needs to know: its unit's kind and importance, and columns of its parameter sets.
CONTEXT = ("unit_type", "ref_idc", "frame_bits", "frames_only", "poc_type", "poc_bits", "delta_zero", "chroma", "planes", "cabac", "order", "refs0", "refs1", "weighted", "bipred", "qp", "deblock", "redundant")
#: Most entries of a list of changes or commands.
MOST = 128
_CHANGE, _MARK = "array<struct<op:long,value:long>>", "array<struct<op:long,a:long,b:long>>"
_WEIGHT = "array<struct<luma:long,luma_offset:long,cb:long,cb_offset:long,cr:long,cr_offset:long>>"


def slices(df: DataFrame, *keep: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """keep, all fields of a slice header in ``data`` (its unit after the first byte), or those in ``only``, and error. df has the columns CONTEXT: join the parameter sets first.

    Lists end with their rows' own terminators; weights that a row does not tell are the
    default of their list's scale. All bits are read, and faults found, whatever is asked for.
    """

    def changes(b: Bits, there: np.ndarray) -> Lists:
        out, more = Lists(b.rows, "op", "value"), b.flag(there)
        for _ in range(MOST):
            op = b.ue(more)
            b.fault(more & (op > 5), "an unknown change")
            more = more & (op != 3) & (op <= 5)
            if not more.any():
                break
            out.add(more, op, b.ue(more))
        b.fault(more, "changes without an end")
        return out

    def marks(b: Bits, more: np.ndarray) -> Lists:
        out = Lists(b.rows, "op", "a", "b")
        for _ in range(MOST):
            op = b.ue(more)
            b.fault(more & (op > 6), "an unknown command")
            more = more & (op > 0) & (op <= 6)
            if not more.any():
                break
            a = b.ue(more & (op != 5))
            out.add(more, op, a, b.ue(more & (op == 3)))
        b.fault(more, "commands without an end")
        return out

    def weights(b: Bits, there: np.ndarray, n: np.ndarray, scales: tuple[np.ndarray, np.ndarray], colour: np.ndarray) -> Lists:
        out = Lists(b.rows, "luma", "luma_offset", "cb", "cb_offset", "cr", "cr_offset")
        n = np.where(there, n, 0)
        b.fault(n > 32, "more than 32 references")
        for i in range(int(np.minimum(n, 32).max(initial=0))):
            on = n > i
            luma = b.flag(on)
            values = [np.where(luma, b.se(luma), 1 << scales[0]), b.se(luma)]
            chroma = b.flag(on & colour)
            for _ in range(2):
                values += [np.where(chroma, b.se(chroma), 1 << scales[1]), b.se(chroma)]
            out.add(on, *values)
        return out

    def read(b: Bits, c: dict[str, np.ndarray]) -> dict:
        idr, colour = c["unit_type"] == 5, (c["chroma"] > 0) & (c["planes"] == 0)
        first, raw, pps_id = b.ue(), b.ue(), b.ue()
        b.fault(raw > 9, "an unknown kind of slice")
        kind = raw % 5
        p, bi, intra, switching = np.isin(kind, (0, 3)), kind == 1, np.isin(kind, (2, 4)), kind >= 3
        b.u(2, c["planes"] == 1)
        frame_num = b.u(c["frame_bits"])
        field = b.flag(c["frames_only"] == 0)
        bottom = b.flag(field)
        idr_id = b.ue(idr)
        poc = b.u(c["poc_bits"], c["poc_type"] == 0)
        pair = (c["order"] == 1) & ~field
        delta_bottom = b.se((c["poc_type"] == 0) & pair)
        told = (c["poc_type"] == 1) & (c["delta_zero"] == 0)
        delta0, delta1 = b.se(told), b.se(told & pair)
        redundant = b.ue(c["redundant"] == 1)
        direct = b.flag(bi)
        own = b.flag(~intra)
        refs0, refs1 = np.where(own, b.ue(own) + 1, c["refs0"]), np.where(own & bi, b.ue(own & bi) + 1, c["refs1"])
        refs0, refs1 = np.where(intra, 0, refs0), np.where(bi, refs1, 0)
        changes0, changes1 = changes(b, ~intra), changes(b, bi)
        weighted = (c["weighted"] == 1) & p | (c["bipred"] == 1) & bi
        scales = (np.minimum(b.ue(weighted), 31), np.minimum(b.ue(weighted & colour), 31))
        weights0, weights1 = weights(b, weighted, refs0, scales, colour), weights(b, weighted & bi, refs1, scales, colour)
        kept = c["ref_idc"] > 0
        no_output, long_term, adaptive = b.flag(kept & idr), b.flag(kept & idr), b.flag(kept & ~idr)
        commands = marks(b, adaptive)
        cabac = b.ue((c["cabac"] == 1) & ~intra)
        qp = c["qp"] + b.se()
        b.u(1, kind == 3)
        b.se(switching)
        off = b.ue(c["deblock"] == 1)
        edges = (c["deblock"] == 1) & (off != 1)
        alpha, beta = 2 * b.se(edges), 2 * b.se(edges)
        return {
            "first_mb": first, "kind": pa.array([KINDS[k] for k in kind.tolist()], pa.string()), "pps_id": pps_id, "frame_num": frame_num, "field": field, "bottom": bottom, "idr_id": _ints(idr_id, idr), "poc_lsb": poc, "delta_bottom": delta_bottom, "delta0": delta0, "delta1": delta1, "redundant_no": redundant, "direct_spatial": direct,
            "refs0": refs0, "refs1": refs1, "changes0": changes0, "changes1": changes1, "luma_scale": scales[0], "chroma_scale": scales[1], "weights0": weights0, "weights1": weights1, "no_output": no_output, "long_term": long_term, "commands": commands,
            "cabac_table": cabac, "slice_qp": qp, "edges_off": off, "alpha": alpha, "beta": beta,
        }

    fields = f"first_mb long, kind string, pps_id long, frame_num long, field boolean, bottom boolean, idr_id long, poc_lsb long, delta_bottom long, delta0 long, delta1 long, redundant_no long, direct_spatial boolean, refs0 long, refs1 long, changes0 {_CHANGE}, changes1 {_CHANGE}, luma_scale long, chroma_scale long, weights0 {_WEIGHT}, weights1 {_WEIGHT}, no_output boolean, long_term boolean, commands {_MARK}, cabac_table long, slice_qp long, edges_off long, alpha long, beta long"
    return _reader(df.select(*keep, "data", *CONTEXT), keep, fields, read, only=only)


def frame_start(df: DataFrame, *keep: str) -> DataFrame:
    """keep, the first fields of the other codec's frame header, and error."""

    def read(b: Bits, _: dict) -> dict:
        b.fault(b.u(2) != 2, "no frame marker")
        profile = b.u(1) + 2 * b.u(1)
        b.u(1, profile == 3)
        again = b.flag()
        existing, not_key, shown, _ = b.u(3, again), b.flag(~again), b.flag(~again), b.u(1, ~again)
        key = ~again & ~not_key
        b.fault(b.u(24, key) != np.where(key, 0x498342, 0), "no sync code")
        b.u(1, key & (profile >= 2))
        space = b.u(3, key)
        b.u(1, key & (space != 7))
        b.u(3, key & (space != 7) & (profile % 2 == 1))
        b.u(1, key & (space == 7) & (profile % 2 == 1))
        wide, high = b.u(16, key), b.u(16, key)
        return {"profile": profile, "show_existing": _ints(existing, again), "key": key, "shown": again | shown, "width": _ints(wide + 1, key), "height": _ints(high + 1, key)}

    return _reader(df, keep, "profile long, show_existing long, key boolean, shown boolean, width long, height long", read, emulation=False)


def configuration(data: Column) -> Column:
    """The decoder's configuration in a container, of one parameter set of either kind: bytes of a length, profile, level and the sets' sizes; null if it is none."""
    first = uint(data, 6, 2)
    after = (first + 8).cast("int")
    second = F.conv(F.hex(F.substring(data, after + 2, F.lit(2))), 16, 10).cast("long")
    sound = (uint(data, 0, 1) == 1) & (F.octet_length(data) >= after + 3 + second)
    return F.when(sound, F.struct((uint(data, 4, 1).bitwiseAND(3) + 1).alias("length_size"), uint(data, 1, 1).alias("profile"), uint(data, 3, 1).alias("level"), first.alias("first_set"), second.alias("second_set")))


READERS: dict[str, Callable[..., DataFrame]] = {"sequence": sequence, "picture": picture, "slice": slices, "frame": frame_start}
