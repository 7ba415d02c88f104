"""Media files as a Spark data source: spark.read.format("framewright"), df.write.format("framewright").

Reading: a file is as many partitions as it has ranges of bytes; a sample belongs to the range
that it begins in. Each task finds the file's format by its first bytes, takes the sample index (of
headers only, or of boxes without their payloads) and reads its own range. Writing: each
task writes a part under a passing name, its index behind its samples; the driver's commit moves the
parts into place and then lists them in a manifest. A task that fails removes its part, a job that fails all of
them: readers see the whole of a write or nothing.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME, MANIFEST = "framewright", "_parts.json"
_SCHEMA = "file string, stream int, n long, dts long, pts long, duration long, is_key boolean, size long, payload binary"
_ARROW = pa.schema([("file", pa.string()), ("stream", pa.int32()), ("n", pa.int64()), ("dts", pa.int64()), ("pts", pa.int64()), ("duration", pa.int64()), ("is_key", pa.bool_()), ("size", pa.int64()), ("payload", pa.binary())])
#: Bytes of a range, and of a batch of samples, about.
RANGE, BATCH = 64 << 20, 4 << 20


@dataclass
class Index:
    """Samples of one stream: places, sizes, times in ticks, and which are key samples."""

    offset: np.ndarray
    size: np.ndarray
    dts: np.ndarray
    pts: np.ndarray
    duration: np.ndarray
    key: np.ndarray
    stream: int = 0


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def probe(head: bytes) -> str | None:
    """The format that the first bytes of a file tell."""
    if head[:4] == b"DKIF":
        return "ivf"
    if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        return "wav"
    return "mp4" if head[4:8] in (b"ftyp", b"moov", b"mdat", b"free") else None


def _ivf(f, length: int, packet: int) -> list[Index]:
    f.seek(0)
    at, sizes, places, times = struct.unpack("<H", f.read(8)[6:8])[0], [], [], []
    while at + 12 <= length:
        f.seek(at)
        size, pts = struct.unpack("<Iq", f.read(12))
        if at + 12 + size > length:
            break
        places.append(at + 12)
        sizes.append(size)
        times.append(pts)
        at += 12 + size
    pts = np.array(times, np.int64)
    return [Index(np.array(places, np.int64), np.array(sizes, np.int64), pts, pts, np.ones(len(pts), np.int64), np.ones(len(pts), bool))]


def _wav(f, length: int, packet: int) -> list[Index]:
    at, block = 12, 1
    while at + 8 <= length:
        f.seek(at)
        kind, size = struct.unpack("<4sI", f.read(8))
        if kind == b"fmt ":
            block = struct.unpack("<H", f.read(16)[12:14])[0]
        if kind == b"data":
            frames = min(size, length - at - 8) // block
            first = np.arange(0, frames, packet, dtype=np.int64)
            n = np.minimum(packet, frames - first)
            return [Index(at + 8 + first * block, n * block, first, first, n, np.ones(len(first), bool))]
        at += 8 + size + size % 2
    return []


def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = size or end - at
        if size < head:
            raise ValueError("a box smaller than its head")
        yield kind, at + head, min(at + size, end)
        at += size


def sample_tables(stbl: dict[bytes, bytes], stream: int = 0) -> Index:
    """The index of a track from the payloads of its tables: runs of durations, shifts and samples a chunk, sizes, 32- or 64-bit chunk places, and the list of key samples (all, if there is none)."""
    pairs = lambda kind: np.frombuffer(stbl[kind], ">i4", offset=8).astype(np.int64).reshape(-1, 2) if kind in stbl else np.zeros((0, 2), np.int64)
    fixed, count = struct.unpack_from(">II", stbl[b"stsz"], 4)
    size = np.full(count, fixed, np.int64) if fixed else np.frombuffer(stbl[b"stsz"], ">u4", count, 12).astype(np.int64)
    chunks = np.frombuffer(stbl[b"co64"], ">u8", offset=8).astype(np.int64) if b"co64" in stbl else np.frombuffer(stbl[b"stco"], ">u4", offset=8).astype(np.int64)
    runs = np.frombuffer(stbl[b"stsc"], ">u4", offset=8).astype(np.int64).reshape(-1, 3)
    per = runs[np.searchsorted(runs[:, 0], np.arange(1, len(chunks) + 1), side="right") - 1, 1] if len(chunks) else np.zeros(0, np.int64)
    chunk = np.repeat(np.arange(len(chunks)), per)[:count]
    before = np.concatenate([[0], np.cumsum(size)[:-1]])[:count]
    first = np.concatenate([[0], np.cumsum(per)])[:-1][chunk]
    offset = chunks[chunk] + before[: len(chunk)] - before[first]
    spread = lambda t: np.concatenate([np.repeat(t[:, 1], t[:, 0]), np.zeros(count, np.int64)])[:count]
    duration, shift = spread(pairs(b"stts")), spread(pairs(b"ctts"))
    dts = np.concatenate([[0], np.cumsum(duration)[:-1]])[:count]
    key = np.ones(count, bool)
    if b"stss" in stbl:
        key = np.zeros(count, bool)
        key[np.frombuffer(stbl[b"stss"], ">u4", offset=8).astype(np.int64) - 1] = True
    return Index(offset, size[: len(offset)], dts, dts + shift, duration, key, stream)


def _mp4(f, length: int, packet: int) -> list[Index]:
    at, out = 0, []
    while at + 8 <= length:
        f.seek(at)
        size, kind = struct.unpack(">I4s", f.read(8))
        if size == 1:
            size = struct.unpack(">Q", f.read(8))[0]
        size = size or length - at
        if kind == b"moov":
            f.seek(at)
            data = f.read(size)
            for track, begin, end in _boxes(data, 8, len(data)):
                if track == b"trak":
                    tables, todo = {}, [(begin, end)]
                    while todo:
                        for name, a, b in _boxes(data, *todo.pop()):
                            if name in (b"mdia", b"minf", b"stbl"):
                                todo.append((a, b))
                            else:
                                tables[name] = data[a:b]
                    out.append(sample_tables(tables, len(out)))
        if size < 8:
            break
        at += size
    return out


INDEXES = {"ivf": _ivf, "wav": _wav, "mp4": _mp4}


@dataclass
class FileRange(InputPartition):
    file: str
    length: int
    begin: int
    end: int


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range, self.packet = options["path"], int(options.get("rangebytes", RANGE)), int(options.get("packet", 1024))

    def partitions(self) -> list[FileRange]:
        """Ranges of all files: those of the manifest, or all under the path but those with a name that begins with a dot or an underscore."""
        store, root = _open(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info]
        if info.type == fs.FileType.Directory:
            hidden = lambda x: any(p[0] in "._" for p in x.path.removeprefix(info.path).strip("/").split("/"))
            files = [x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and not hidden(x)]
            if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
                with store.open_input_stream(f"{root}/{MANIFEST}") as f:
                    listed = {p["name"] for p in json.loads(f.read())}
                files = [x for x in files if x.base_name in listed]
        return [FileRange(x.path, x.size, at, min(at + self.range, x.size)) for x in sorted(files, key=lambda x: x.path) for at in range(0, max(x.size, 1), self.range)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        with store.open_input_file(partition.file) as f:
            kind = probe(f.read(16))
            if kind is None:
                raise ValueError(f"no known format: {partition.file}")
            for x in INDEXES[kind](f, partition.length, self.packet):
                mine = np.flatnonzero((x.offset >= partition.begin) & (x.offset < partition.end))
                cuts = np.flatnonzero(np.diff(np.cumsum(x.size[mine]) // BATCH)) + 1
                for rows in np.split(mine, cuts):
                    if not len(rows):
                        continue
                    payload = []
                    for at, size in zip(x.offset[rows].tolist(), x.size[rows].tolist(), strict=True):
                        f.seek(at)
                        payload.append(f.read(size))
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([partition.file] * n), pa.array([x.stream] * n, pa.int32()), *[pa.array(v) for v in (rows.astype(np.int64), x.dts[rows], x.pts[rows], x.duration[rows], x.key[rows], x.size[rows])], pa.array(payload, pa.binary())], schema=_ARROW)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _runs(values: np.ndarray) -> np.ndarray:
    """(count, value) of equal values in a row."""
    edge = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, int)
    return np.stack([np.diff(np.append(edge, len(values))), values[edge]], axis=1) if len(edge) else np.zeros((0, 2), np.int64)


class _Part:
    """Samples go out batch by batch, their index at the end."""

    def __init__(self, out, layout: str, options: dict):
        self.out, self.layout, self.options, self.at = out, layout, options, 0
        self.sizes, self.duration, self.shift, self.key, self.chunks = [], [], [], [], []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self) -> None:
        if self.layout == "ivf":
            self._put(struct.pack("<4sHH4sHHIIII", b"DKIF", 0, 32, b"AV01", 0, 0, int(self.options.get("rate", 1000)), 1, 0, 0))
        elif self.layout == "mp4":
            self._put(_box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom"))

    def add(self, b: pa.RecordBatch) -> None:
        payload = [x or b"" for x in b.column("payload").to_pylist()]
        numbers = lambda name, other: b.column(name).cast(pa.int64()).fill_null(other).to_numpy() if name in b.schema.names else np.full(b.num_rows, other, np.int64)
        sizes = np.array([len(x) for x in payload], np.int64)
        if self.layout == "ivf":
            self._put(b"".join(struct.pack("<Iq", len(x), t) + x for x, t in zip(payload, numbers("pts", 0).tolist(), strict=True)))
        elif self.layout == "mp4":
            self._put(struct.pack(">I4sQ", 1, b"mdat", 16 + int(sizes.sum())))
            self.chunks.append((self.at, len(payload)))
            self._put(b"".join(payload))
            self.duration.append(numbers("duration", 1))
            self.shift.append(numbers("shift", 0))
            self.key.append(numbers("is_key", 1) > 0)
        else:
            self._put(b"".join(payload))
        self.sizes.append(sizes)

    def end(self) -> None:
        if self.layout != "mp4":
            return
        sizes, duration, shift, key = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.sizes, self.duration, self.shift, self.key))
        chunks = np.array(self.chunks, np.int64).reshape(-1, 2)
        table = lambda kind, rows, width: _box(kind, struct.pack(">II", 0, len(rows)), np.asarray(rows).astype(width).tobytes())
        per = _runs(chunks[:, 1])
        first = np.concatenate([[1], 1 + np.cumsum(per[:, 0])])[: len(per)]
        entry = _box(str(self.options.get("codec", "avc1")).encode()[:4].ljust(4), b"\0" * 6, struct.pack(">H", 1))
        stbl = _box(
            b"stbl", _box(b"stsd", struct.pack(">II", 0, 1), entry), table(b"stts", _runs(duration), ">u4"), table(b"ctts", _runs(shift), ">i4") if shift.any() else b"", table(b"stsc", np.stack([first, per[:, 1], np.ones(len(per), np.int64)], axis=1), ">u4"),
            _box(b"stsz", struct.pack(">III", 0, 0, len(sizes)), sizes.astype(">u4").tobytes()), table(b"co64", chunks[:, 0], ">u8"), b"" if key.all() else table(b"stss", np.flatnonzero(key) + 1, ">u4"),
        )
        scale, total = int(self.options.get("rate", 1000)), int(duration.sum())
        media = _box(b"mdia", _box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, scale, total & 0xFFFFFFFF, 0, 0)), _box(b"minf", stbl))
        self._put(_box(b"moov", _box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, scale, total & 0xFFFFFFFF)), _box(b"trak", media)))


def wav_head(size: int, rate: int, channels: int, bits: int) -> bytes:
    block = channels * bits // 8
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, channels, rate, rate * block, block, bits, b"data", size)


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    bytes: int


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.layout, self.options, self.overwrite = options["path"], options.get("layout", "mp4"), dict(options), overwrite
        if self.layout not in ("mp4", "ivf", "wav"):
            raise ValueError("layout must be mp4, ivf or wav")
        self.pending = f"_pending-{uuid.uuid4().hex}"
        store, root = _open(self.path)  # on the driver: a task that outlives a failed job must not make it anew
        store.create_dir(f"{root}/{self.pending}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        name = f"part-{uuid.uuid4().hex}.{self.layout}"
        whole = f"{root}/{self.pending}/{name}"
        body = f"{whole}.body" if self.layout == "wav" else whole
        rows = 0
        try:
            with store.open_output_stream(body) as out:
                part = _Part(out, self.layout, self.options)
                part.begin()
                for b in iterator:
                    part.add(b)
                    rows += b.num_rows
                part.end()
            if self.layout == "wav":  # its head tells the size of what follows
                with store.open_output_stream(whole) as out, store.open_input_stream(body) as f:
                    out.write(wav_head(part.at, *(int(self.options.get(k, d)) for k, d in (("rate", 8000), ("channels", 1), ("bits", 16)))))
                    while data := f.read(BATCH):
                        out.write(data)
                store.delete_file(body)
        except BaseException:
            for left in {body, whole}:
                if store.get_file_info(left).type == fs.FileType.File:
                    store.delete_file(left)
            raise
        return Written(name, rows, part.at)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        parts, old = [{"name": m.name, "rows": m.rows, "bytes": m.bytes} for m in messages if m], []
        manifest = f"{root}/{MANIFEST}"
        if store.get_file_info(manifest).type == fs.FileType.File:
            with store.open_input_stream(manifest) as f:
                old = json.loads(f.read())
        for p in parts:
            store.move(f"{root}/{self.pending}/{p['name']}", f"{root}/{p['name']}")
        with store.open_output_stream(f"{manifest}.new") as f:
            f.write(json.dumps(parts if self.overwrite else [*old, *parts]).encode())
        store.move(f"{manifest}.new", manifest)
        for p in old if self.overwrite else []:
            store.delete_file(f"{root}/{p['name']}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """What is pending goes, also of tasks that were run twice."""
        store, root = _open(self.path)
        if store.get_file_info(f"{root}/{self.pending}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.pending}")


class MediaSource(DataSource):
    """Options for reading: rangeBytes (bytes of a task's range), packet (frames of a wave's packet). For writing: layout (mp4, ivf, wav), rate, codec, channels, bits.

    Columns that are written: payload; for mp4 also duration, shift (of pts to dts) and is_key; for ivf pts.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)

    def writer(self, schema, overwrite: bool) -> MediaWriter:
        return MediaWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(MediaSource)
