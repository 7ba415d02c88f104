"""Container files as DataFrames, and back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containers

_PACKETS = "seq long, stream_index int, pts long, dts long, duration long, is_key boolean, data binary, error string"
_FIELDS = ["seq", "stream_index", "pts", "dts", "duration", "is_key", "data", "error"]


def parse(df: DataFrame, content: str = "content", name: str | None = None, keys: tuple[str, ...] = (), format_: str | None = None) -> DataFrame:
    """keys and a row for each packet of the files in a binary column. The format is probed if not named.

    A file that can't be read gives the packets before the fault and a row with its
    error; a null one gives nothing.
    """
    rows = df.select(*keys, F.col(content).alias("_content"), (F.col(name) if name else F.lit("")).alias("_name")).where("_content is not null")
    at = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out, data = [], batch.column(at)[i].as_py()
                kind = format_ or containers.probe(data, batch.column(at + 1)[i].as_py() or "")[0]
                try:
                    if kind not in containers.READERS:
                        raise ValueError("no known format")
                    for p in containers.READERS[kind](data):
                        out.append((len(out), *p, None))
                except (ValueError, IndexError, KeyError) as e:
                    out.append((len(out), None, None, None, None, None, None, str(e) or type(e).__name__))
                except Exception as e:  # struct's own error has no public base
                    if type(e).__name__ != "error":
                        raise
                    out.append((len(out), None, None, None, None, None, None, str(e)))
                if out:
                    same = [batch.column(j).take(pa.array([i] * len(out))) for j in range(at)]
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([*same, *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]], [*keys, *_FIELDS])

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:at])
    return rows.mapInArrow(run, head + _PACKETS)


def read_media(spark: SparkSession, path: str, format_: str | None = None, pattern: str | None = None) -> DataFrame:
    """Packets of all files under a path, with the path of each."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return parse(files, "content", "path", ("path",), format_)


def save_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes each row's bytes to a file of its name; (name, size) of what was written.

    Files are written by the tasks through pyarrow's file systems under a passing
    name, and moved when whole, so a task that is run again leaves no half file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            done = []
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/.{n}.part") as f:
                    f.write(data or b"")
                store.move(f"{root}/.{n}.part", f"{root}/{n}")
                done.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.int64())], ["name", "size"])

    return df.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content")).mapInArrow(run, "name string, size long")
