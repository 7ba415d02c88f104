"""Helpers that the operators share: scratch tables in the shared folder, and safe column selection."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one is made in local mode only; a cluster must name its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="spark-shared-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Arrow batches of ``size`` bytes at most from now on in this session (a sixteenth of what Spark has by default), so that long texts don't add up in a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        spark.conf.set(key, str(size))


def bounded_rows(spark: SparkSession, rows: int = 512) -> None:
    """Parquet is read by so many rows at once from now on in this session (4,096 by default): long texts and lists then take less of an executor's heap."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df once as Parquet in the shared folder (in a folder for each value of the columns ``by``) and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, per: int = 50_000) -> DataFrame:
    """df in as few tasks as ``rows``, at most, need if each takes ``per``; never more than a shuffle has. For the small tables of iterations, whose tasks would cost more than their rows."""
    tasks = max(1, math.ceil(rows / per))
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a small iterative table."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for a query, and bounded batches for what it runs."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod. A null id counts as the empty text: 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod
