"""Tables written to the shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.records import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: later plans start from these files."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made, once no later plan reads it."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release() -> None:
    """Give freed memory of a Python worker back: workers live on, and the allocators keep what tasks have freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2) -> Iterator[None]:
    """Meanwhile, ``rows`` rows to an Arrow batch: for tables whose rows hold megabytes each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def limited(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked to be sent to all executors if it has at most ``rows`` rows; beyond, Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def text_digest(text_col: str) -> Column:
    """SHA-256 of a text: with the id it tells rows apart where ids are null or repeated."""
    return F.unhex(F.sha2(F.col(text_col).cast("string"), 256))


def column(df: DataFrame, name: str, kind: str) -> Column:
    """A column by name, cast; null where the table hasn't got it."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its owner sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


LONG, STRING, BINARY = T.LongType(), T.StringType(), T.BinaryType()
