"""Blocks of rows: a few megabytes of text in one binary value.

Operators that ask the whole corpus something about each block, and must then find the same rows
again, shuffle blocks instead of rows: compressed, and each as a unit. A block is bounded by
``most`` bytes of text (``BLOCK_BYTES``), or holds one row that is longer.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.store import partitions, shared_folder
from tessera.llm.text import segments, utf8

BLOCK_BYTES, LEVEL = 6 << 20, 6
SCHEMA = "block long, payload binary"


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    count, task = 0, TaskContext.get().partitionId()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))
    for batch in batches:
        _, offsets = utf8(batch.column("text"))
        for a, b in segments(offsets, most):
            part = batch.slice(a, b - a)
            part = part.take(pa.compute.sort_indices(part.column("id")))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + count], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "payload"])
            count += 1


def blocks(rows: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """``rows`` (columns id, a long, and text among others) as blocks, within which rows are ordered by id."""
    return rows.mapInArrow(lambda batches: _pack(batches, most), SCHEMA)


def _groups(spark: SparkSession) -> int:
    return min(partitions(spark), 100_000)


def group_of(spark: SparkSession) -> Column:
    """The group of the column ``block``."""
    return F.pmod(F.xxhash64("block"), F.lit(_groups(spark)))


def grouped(rows: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """``rows`` as blocks in ``group``s, as many as shuffle partitions, written once to the shared folder.

    The table is bucketed by group, so that several jobs can join blocks by group without a shuffle
    of their own; a task writes a file for each group that it has blocks of.
    """
    spark = rows.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    held = blocks(rows, most).withColumn("group", group_of(spark))
    held.write.bucketBy(_groups(spark), "group").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def unpack(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(payload) as stream:
        return stream.read_next_batch()


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers as their lowest bytes, then their second ones and so on, which compresses well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)
