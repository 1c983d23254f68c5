"""A dashboard that is computed anew as its log grows: a stream of the log's files in complete mode, one result folder a batch.

A batch that is run again after a failure replaces its own folder, so each batch is there once. Readers take the last complete one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.history import _folders


def recomputed(stream: DataFrame, summary: Callable[[DataFrame], DataFrame], path: str, poll: str | None = None) -> StreamingQuery:
    """Start the query: ``summary`` of all rows so far, an aggregation, after each change of the log.

    Below ``path`` lie the checkpoint and the results. ``poll`` is the time between two looks at the log; without it the query takes what
    is there and ends. Started again, it goes on where it was.
    """
    def sink(result: DataFrame, batch: int) -> None:
        result.write.mode("overwrite").parquet(f"{path}/results/batch={batch}")

    writer = summary(stream).writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last complete result."""
    found = _folders(spark, f"{path}/results")
    if not found:
        raise FileNotFoundError(f"no result in {path}")
    return spark.read.parquet(f"{path}/results/batch={found[-1]}")
