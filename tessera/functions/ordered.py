"""Positions and rolling frames over a whole table's order, without one task for all rows.

Rows fall into buckets of time; a bucket's offset is the number of rows in earlier buckets, from a
table with a row for each bucket. A rolling frame is computed in chunks of consecutive positions, each
with the few rows before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_MS, CHUNK = 3_600_000, 100_000


def with_position(df: DataFrame, time: str, tie: str, name: str = "run", bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``name``: each row's position, from 1, in the order of (time, tie)."""
    rows = df.withColumn("__bucket", F.floor(F.col(time) / bucket_ms))
    sizes = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__bucket").orderBy(time, tie)
    return rows.withColumn("__in", F.row_number().over(inside)).join(offsets, "__bucket").withColumn(name, F.col("__before") + F.col("__in")).drop("__bucket", "__before", "__in")


def rolling(df: DataFrame, position: str, size: int, outputs: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """Aggregates over each row and the ``size - 1`` rows before it, by position."""
    at = F.floor((F.col(position) - 1) / chunk)
    into = F.when((F.col(position) - 1) % chunk >= chunk - size + 1, F.array(at, at + 1)).otherwise(F.array(at))
    copies = df.withColumn("__own", at).withColumn("__chunk", F.explode(into))
    frame = Window.partitionBy("__chunk").orderBy(position).rowsBetween(1 - size, 0)
    for name, value in outputs.items():
        copies = copies.withColumn(name, value.over(frame))
    return copies.where("__own = __chunk").drop("__own", "__chunk")
