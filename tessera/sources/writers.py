"""Writers: append-only lines, versioned documents, one-time backfills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines after those that are there; nulls are written."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def append_messages(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("session_id").parquet(path)


def backfill(legacy: DataFrame, target: DataFrame, now_ms: int) -> DataFrame:
    """Messages of sessions that the target hasn't got, a second apart, the last one at ``now_ms``."""
    new = legacy.join(target.select("session_id").distinct(), "session_id", "left_anti")
    own = Window.partitionBy("session_id")
    n, i = F.count("*").over(own), F.row_number().over(own.orderBy("line")) - 1
    return new.withColumn("ts", (F.lit(now_ms) - (n - i - 1) * 1000).cast("long"))


def snapshot(df: DataFrame, current: str, history: str) -> None:
    """The current state replaced, and added to the history."""
    df.write.mode("append").json(history)
    df.write.mode("overwrite").json(current)


def regression_dataset(audit: DataFrame, path: str, columns: list[str]) -> None:
    append_lines(audit.select(*columns), path)
