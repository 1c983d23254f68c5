"""Versions of records: a history that only grows, the intervals in which each version holds, and the current state.

The history is the one truth; the state is a copy of its newest versions, and is read with the batches that came after it, so a job that ends
between the two writes leaves nothing wrong. A batch is a folder of its own: writing it again, as a job that is run again does, replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete batches below ``path``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(conf)
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root) if s.isDirectory()]
    done = [n for n in names if n.startswith("batch=") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("batch=")) for n in done)


def _read(spark: SparkSession, path: str, batches: list[int]) -> DataFrame | None:
    return spark.read.option("basePath", path).parquet(*(f"{path}/batch={b}" for b in batches)) if batches else None


def save(df: DataFrame, path: str, batch: int, keys: list[str], at: str) -> None:
    """Batch number ``batch`` added to the history below ``path``, then the state renewed. Batches are numbered in their order."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/history/batch={batch}")
    current(spark, path, keys, at).write.mode("overwrite").parquet(f"{path}/current/batch={batch}")


def history(spark: SparkSession, path: str) -> DataFrame:
    """All saved rows, with their batch; an error where none was saved."""
    found = _read(spark, f"{path}/history", _folders(spark, f"{path}/history"))
    if found is None:
        raise FileNotFoundError(f"no history in {path}")
    return found


def newest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """For each key the row of the greatest (``at``, batch)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, "batch")).alias("r")).select(*keys, *(F.col(f"r.{c}") for c in rest))


def current(spark: SparkSession, path: str, keys: list[str], at: str) -> DataFrame:
    """The newest version of each key: of the last complete state and the batches after it."""
    batches, states = _folders(spark, f"{path}/history"), _folders(spark, f"{path}/current")
    held = [s for s in states if s in batches]
    since = [b for b in batches if not held or b > held[-1]]
    rows = _read(spark, f"{path}/history", since)
    if held:
        state = spark.read.parquet(f"{path}/current/batch={held[-1]}")
        rows = state if rows is None else rows.unionByName(state.select(*rows.columns))
    if rows is None:
        raise FileNotFoundError(f"no history in {path}")
    return newest(rows, keys, at)


def intervals(rows: DataFrame, keys: list[str], at: str, order: str, values: list[str]) -> DataFrame:
    """keys, values, valid_from, valid_to, is_current, version: the versions of each key.

    Rows that repeat the values of the one before open no version. A version holds from its ``at`` to the next one's, which is not
    in it; the last one's end is null. Of rows with one ``at``, the greatest ``order`` counts. Null values are values; rows without ``at`` tell nothing.
    """
    own = Window.partitionBy(*keys).orderBy(at)
    last = rows.where(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.max_by(F.struct(*values), F.col(order)).alias("__v"))
    changed = ~F.col("__v").eqNullSafe(F.lag("__v").over(own)) | (F.row_number().over(own) == 1)
    kept = last.withColumn("__new", changed).where("__new")
    return kept.select(*keys, *(F.col(f"__v.{v}").alias(v) for v in values), F.col(at).alias("valid_from"), F.lead(at).over(own).alias("valid_to"), F.lead(at).over(own).isNull().alias("is_current"), F.row_number().over(own).alias("version"))


def as_of(versions: DataFrame, moment: Column) -> DataFrame:
    """The version of each key that holds at ``moment``; keys that begin later have none."""
    return versions.where((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (moment < F.col("valid_to"))))
