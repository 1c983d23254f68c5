"""Joins with a table of one row a key, where one key may hold a third of all rows; folds over sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64


def lookup(rows: DataFrame, table: DataFrame, key: str, spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each ``key``; how: inner, left, left_semi or left_anti.

    The key's row goes to each of the salts that occur with the key, ``salts`` at most, and the rows of
    a key meet it in as many tasks, by a hash of the column ``spread``. Null keys meet nothing. Both joins
    are merges: a table that grows with the rows is never gathered on the driver to be broadcast.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(salts))
    salted = rows.withColumn("__salt", salt)
    held = salted.where(F.col(key).isNotNull()).select(key, "__salt").distinct().join(table.hint("merge"), key)
    return salted.join(held.hint("merge"), [key, "__salt"], how).drop("__salt")


def folded_in_order(df: DataFrame, group: str, order: list[str], fold: Callable[[Iterator[dict]], Iterator[int]], out: str) -> DataFrame:
    """``out``: the numbers that ``fold`` gives for each group's rows, which it is handed one by one in order.

    Groups share sorted partitions, so many small ones cost no more than their rows, and of a large one only what ``fold`` keeps is held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        held: list[int] = []
        for _, own in groupby(rows, key=lambda r: r[group]):
            held.extend(fold(own))
            if len(held) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64())], [out])
                held = []
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64())], [out])

    return df.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, f"`{out}` long")
