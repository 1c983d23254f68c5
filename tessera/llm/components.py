"""Connected components of a graph given by its edges, by alternating large-star and small-star steps.

Each step groups by node with a minimum, which combines before it shuffles, so the hub of a large
star is no hot key; written tables cut the lineage of the loop. The number of rounds is logarithmic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.llm.store import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v: links the neighbours of each node to the least of them."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _kept(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges as a written table, and sums, taken while writing, that tell two tables apart."""
    seen = Observation()
    hashed = F.xxhash64("u", "v")
    sums = (F.count(F.lit(1)).alias("n"), F.sum(hashed % 1_000_003).alias("s"), F.sum(F.shiftright(hashed, 32)).alias("t"))
    return written(edges.observe(seen, *sums), "edges"), seen.get


def components(edges: DataFrame) -> DataFrame:
    """For each node of ``edges`` (a, b, both long): c, label, the least node it is connected with."""
    now, sums = _kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        now, after = _kept(_star(_star(now, True), False))
        if after == sums:
            break
        sums = after
    return now.select(F.col("u").alias("c"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("c"), F.col("v").alias("label")).distinct())
