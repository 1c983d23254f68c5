"""Connected components in the core library: of edges, or of rows that share one of several keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.records import written
from tessera.operators.skew import SALTS, lookup


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and that one has none, so that it is the label."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, label of the undirected edges (a, b): the label is the least node that a node is connected with.

    In turn, each node links its larger neighbours, and then its smaller ones, to the least of them and
    itself. The rounds are logarithmic in the length of the longest path; each is written.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = lookup(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup(large, least, "u", "v").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    labels = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(labels.select(F.col("v").alias("node"), F.col("v").alias("label")))


def linked_by_keys(df: DataFrame, node: str, keys: str, salts: int = SALTS) -> DataFrame:
    """node, label of all rows: rows are linked if they share one of the array ``keys``, directly or through others.

    Nodes are distinct. Null keys and null or empty arrays link nothing; such a node is its own label. A key's
    rows are linked to the least of their salt, and these to the key's least, so a key that a third of
    all rows share is spread over ``salts`` groups.
    """
    held = df.select(F.col(node).alias("node"), F.explode(F.array_distinct(keys)).alias("k")).where("k is not null")
    held = held.withColumn("s", F.pmod(F.xxhash64("node"), F.lit(salts)))
    near = held.select("k", "s", "node", F.min("node").over(Window.partitionBy("k", "s")).alias("least"))
    tops = held.groupBy("k", "s").agg(F.min("node").alias("node")).select("node", F.min("node").over(Window.partitionBy("k")).alias("least"))
    edges = near.select("node", "least").unionByName(tops).select(F.col("node").alias("a"), F.col("least").alias("b"))
    found = components(edges)
    return df.select(F.col(node).alias("node")).join(found.hint("merge"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
