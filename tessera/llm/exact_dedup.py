"""Exact deduplication by skew-safe combining, in DataFrame operations only.

1. Locally: within each input partition, rows of one digest and one content combine to one row (the
   partial aggregate of step 2 does this before anything moves).
2. Salted: the local rows of a digest meet in ``salts`` groups, by input partition, so that a digest
   which a third of all rows share is combined by many tasks.
3. Globally: the salt winners of a digest, ``salts`` rows at most, combine.

Steps 1 to 3 group by the whole content beside the digest, so a digest that two contents share never
joins them. A row then finds its group by digest alone where the digest has one content, which steps
1 to 3 have shown, and by digest and content where it has more. The first, the usual way, is salted
too: the rows of a digest meet its group in up to 64 tasks.

Null text counts as empty. Among rows of one content the largest id stays; where ids tie, as in
repeated rows, each of the tied rows is marked as kept, and ``deduplicated`` keeps one. A null id is smaller than any other; a group of null ids only keeps null.
An empty table gives an empty result. Only the id and the text column are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import written
from tessera.operators.skew import lookup

SALTS = 64


def winners(df: DataFrame, id_col: str, text: Column, salts: int = SALTS) -> DataFrame:
    """One row for each distinct content: digest, content, keep_id, group_size."""
    rows = df.select(F.col(id_col).alias("id"), text.alias("content"))
    rows = rows.select("id", "content", F.unhex(F.sha2("content", 256)).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("digest", "salt", "content").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    return salted.repartition("digest").groupBy("digest", "content").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=lambda text: text, salts: int = SALTS) -> DataFrame:
    """A row for each input row: id, keep_id, group_size, kept, text_sha256.

    ``normalise`` maps the text column to what is compared; it is the text itself unless given.
    """
    text = normalise(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    groups = winners(df, id_col, text, salts)
    by_digest = groups.groupBy("digest").agg(F.count("*").alias("contents"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    by_digest = written(by_digest, "dedup")
    shared = by_digest.where("contents > 1").select("digest")
    rows = df.select(F.col(id_col).alias("id"), text.alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))
    if shared.isEmpty():
        joined = lookup(rows.drop("content"), by_digest.drop("contents"), "digest", "id")
    else:
        exact = groups.join(shared, "digest", "left_semi")
        joined = lookup(rows.drop("content"), by_digest.where("contents = 1").drop("contents"), "digest", "id").unionByName(
            rows.join(shared, "digest", "left_semi").join(exact, ["digest", "content"]).drop("content")
        )
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows of which the id is the one kept, once each, with all columns.

    A row without an id stays, once for each text, if no row of its text has an id.
    """
    found = exact_dedup(df, id_col, text_col).where("kept")
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    kept = found.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__kept")).distinct()
    rows = df.withColumn("__digest", digest)
    with_id = rows.join(kept, (F.col(id_col) == F.col("__id")) & (F.col("__digest") == F.col("__kept")), "left_semi").dropDuplicates([id_col, "__digest"])
    nameless = found.where(F.col(id_col).isNull()).select(F.col("text_sha256").alias("__kept")).distinct()
    without = rows.where(F.col(id_col).isNull()).join(nameless, F.col("__digest") == F.col("__kept"), "left_semi").dropDuplicates(["__digest"])
    return with_id.unionByName(without).drop("__digest")
