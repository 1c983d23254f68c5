"""Query 6: repeated passages of ``documents``."""

from pyspark.sql import functions as F

from tessera.llm.substring_dedup import substring_dedup


def op6_substring_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return substring_dedup(docs).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"), F.size("removed").alias("n_intervals"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
