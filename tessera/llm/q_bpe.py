"""Query 13: all ``documents`` as ids of a word BPE, and decoded again."""

import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm.bpe import encode


def op13_bpe(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encode(docs, path, decoded_col="decoded").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {"op13_bpe": op13_bpe}
