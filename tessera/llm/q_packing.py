"""Query 8: all ``documents`` packed into sequences of 2048 tokens."""

import public_tokenizers

from tessera.llm.packing import pack_documents


def op8_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op8_packing": op8_packing}
