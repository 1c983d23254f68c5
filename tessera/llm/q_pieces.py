"""Query 3: sampled segmentations of ``documents``, decoded again."""

import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm.pieces import decode, encode


def op3_sentencepiece(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("text_sha256", F.sha2("text", 256))
    coded = encode(docs, path, keep=("text_sha256",)).withColumn("n_pieces", F.size("ids").cast("long")).withColumn("ids_hash", F.xxhash64("ids"))
    out = decode(coded, path).withColumn("decoded_sha256", F.sha2("text", 256))
    return out.select("doc_id", "n_pieces", "ids_hash", "text_sha256", F.col("text_sha256").eqNullSafe(F.col("decoded_sha256")).alias("lossless"))


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
