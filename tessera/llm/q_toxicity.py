"""Query 9: toxicity of ``documents``."""

from tessera.llm.toxicity import score_toxicity


def op9_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


QUERIES = {"op9_toxicity": op9_toxicity}
