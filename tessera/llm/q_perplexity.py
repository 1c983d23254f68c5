"""Query 1: quality of ``documents`` by perplexity."""

from tessera.llm.perplexity import quality


def op1_quality_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
