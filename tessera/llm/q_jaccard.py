"""Query 4: near copies among ``documents``."""

from tessera.llm.jaccard_join import jaccard_components


def op4_jaccard_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, words=3, num=90, den=100)


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
