"""Query 11: spelling variants among the words of all ``documents``."""

from tessera.llm.spelling import variants, words


def op11_spelling(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(words(docs, "doc_id", "text"))


QUERIES = {"op11_spelling": op11_spelling}
