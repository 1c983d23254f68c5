"""The corpus pipeline: quality, exact copies, near copies, secrets, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps
of ``docs``, the last one the packed pieces. ``run`` applies them to ``documents``, each result written
to the shared folder and read again. Every stage is its operator and nothing else, so nulls, empty
and long texts, ties, repeated rows, empty tables and further columns are defined there.
"""

from pyspark.sql import functions as F

import public_tokenizers
from tessera.llm.exact_dedup import deduplicated
from tessera.llm.jaccard_join import one_of_each
from tessera.llm.packing import pack_documents
from tessera.llm.perplexity import kept_by_quality
from tessera.llm.secrets import redacted
from tessera.llm.store import written

#: SQL can't express the language model, so the pipeline is tested stage by stage.
ORACLE_SQL = None


def quality_classifier(spark, docs, sf_dir):
    """Documents that the language model doesn't reject."""
    return kept_by_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def exact_dedup(spark, docs, sf_dir):
    """One document of each text."""
    return deduplicated(docs)


def ngram_jaccard_join(spark, docs, sf_dir):
    """One document of each group of near copies: five words, a similarity of 0.8 or more."""
    return one_of_each(docs, words=5, num=80, den=100)


def secret_scans(spark, docs, sf_dir):
    """All documents, live-looking secrets replaced."""
    clean = redacted(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def packing(spark, docs, sf_dir):
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("packing", packing),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
