"""Query 2: secrets in ``documents``."""

from pyspark.sql import functions as F

from tessera.llm.secrets import KINDS, scan_secrets


def op2_secret_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    names = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: count(lambda s: s["kind"] == k)  # a second parameter of the inner one would be the place
    return scan_secrets(docs).select(
        "doc_id",
        *(of_kind(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_example"),
    )


QUERIES = {"op2_secret_scan": op2_secret_scan}
