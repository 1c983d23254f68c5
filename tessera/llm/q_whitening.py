"""Query 12: ``embeddings`` whitened by their 32 leading components."""

from pyspark.sql import functions as F

from tessera.llm.whitening import fit, fixed_point, identity_error, whiten


def op12_whitening(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", fixed_point(F.col("embedding"), 64, 1_000_000).alias("x"))
    model = fit(rows, "vec_id", "x", 32)
    error = identity_error(rows, "vec_id", "x", model)
    shares = F.array(*(F.lit(float(e / model.trace)) for e in model.values)).cast("array<double>")
    out = whiten(rows, "vec_id", "x", model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, "at").alias("explained"), F.lit(error).alias("identity_error"),
    )


QUERIES = {"op12_whitening": op12_whitening}
