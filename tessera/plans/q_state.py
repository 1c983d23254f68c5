"""Stateful and learning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import learning as L
from tessera.plans.registry import query
from tessera.plans.views import view
from tessera.streaming.tracker import folded


def turns(spark, sf_dir):
    a = view(spark, sf_dir, "audit")
    return a.select(F.concat_ws("-", "category", F.col("session_id").cast("string")).alias("key"), F.col("request_id").alias("turn"), F.col("raw_words").alias("words"), "duration_ms", F.col("estimated_cost_usd").alias("cost_usd"), F.coalesce(F.col("source_type") == "structured", F.lit(False)).alias("structured"))


@query("ST01_tracker_fold")
def st01(spark, sf_dir):
    return folded(turns(spark, sf_dir), "key")


@query("ML1_features", None)
def ml1(spark, sf_dir):
    a = view(spark, sf_dir, "audit").withColumn("prior_reliability", F.lit("ok")).withColumn("consecutive_failures", F.lit(0))
    return L.features(a)


@query("ML2_ML3_best_strategies")
def ml3(spark, sf_dir):
    a = view(spark, sf_dir, "audit").withColumn("prior_reliability", F.lit("ok")).withColumn("consecutive_failures", F.lit(0))
    return L.best_strategies(L.train(a.where("strategy is not null")), a)


@query("ML2_cross_validated")
def ml2(spark, sf_dir):
    a = view(spark, sf_dir, "audit").withColumn("prior_reliability", F.lit("ok")).withColumn("consecutive_failures", F.lit(0))
    found = L.train(a.where("strategy is not null"))
    return spark.createDataFrame([(c, m.rows, m.accuracy, m.intercept, list(m.coefficients)) for c, m in found.items()], "category string, n long, accuracy double, intercept double, coefficients array<double>")
