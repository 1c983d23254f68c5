"""Success models of strategies: features, one logistic regression for each category, and the best choice."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import score as S

#: The strategies of the one-hot block, and the codes of earlier reliability.
STRATEGIES = ("api_price", "force_search", "prefer_search", "free")
PRIOR = {"unreliable": -1, "low_content": 0, "ok": 1, "ok_weak": 1, "ok_strong": 2}
LATENCY_COST, MONEY_COST, LEAST_ROWS, LEAST_FOLDED, FOLDS = 0.3, 0.3, 10, 20, 5
STEPS, SMALL = 30, 1e-9
NAMES = (*(f"is_{s}" for s in STRATEGIES), "latency", "cost", "prior", "failures", "reliability")


def features(audit: DataFrame) -> DataFrame:
    """One-hot strategy and five scaled features beside the keys."""
    code = F.coalesce(*(F.when(F.coalesce("prior_reliability", F.lit("ok")) == k, F.lit(float(v))) for k, v in PRIOR.items()), F.lit(0.0))
    return audit.select(
        "request_id", "category", "strategy", "quality_target", *(F.when(F.col("strategy") == s, 1.0).otherwise(0.0).alias(f"is_{s}") for s in STRATEGIES),
        S.capped(F.col("duration_ms"), S.MILLIS).alias("latency"), S.capped(F.col("estimated_cost_usd"), S.DOLLARS).alias("cost"), (F.coalesce("prior_score", F.lit(0.0)) / 3).alias("prior"),
        F.least(F.coalesce("consecutive_failures", F.lit(0)) / 5.0, F.lit(1.0)).alias("failures"), code.alias("reliability"),
    )


class Model(NamedTuple):
    """A category's model; ``accuracy`` is the mean over the folds that were left out, where there are enough rows."""

    intercept: float
    coefficients: tuple[float, ...]
    rows: int
    accuracy: float | None


def train(audit: DataFrame) -> dict[str, Model]:
    """A model for each category with enough rows of both outcomes; categories are few.

    Logistic regression, the squared coefficients (not the intercept) penalised by a half, by Newton's
    method: for all categories, and for the FOLDS models of cross-validation of each, one aggregation
    a step gives gradients and second derivatives, and the driver solves a system of ten unknowns for
    each model. Folds go by a hash of the request's id.
    """
    rows = features(audit).select("category", F.col("quality_target").cast("double").alias("y"), F.pmod(F.xxhash64("request_id"), F.lit(FOLDS)).alias("fold"), *NAMES).where("y is not null")
    sizes = {r["category"]: r["n"] for r in rows.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("y").alias("classes")).where((F.col("n") >= LEAST_ROWS) & (F.col("classes") == 2)).collect()}
    if not sizes:
        return {}
    known = {(c, m): np.zeros(len(NAMES) + 1) for c, n in sizes.items() for m in range(FOLDS + 1 if n >= LEAST_FOLDED else 1)}  # model 0 is of all rows, model k leaves out fold k - 1
    place = [F.lit(1.0), *(F.col(f"`{n}`") for n in NAMES)]
    z = sum(F.col("w")[i] * x for i, x in enumerate(place))
    p = 1 / (1 + F.exp(-z))
    pairs = [(i, j) for i in range(len(place)) for j in range(i + 1)]
    for _ in range(STEPS):
        learnt = rows.join(F.broadcast(_weights(rows.sparkSession, known)), "category").where("fold <> model - 1").withColumn("p", p)
        first = [F.sum((F.col("p") - F.col("y")) * x) for x in place]
        second = [F.sum(F.col("p") * (1 - F.col("p")) * place[i] * place[j]) for i, j in pairs]
        largest = 0.0
        for r in learnt.groupBy("category", "model").agg(F.array(*first).alias("g"), F.array(*second).alias("h")).collect():
            w = known[r["category"], r["model"]]
            penalty = np.r_[0.0, np.ones(len(NAMES))]
            hessian = np.diag(penalty + 1e-9)
            for (i, j), v in zip(pairs, r["h"], strict=True):
                hessian[i, j] += v
                hessian[j, i] += v * (i != j)
            change = np.linalg.solve(hessian, np.array(r["g"]) + penalty * w)
            largest = max(largest, float(np.abs(change).max()))
            known[r["category"], r["model"]] = w - change
        if largest < SMALL:
            break
    left_out = rows.join(F.broadcast(_weights(rows.sparkSession, known)), "category").where("fold = model - 1")
    right = left_out.groupBy("category", "model").agg(F.avg(((z > 0) == (F.col("y") > 0.5)).cast("double")).alias("a")).groupBy("category").agg(F.avg("a").alias("a")).collect()
    accuracy = {r["category"]: r["a"] for r in right}
    return {c: Model(float(known[c, 0][0]), tuple(known[c, 0][1:].tolist()), n, accuracy.get(c)) for c, n in sizes.items()}


def _weights(spark, known: dict) -> DataFrame:
    return spark.createDataFrame([(c, m, w.tolist()) for (c, m), w in known.items()], "category string, model int, w array<double>")


def best_strategies(models: dict[str, Model], contexts: DataFrame) -> DataFrame:
    """For each context the strategy of the best probability less costs, the first of equal ones; without a model, free."""
    rows = features(contexts.withColumn("strategy", F.lit(None).cast("string")))
    weights = _weights(contexts.sparkSession, {(c, 0): np.array([m.intercept, *m.coefficients]) for c, m in models.items()}).drop("model")
    own = [F.col(f"`{n}`") for n in NAMES[len(STRATEGIES) :]]
    base = F.col("w")[0] + sum(F.col("w")[1 + len(STRATEGIES) + i] * x for i, x in enumerate(own))
    costs = F.lit(MONEY_COST) * F.col("cost") + F.lit(LATENCY_COST) * F.col("latency")
    value = [1 / (1 + F.exp(-(base + F.col("w")[1 + i]))) - costs for i in range(len(STRATEGIES))]
    best = F.array_max(F.array(*(F.struct(v.alias("value"), F.lit(-i).alias("place"), F.lit(s).alias("strategy")) for i, (v, s) in enumerate(zip(value, STRATEGIES, strict=True)))))
    out = rows.join(F.broadcast(weights), "category", "left").withColumn("best", F.when(F.col("w").isNotNull(), best))
    return out.select("request_id", "category", F.coalesce("best.strategy", F.lit("free")).alias("strategy"), F.round("best.value", 6).alias("value"))
