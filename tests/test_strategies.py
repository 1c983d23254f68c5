"""Every audit row gets a strategy, the one that plain Python finds with the same coefficients."""

import math

from pyspark.sql import functions as F

from tessera.operators import learning as L
from tessera.plans import q_state
from tessera.plans.views import view

DATA = "/root/testdata/sf0.001"


def test_all_rows_are_scored(spark, monkeypatch):
    made = {}
    train = L.train
    monkeypatch.setattr(L, "train", lambda rows: made.setdefault("models", train(rows)))
    got = {r.request_id: (r.strategy, r.value) for r in q_state.ml3(spark, DATA).collect()}
    audit = view(spark, DATA, "audit").withColumn("prior_reliability", F.lit("ok")).withColumn("consecutive_failures", F.lit(0))
    assert len(got) == audit.count()
    for r in L.features(audit).collect():
        model = made["models"].get(r.category)
        if model is None:
            assert got[r.request_id] == ("free", None)
            continue
        values = []
        for s in L.STRATEGIES:
            x = [float(s == k) for k in L.STRATEGIES] + [r.latency, r.cost, r.prior, r.failures, r.reliability]
            z = model.intercept + sum(a * b for a, b in zip(model.coefficients, x, strict=True))
            values.append(1 / (1 + math.exp(-z)) - L.MONEY_COST * r.cost - L.LATENCY_COST * r.latency)
        strategy, value = got[r.request_id]
        assert abs(value - max(values)) < 1e-5 and abs(values[L.STRATEGIES.index(strategy)] - max(values)) < 1e-5


def test_models_are_the_optimum(spark):
    """At the coefficients found the penalised log loss has no slope, and left-out folds are judged."""
    import numpy as np

    audit = view(spark, DATA, "audit").where("strategy is not null").withColumn("prior_reliability", F.lit("ok")).withColumn("consecutive_failures", F.lit(0))
    models = L.train(audit)
    rows = L.features(audit).toPandas()
    assert set(models) == {c for c, g in rows.groupby("category") if len(g) >= 10 and g.quality_target.nunique() == 2} and models
    for category, m in models.items():
        own = rows[rows.category == category]
        x = np.c_[np.ones(len(own)), own[list(L.NAMES)].to_numpy(float)]
        w = np.r_[m.intercept, m.coefficients]
        slope = x.T @ (1 / (1 + np.exp(-x @ w)) - own.quality_target.to_numpy(float)) + np.r_[0, w[1:]]
        assert np.abs(slope).max() < 1e-6 and m.rows == len(own) and 0.5 < m.accuracy <= 1
    assert L.train(audit.limit(0)) == {}
    assert {r.strategy for r in L.best_strategies({}, audit.limit(3)).collect()} == {"free"}
