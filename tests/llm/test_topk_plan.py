"""Top-k search: no side of the join of blocks goes through the driver, however small it is on disk."""

import random

from tessera.llm.topk import top_k


def test_blocks_are_not_broadcast(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(300)], "vec_id long, embedding array<float>")
    found = top_k(df, df.where("vec_id % 20 = 0"), 5)
    assert found.count() == 75
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
