"""Groups in turns, first rows of keys and the limit, against plain Python."""

import random

from pyspark.sql import functions as F

from tessera.operators import records, rules


def brute(rows, most):
    groups = {}
    for p, g, k in sorted(rows, key=lambda x: x[0]):
        groups.setdefault(g, []).append((p, k))
    order = sorted(((n, g is not None, g or "", p, k) for g, own in groups.items() for n, (p, k) in enumerate(own)), key=lambda x: x[:3])
    seen, out = set(), []
    for turn, (_, _, _, p, k) in enumerate(order, 1):
        if not k or k not in seen:
            out.append((p, turn))
        seen.add(k)
    return {p: turn for turn, (*_, p, _) in enumerate(order, 1)}, out[:most]


def test_pages_and_turns(spark):
    r = random.Random(6)
    for keys, most in ((5, 30), (40, 7), (400, 30)):
        rows = [(p, r.choice(["a", "a", "a", "b", None, "c"]), r.choice([None, "", *(f"k{i}" for i in range(keys))])) for p in r.sample(range(2000), 500)]
        df = spark.createDataFrame(rows, "pos long, g string, key string")
        turns, want = brute(rows, most)
        assert {x.pos: x.turn for x in records.interleaved(df, "g", "pos").collect()} == turns
        got = rules.interleaved_page(df, "g", "pos", F.col("key"), most)
        assert [(x.pos, x.turn) for x in got.collect()] == want and got.columns == ["pos", "g", "key", "turn"]


def test_no_task_takes_a_whole_group(spark, monkeypatch):
    plans, plain = [], records.written
    monkeypatch.setattr(records, "written", lambda df, name: plans.append(df._jdf.queryExecution().analyzed().toString()) or plain(df, name))
    df = spark.range(100).select("id", F.lit("one").alias("g"))
    plans.append(records.interleaved(df, "g", "id")._jdf.queryExecution().analyzed().toString())
    assert not any("windowspecdefinition(g#" in p for p in plans)
