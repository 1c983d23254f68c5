"""Keys that several classes hold: dealt once, and their tables gone when no later step reads them."""

import os
import random

from tessera.llm import jaccard_join as J
from tessera.operators.records import shared_folder


def test_keys_of_several_classes(spark):
    r = random.Random(8)
    rows = [(c, None if c == 7 else c, 50 + c % 3, [r.randrange(400) for _ in range(5)] + [1000 + c] + [999] * (c % 4 > 0)) for c in range(300)]
    rows = [(c, i, n, list(dict.fromkeys(keys))) for c, i, n, keys in rows]
    got = J._shared(spark.createDataFrame(rows, "c long, id long, n int, keys array<long>"))
    held = {}
    for c, i, n, keys in rows:
        for at, key in enumerate(keys) if i is not None else ():
            held.setdefault(key, []).append((at, c, n))
    want = {(key, c, n, at, min(own)) for key, own in held.items() if len(own) > 1 for at, c, n in own}
    assert {(x.key, x.c, x.n, x.i, tuple(x.hub)) for x in got.collect()} == want and len(want) > 1000
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # the plan as it began and as it ended


def test_tables_of_keys_and_sets_are_gone(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join([*words[:39], "x"]), "a b c d e f"]
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    got = J.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=3, num=80)
    assert {(x.doc_id, x.component_id) for x in got.collect()} == {(0, 0), (1, 0), (2, 2)}
    left = {x.partition("-")[0] for x in set(os.listdir(folder)) - before}
    assert {"docs", "classes"} <= left and not left & {"prefixes", "firsts", "shared", "members", "sets"}
