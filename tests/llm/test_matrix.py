"""Rows of the token-group matrix bound what any member shares; rows of equal ids are judged by their texts."""

import random

import numpy as np

from tessera.llm import jaccard_join as J
from tests.llm import brute

r = random.Random(11)


def test_a_row_bounds_every_member():
    g = np.random.default_rng(2)
    for _ in range(50):
        pool = g.integers(0, 2**63, 400).astype(np.uint64)
        members = [np.unique(g.choice(pool, g.integers(1, 300))) for _ in range(5)]
        row = J.bin_counts(members[0])
        for m in members[1:]:
            row = J.folded(row, J.bin_counts(m))
        other = np.unique(g.choice(pool, g.integers(1, 300)))
        for m in members:
            assert J.shared_at_most(row, J.bin_counts(other)) >= len(np.intersect1d(m, other))


def test_chains_over_several_orders(spark):
    """Families in which each text links only with its neighbours, around a passage that all share."""
    data = []
    for u in range(25):
        passage = [f"p{r.randrange(10**6)}" for _ in range(60)]
        for _ in range(3):
            words = list(passage)
            for _ in range(12):
                words[r.randrange(60)] = f"x{r.randrange(10**6)}"
                data.append(" ".join(words))
    r.shuffle(data)
    data = list(enumerate(data))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    for words, num in ((1, 90), (3, 80)):
        got = sorted(map(tuple, J.jaccard_components(df, words=words, num=num).collect()))
        assert got == brute.jaccard_components(data, words, num)


def test_one_row_of_each_component(spark):
    long = [" ".join(f"t{k}w{i}" for i in range(60)) for k in range(4)]
    near = long[0] + " more"
    rows = [(1, long[0]), (1, long[1]), (2, near), (None, long[2]), (None, long[3]), (None, near), (5, long[2]), (7, None), (7, ""), (None, None), (7, None), (1, long[0]), (None, long[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "k").selectExpr("k AS doc_id", "text", "1 AS label", "2 AS c", "3 AS id").repartition(3)
    kept = J.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((x.doc_id, x.text) for x in kept.collect()), key=str)
    assert got == sorted([(1, long[0]), (1, long[1]), (5, long[2]), (None, long[3]), (7, None), (7, ""), (None, None)], key=str)
