"""The greedy near-copy rule against a version in plain Python."""

import random

from tessera.operators import records as R
from tessera.plans import q_records


def brute(rows, share, least):
    kept = {}
    for g, p, t in sorted(rows, key=lambda r: r[1]):
        own = kept.setdefault(g, [])
        alike = (len(y) >= least and len(t) >= least and len(set(t) & set(y)) / min(len(t), len(y)) >= share for _, y in own)
        if not any(alike):
            own.append((p, t))
    return sorted(p for own in kept.values() for p, _ in own)


def test_greedy_against_python(spark):
    r = random.Random(2)
    rows = []
    for p in range(400):
        near = r.choice(rows)[2] if rows and r.random() < 0.7 else []
        t = {w if r.random() < 0.75 else f"w{r.randrange(60)}" for w in near[: r.randrange(2, 60)]} | {f"w{r.randrange(60)}" for _ in range(r.randrange(12))}
        rows.append((r.choice(["a", "b", None]), p, r.sample(sorted(t), len(t))))
    df = spark.createDataFrame(rows, "g string, pos long, t array<string>")
    want = brute(rows, 0.62, 8)
    assert 100 < len(want) < 390
    assert sorted(x.pos for x in R.greedy(df, "g", "pos", "t", 0.62, 8).collect()) == want


def test_rows_that_differ_in_the_first_words(spark, tmp_path):
    words = [f"word{chr(97 + i)}" for i in range(20)]
    data = [(i, " ".join([f"first{chr(97 + i)}", f"second{chr(97 + i)}", *words]), "en", "s") for i in range(12)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.pos for r in q_records.d03(spark, str(tmp_path)).collect()] == [0]
