"""Events, settled orders and bullets against plain folds in Python."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import greedy as G

r = random.Random(12)


def words(text, drop=()):
    none = {*G.STOP, *(d.lower() for d in drop)}
    return {w.lower() for w in (text or "").split() if len(w) > 4 and w.lower() not in none}


def plain_events(rows, drop):
    kept = {}
    for g, _, t, f in sorted(rows, key=lambda x: x[1]):
        own = (words(t, drop), words(f"{t or ''} {f or ''}", drop))
        if not any(len(own[0] & a) >= 3 or len(own[1] & b) >= 5 for a, b, _ in kept.setdefault(g, [])):
            kept[g].append((*own, _))
    return sorted(p for own in kept.values() for *_, p in own)


def reports(n, vocabulary):
    pool = [f"Word{i}x" if i % 3 else f"wörd{i}" for i in range(vocabulary)] + ["from", "querying", "short", "ab"]
    text = lambda k: " ".join(r.choice(pool) for _ in range(k))
    rows = [(r.choice(["a", "b", None]), p, r.choice([None, "", *[text(r.randrange(10))] * 5]), r.choice([None, "", text(r.randrange(9))])) for p in range(n)]
    return [*rows, ("big", 90_000, text(5), text(30_000)), ("big", 90_001, None, None), ("big", 90_002, None, None)]


@pytest.mark.parametrize(("vocabulary", "batch", "share"), [(22, 64, 0.1), (90, 5, 0.0), (22, 3, 1.0), (90, 3, 1.0)])
def test_events(spark, vocabulary, batch, share):
    rows = reports(260, vocabulary)
    df = spark.createDataFrame(rows, "q string, pos long, title string, snippet string").withColumn("p", F.lit(1)).withColumn("g", F.lit("x"))
    got = G.events(df, "q", "pos", "title", "snippet", ["Querying"], batch=batch, share=share)
    want = plain_events(rows, ["Querying"])
    assert sorted(x.pos for x in got.collect()) == want and got.columns == df.columns
    assert 10 < len(want) < 262


def test_no_rows(spark):
    df = spark.createDataFrame([], "q string, pos long, title string, snippet string")
    assert G.events(df, "q", "pos", "title", "snippet").collect() == []


@pytest.mark.parametrize("most", [100_000, 30])
def test_settled(spark, most):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, i) for i in range(1001, 1100)] + [(1005, 1200), (1200, 1201)]
    random_ones = [tuple(sorted(r.sample(range(2000, 2060), 2))) for _ in range(120)]
    pairs = chain + star + random_ones
    gone = set()
    for b in sorted({b for _, b in pairs}):
        if any(y == b and x not in gone for x, y in pairs):
            gone.add(b)
    got = [x.p for x in G.settled(spark.createDataFrame(pairs + pairs[:9], "a long, b long"), most).collect()]
    assert sorted(got) == sorted(gone)


def plain_bullets(text, drop=()):
    import re

    none = {*G.STOP, *drop}
    stems = lambda s: {w[:-1] if w.endswith("s") and len(w) > 5 else w for w in map(str.lower, s.split()) if len(w) > 4 and w not in none}
    blocks = []
    for line in (text or "").splitlines():
        if blocks and not re.match(r"[•*-]\s", line.strip()):
            blocks[-1] += "\n" + line
        else:
            blocks.append(line)
    kept = []
    for block in (b for b in blocks if re.match(r"[•*-]\s", b.strip())):
        own = stems(block)
        for i, other in enumerate(kept):
            both = own & {*G.DISASTER} and stems(other) & {*G.DISASTER}
            if len(own & stems(other)) >= (2 if both else 4):
                kept[i] = max(other, block, key=len)
                break
        else:
            kept.append(block)
    parts = [b for b in blocks if not re.match(r"[•*-]\s", b.strip())] + kept
    return "\n\n".join(p.strip() for p in parts if p.strip())


def test_bullets(spark):
    pool = ["earthquake", "tsunami", "coast", "coasts", "reports", "report", "minister", "rescue", "rescues", "from", "town", "über", "damages"]
    texts = [None, "", "\n\n", "no bullets\nat all", "-\nfoo", "- ", "* one two\r\n* one two", "intro\n\n- alpha beta gamma delta\n  going on\n\n• Alpha Beta Gamma Delta epsilon\nlast", "- earthquake coasts\n- Earthquake coast, minister coast\n- tsunami coast reports", "-no bullet\n - indented bullet words\n-  x"]
    texts += ["\n".join(r.choice(["- ", "* ", "• ", "", "  - "]) + " ".join(r.choice(pool) for _ in range(r.randrange(9))) for _ in range(r.randrange(1, 25))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {x.id: x.m for x in df.select("id", G.merged_bullets(F.col("text"), ["rescue"]).alias("m")).collect()}
    assert got == {i: plain_bullets(t, ["rescue"]) for i, t in enumerate(texts)}


def test_a_longer_bullet_takes_the_place(spark):
    text = "- alpha1 bravo1 charlie delta1\n- alpha1 bravo1 charlie delta1 echoes foxtrot golfing hotels\n- echoes foxtrot golfing hotels"
    got = spark.createDataFrame([(text,)], "t string").select(G.merged_bullets(F.col("t")).alias("m")).first().m
    assert got == "- alpha1 bravo1 charlie delta1 echoes foxtrot golfing hotels"
