"""Choices for a key on nulls, empty texts and tables, ties and further columns, and line distinctness against a walk."""

import re

from pyspark.sql import functions as F

from tessera.operators import choices as C


def test_current_scores(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 5, -1.0), ("a", 5, -0.5), ("b", 9, None), ("c", None, 1.0), (None, 8, 0.25)], "key string, turn long, score double")
    got = {r.key: (r.last_turn, r.current) for r in C.current_scores(rows, "key", 9).collect()}
    assert got == {"a": (5, 0.0), "b": (9, 0.0), "c": (0, 0.0), None: (8, 0.25)}
    assert {r.key: r.current for r in C.current_scores(rows, "key", 8).collect()}["a"] == -0.5
    assert C.current_scores(rows.limit(0), "key", 9).count() == 0


def test_decision_context(spark):
    rows = spark.createDataFrame([(None, "free", "p"), (-2.0, None, "p"), (1.0, "free", None), (-0.25, "best", "p")], "prior double, strategy string, category string")
    got = [tuple(r) for r in rows.select(*C.decision_context(F.col("prior"), F.col("strategy"), F.col("category"), {"p": "best"})).collect()]
    assert got == [("ok", 0.2, "best", False), ("unreliable", 0.05, "best", False), ("ok", 0.1, None, None), ("low_content", 0.2, "best", True)]


def test_capped_queries(spark):
    rows = spark.createDataFrame([(["en", "en"],), (["xx", None],), ([],), (["es", "en", "de"],)], "l array<string>")
    found = [[tuple(q) for q in r.q] for r in rows.select(C.capped_queries(F.lit("d.example"), F.col("l"), {"en": ["a", " ", "b", "c"], "es": [], "de": ["z"]}).alias("q")).collect()]
    english = [("en", "site:d.example a"), ("en", "site:d.example"), ("en", "site:d.example b")]
    assert found == [english, [("fallback", "site:d.example")], [("fallback", "site:d.example")], english]


def test_distinct_lines(spark):
    stop = ("with",)
    lines = ["- Café noticias hoy", "cafe  NOTICIAS", "• cafe with noticias", None, "", "a b", "A  B", "- a b", "one two", "Другая строка", "другая строка!", "a b c", "x" * 50_000, "x" * 50_000]
    df = spark.createDataFrame([(d, i, x, "k") for d in (1, 2) for i, x in enumerate(lines)], "d long, i int, line string, __extra string")
    marks = str.maketrans("é", "e")

    def walk():
        seen_lines, seen, out = set(), set(), []
        for i, line in enumerate(lines):
            line = re.sub("^[-•] +", "", " ".join((line or "").split()))
            signature = " ".join([w for w in re.findall(r"\w+", line.lower().translate(marks)) if len(w) > 3 and w not in stop][:10])
            if line and line.lower() not in seen_lines and not (signature and signature in seen):
                seen_lines.add(line.lower())
                seen.add(signature)
                out.append((i, line))
        return out

    got = sorted(tuple(r) for r in C.distinct_lines(df, "d", "i", "line", stop).where("d = 2").select("i", "line").collect())
    assert got == walk()
    assert C.distinct_lines(df.limit(0), "d", "i", "line", stop).count() == 0


def test_top_sections(spark):
    links = spark.createDataFrame([(1, 0, "/a", 2, 0), (1, 1, "/a", 9, 9), (1, 2, "/bb", 2, 0), (1, 3, "/c", 0, 5), (1, 4, "/d", 1, 1), (1, 5, "/e", None, 1), (1, 6, "/f", 1, 0), (1, 7, "/g", 1, 0)], "page int, place int, path string, s int, a int")
    best = C.top_sections(links, "page", "place", F.col("path"), F.col("s"), F.col("a"))
    assert [(r["rank"], r.path) for r in best.orderBy("rank").collect()] == [(1, "/d"), (2, "/a"), (3, "/bb"), (4, "/f")]


def test_updated_registry(spark):
    workers = spark.createDataFrame([("w", "new", 1, "m"), ("v", "new", 1, None), (None, "new", 1, "n")], "id string, status string, updated_at long, metadata string")
    updates = spark.createDataFrame([("w", "run", 5, "x"), ("w", "done", 7, None), ("w", "old", 3, "y"), ("u", "run", 5, "x"), (None, "run", 5, "x")], "id string, status string, at long, metadata string")
    got = {tuple(r) for r in C.updated_registry(workers, updates, "id", ["at"]).collect()}
    assert got == {("w", "done", 7, "x"), ("v", "new", 1, None), (None, "new", 1, "n")}
