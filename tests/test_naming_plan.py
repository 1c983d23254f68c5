"""Name resolution: equal names and equal queries meet once, and names' grams are not broadcast."""

from tessera.operators import naming


def test_equal_names_meet_once(spark, monkeypatch):
    made = {}
    plain = naming.written
    monkeypatch.setattr(naming, "written", lambda df, name: made.setdefault(name, plain(df, name)))
    names = spark.createDataFrame([("g", i, f"part {i % 2}") for i in range(2000)], "g string, position long, name string")
    queries = spark.createDataFrame([(i, "g", q) for i, q in enumerate(["1 part"] * 300 + ["art 1", "part"] * 3)], "query_id long, g string, query string")
    got = naming.resolved(queries, names)
    assert {(r.code, r.matches, r["count"]) for r in got.groupBy("code", "matches").count().collect()} == {("ambiguous_fuzzy", 1000, 300), ("ambiguous_contains", 1000, 3), ("ambiguous_contains", 2000, 3)}
    assert made["kinds"].count() == 2 and made["alike"].count() == 3
