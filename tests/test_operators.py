"""Literal cases of the operators that order or state makes hard to express in SQL."""

import json

from pyspark.sql import functions as F

from tessera.functions import score as S
from tessera.functions import text as X
from tessera.functions import time as M
from tessera.functions import url as U
from tessera.operators import records as R
from tessera.operators import sessions as O
from tessera.operators import telemetry as T
from tessera.sources import readers, writers
from tessera.streaming import tracker


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_reliability_bounds(spark):
    want = {0: "unreliable", 19: "unreliable", 20: "low_content", 49: "low_content", 50: "ok_weak", 119: "ok_weak", 120: "ok_strong", 500: "ok_strong"}
    df = spark.createDataFrame(list(want.items()), "n int, r string")
    assert all(r.x == r.r for r in df.select("r", S.reliability(F.col("n")).alias("x")).collect())


def test_deltas(spark):
    d = lambda w, ms, usd, s=False, f=0: one(spark, S.delta(F.lit(w), F.lit(float(ms)), F.lit(usd), F.lit(s), F.lit(f)))
    assert d(150, 500, 0.0) == 0.983 and d(5, 15000, 0.001) < 0
    assert d(0, 15000, 1.0, True) == 0.85 and d(120, 0, 0.0, False, 2) == 0.5


def test_relative_times(spark):
    want = {"a few seconds ago": True, "hace unos segundos": True, "15 minutes ago": True, "hace 4 horas": True, "23 hours ago": True, "1 day ago": True, "hace 25 horas": False, "hace 2 días": False, "fecha desconocida": False, None: False}
    df = spark.createDataFrame(list(want.items()), "t string, r boolean")
    assert all(r.x == r.r for r in df.select("r", M.within_a_day(F.col("t"), 1_785_261_600_000).alias("x")).collect())


def test_dates(spark):
    for said, day in (("Vence 31/02/2024", None), ("el 5 de mayo", "2026-05-05"), ("2024-12-01", "2024-12-01"), ("", None)):
        got = one(spark, M.spanish_date(F.lit(said), 2026))
        assert (str(got) if got else None) == day


def test_urls(spark):
    assert one(spark, U.without_parameters(F.lit("https://WWW.Site.com/a/b/?utm_source=x&id=3#f"))) == "https://www.site.com/a/b?id=3"
    assert one(spark, U.bare_host(F.lit("http://www.wwf.org/x"))) == "wwf.org"
    assert one(spark, U.host(F.lit("http://[bad"))) == ""
    assert one(spark, U.allowed(F.lit("https://a.b.com/x"), ("b.com",), ())) is False


def test_texts(spark):
    assert one(spark, X.halved(F.lit("Data  Engineer data engineer"))) == "Data  Engineer".replace("  ", " ")
    assert one(spark, X.redacted(F.lit("mail a@b.org or +54 11 5555-1234 at http://x.y/z"))) == "mail [redacted-email] or [redacted-phone] at [redacted-url]"
    assert one(spark, X.specificity(F.lit("Tokio, Tokio, Japón"))) == 5 and one(spark, X.specificity(F.lit("Japón"))) == 1


def test_memory_search(spark):
    docs = spark.createDataFrame([("sess-a", "- Preferencia: usar CLI\n- Resultado: replay unificado"), ("sess-b", "- Tarea: mejorar memoria\n- Resultado: search helper")], "session_id string, text string")
    assert O.search(docs, "session_id", "text", "replay CLI", F.lit(0), 2).first().session_id == "sess-a"


def test_semantic_duplicates(spark):
    body = "word " * 60
    df = spark.createDataFrame([(0, "Dev", "Co", body, "Japón"), (1, "Dev", "Co", body, "Tokio, Tokio, Japón"), (2, "Dev", "Co", "short", "x")], "pos long, title string, company string, description string, location string")
    key = R.semantic_key("title", "company", "description")
    out = R.best_wins(df.where(key.isNotNull()), key, [X.specificity(F.col("location")).alias("s")], "pos").collect()
    assert [(r.pos, r.location, r.members) for r in out] == [(0, "Tokio, Tokio, Japón", 2)]


def test_interleaved_is_a_permutation(spark):
    df = spark.createDataFrame([(i, "abc"[i % 2 if i < 8 else 2]) for i in range(12)], "pos long, g string")
    rows = R.interleaved(df, "g", "pos").orderBy("turn").collect()
    assert [r.turn for r in rows] == list(range(1, 13)) and [r.g for r in rows[:3]] == ["a", "b", "c"]


def test_greedy(spark):
    df = spark.createDataFrame([(0, "g", list("abcd")), (1, "g", list("abcx")), (2, "g", list("wxyz"))], "pos long, g string, t array<string>")
    assert sorted(r.pos for r in R.greedy(df, "g", "pos", "t", 0.62, 2).collect()) == [0, 2]


def test_ranking_and_dominance(spark):
    base = dict(category="c", ts_ms=0, duration_ms=100.0, estimated_cost_usd=None, regret_estimate=None, recovery_turns=None)
    rows = [dict(base, strategy="good", scrape_reliability="ok_strong", scrape_score=1.0, prior_score=0.0) for _ in range(16)]
    rows += [dict(base, strategy="bad", scrape_reliability="unreliable", scrape_score=-1.0, prior_score=0.0) for _ in range(8)]
    rows += [dict(base, strategy="few", scrape_reliability="ok_strong", scrape_score=1.0, prior_score=0.0) for _ in range(7)]
    schema = "category string, strategy string, ts_ms long, duration_ms double, estimated_cost_usd double, regret_estimate double, recovery_turns int, scrape_reliability string, scrape_score double, prior_score double"
    audit = spark.createDataFrame([tuple(r[f.split()[0]] for f in schema.split(", ")) for r in rows], schema)
    ranking = T.strategy_ranking(audit, 0)
    got = T.dominance(ranking).first()
    assert (got.promoted, got.disabled) == ("good", "bad")
    policy = json.loads(T.policy_document(ranking, 5).first().policy)
    assert policy["categories"]["c"]["disabled"] == ["bad"] and policy["categories"]["c"]["promoted"][0]["strategy"] == "good"


TURNS = [(t, w, ms, c, s) for t, w, ms, c, s in ((1, 150, 500.0, 0.0, False), (2, 5, 15000.0, 0.001, False), (3, 5, 9000.0, None, False), (4, 60, None, 0.0002, False), (9, 500, 100.0, 0.01, True), (10, 10, 1.0, 0.0, True))]


def plain_fold():
    state, out = (0.0, 0, 0, 0, None, None), []
    for t in TURNS:
        row = type("Turn", (), dict(zip(("turn", "words", "duration_ms", "cost_usd", "structured"), t, strict=True)))
        state, result = tracker.step(state, row)
        out.append(result)
    return out


def test_tracker_fold(spark):
    df = spark.createDataFrame([("k", *t) for t in TURNS] + [("j", *TURNS[0])], f"key string, {tracker.TURN}")
    got = [tuple(r)[1:] for r in tracker.folded(df, "key").where("key = 'k'").orderBy("turn").collect()]
    assert got == plain_fold()
    assert all(-3 <= r[1] <= 3 and r[5] >= 0 for r in got) and got[0][6] == 2 and got[3][4] == 1


def test_tracker_stream(spark, tmp_path):
    for n, part in enumerate((TURNS[:3], TURNS[3:])):
        spark.createDataFrame([("k", *t) for t in part], f"key string, {tracker.TURN}").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(f"key string, {tracker.TURN}").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = tracker.tracked(stream, "key").writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r)[1:] for r in spark.table("tracked").orderBy("turn").collect()] == plain_fold()


def test_dashboard_stream(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    spark.sql("SELECT id AS event_id, timestamp_seconds(id * 3600) AS ts, 'view' AS event_type, CAST(id AS DOUBLE) AS value FROM range(100)").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = tracker.live_dashboard(readers.event_stream(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("live").collect()) == [4, 24, 24, 24, 24]


def test_readers(spark, tmp_path):
    folder = tmp_path / "sess-1"
    folder.mkdir()
    lines = ['{"request_id": "a", "outcome": "success", "duration_ms": 5, "quality_target": 1, "strategy": "free"}', "", "[1, 2]", "oops", '{"request_id": "b", "quality_target": null, "strategy": "free"}']
    (folder / "TOOL_AUDIT.jsonl").write_text("\n".join(lines))
    path = str(folder / "TOOL_AUDIT.jsonl")
    assert readers.json_objects(spark, path).count() == 2 and readers.scrape_records(spark, path).count() == 1 and readers.node_outcomes(spark, path).count() == 1
    assert {r.session_id for r in readers.per_session(spark, str(tmp_path), "TOOL_AUDIT.jsonl").collect()} == {"sess-1"}
    (folder / "MEMORY.md").write_text("a\nb")
    assert readers.whole_texts(spark, str(tmp_path / "*/MEMORY.md")).first().text == "a\nb"
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>t</title><link>l</link><description>d</description><source>s</source></item></channel></rss>")
    assert readers.feed_items(spark, str(tmp_path / "feed.xml")).first().title == "t"
    hits = spark.createDataFrame([(" ", "n", None, "u"), (None, None, None, None)], "title string, name string, url string, link string")
    assert [tuple(r) for r in readers.unified_hits(hits).collect()] == [("n", "u", "")]
    page = spark.createDataFrame([(1, '<script type="application/ld+json">{"@graph": [{"@type": "Org"}, {"@type": "JobPosting", "title": "Dev"}]}</script>')], "page_id long, html string")
    assert json.loads(readers.job_postings(page).first().posting)["title"] == "Dev"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    writers.append_lines(df, str(tmp_path / "log"))
    writers.append_lines(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    legacy = spark.createDataFrame([("s1", 0, "a"), ("s1", 1, "b"), ("s2", 0, "c")], "session_id string, line long, content string")
    out = writers.backfill(legacy, spark.createDataFrame([("s2",)], "session_id string"), 10_000).orderBy("line").collect()
    assert [(r.content, r.ts) for r in out] == [("a", 9000), ("b", 10_000)]


def test_url_dates(spark):
    from tessera.operators.ranking import url_date

    cases = [
        ("https://n.example/2026/04/02/x", "2026-04-02"),
        ("https://n.example/2026-13-40/2026-05-06", "2026-05-06"),
        ("https://n.example/yjj20260402b", "2026-04-02"),
        ("https://n.example/id19970402", None),
        ("https://n.example/20260231-20260301", "2026-03-01"),
        ("https://n.example/julio-2025", "2025-07-01"),
        ("https://n.example/2025-march", "2025-03-01"),
        ("https://n.example/mayo-2024", "2024-05-01"),
        ("https://n.example/story", None),
        ("", None),
        (None, None),
    ]
    got = spark.createDataFrame(cases, "url string, day string").select("url", "day", url_date(F.col("url")).cast("string").alias("got")).collect()
    assert [r.got for r in got] == [r.day for r in got]
