"""Session store queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sessions as O
from tessera.plans.registry import query
from tessera.plans.views import view, with_views

_M, _T, _MT, _A = with_views("messages"), with_views("tasks"), with_views("messages", "tasks"), with_views("audit")


def messages(spark, sf_dir):
    return view(spark, sf_dir, "messages")


def tasks(spark, sf_dir):
    return view(spark, sf_dir, "tasks")


@query("S08_messages_of_session", f"{_M} SELECT id, role, content FROM messages WHERE session_id = 7")
def s08(spark, sf_dir):
    return O.messages_of(messages(spark, sf_dir), 7)


@query("S09_D14_sessions", f"{_MT} SELECT session_id FROM messages UNION SELECT session_id FROM tasks")
def s09(spark, sf_dir):
    return O.sessions(messages(spark, sf_dir), tasks(spark, sf_dir))


@query("S06_latest_snapshots", f"""{_T} SELECT session_id, task_id, status, updated_at_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY updated_at_ms DESC, task_id DESC) AS r FROM tasks) WHERE r = 1""")
def s06(spark, sf_dir):
    return O.latest(tasks(spark, sf_dir).select("session_id", "task_id", "status", "updated_at_ms"), "session_id", ["updated_at_ms", "task_id"])


@query("F06_find_tasks", f"{_T} SELECT task_id FROM tasks WHERE status = 'failed' AND session_id = 11")
def f06(spark, sf_dir):
    return O.find(tasks(spark, sf_dir), status="failed", session_id=11, task_id=None).select("task_id")


@query("A17_task_summary", f"""{_T} SELECT session_id, count(*) AS total, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in O.ACTIVE + O.TERMINAL)},
  count(*) FILTER (status IN ('queued', 'running')) AS active, count(*) FILTER (status IN ('completed', 'failed', 'cancelled')) AS terminal,
  count(*) FILTER (status IN ('failed', 'cancelled')) AS retryable, max(updated_at_ms) AS latest_updated_at_ms FROM tasks GROUP BY 1""")
def a17(spark, sf_dir):
    return O.task_summary(tasks(spark, sf_dir))


@query("J15_retry_parents", f"""{_T} SELECT t.task_id, p.status AS parent_status, t.parent_task_id IS NOT NULL AND p.task_id IS NULL AS orphan
  FROM tasks t LEFT JOIN tasks p ON t.parent_task_id = p.task_id""")
def j15(spark, sf_dir):
    t = tasks(spark, sf_dir)
    p = t.select(F.col("task_id").alias("parent"), F.col("status").alias("parent_status"))
    return t.join(p, F.col("parent_task_id") == F.col("parent"), "left").select("task_id", "parent_status", (F.col("parent_task_id").isNotNull() & F.col("parent").isNull()).alias("orphan"))


@query("J15_retry_chains", "SELECT event_id AS task_id, event_id - event_id % 7 AS root, event_id % 7 + 1 AS attempt FROM events")
def j15b(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("task_id"))
    return O.retry_chains(n.withColumn("parent_task_id", F.when(F.col("task_id") % 7 != 0, F.col("task_id") - 1)))


@query("F24_status_groups", f"{_T} SELECT task_id, status FROM tasks WHERE status IN ('failed', 'cancelled')")
def f24(spark, sf_dir):
    return O.by_status_groups(tasks(spark, sf_dir), "failed", "cancelled").select("task_id", "status")


@query("A21_budget", f"""{_M} SELECT session_id, chars, 4000 - chars AS remaining, chars // 4 AS tokens, CASE WHEN chars > 4000 THEN 'exceeded' WHEN chars >= 3400 THEN 'warn' ELSE 'ok' END AS status
  FROM (SELECT session_id, CAST(sum(length(content)) AS BIGINT) AS chars FROM messages GROUP BY 1)""")
def a21(spark, sf_dir):
    return O.budget(messages(spark, sf_dir), 4000)


@query("W08_timeline", f"""{_MT} SELECT session_id, 'message' AS section, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) + 100 AS position, role AS title FROM messages
  UNION ALL SELECT session_id, 'background-task', row_number() OVER (PARTITION BY session_id ORDER BY created_at_ms, task_id) + 200, status FROM tasks""")
def w08(spark, sf_dir):
    return O.timeline(messages(spark, sf_dir), tasks(spark, sf_dir))


@query("W11_recent_dialogue", f"""{_M} SELECT session_id, id, role FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS back, count(*) OVER (PARTITION BY session_id) AS n
  FROM messages WHERE role IN ('human', 'ai') AND trim(content) <> '') WHERE back <= 30 AND n >= 4""")
def w11(spark, sf_dir):
    return O.recent_dialogue(messages(spark, sf_dir))


@query("W12_G04_last_messages", f"""{_M} SELECT session_id, count(*) AS messages, max(id) FILTER (role = 'ai') AS last_ai, max(id) FILTER (role = 'human') AS last_human,
  CAST(sum(length(content)) AS BIGINT) // 4 AS tokens FROM messages GROUP BY 1""")
def w12(spark, sf_dir):
    return O.last_of_each_role(messages(spark, sf_dir))


_SEARCH = """SELECT doc_id, CAST(hits * 10 + len(m) * 3 + greatest(0, 50 - doc_id % 80) AS DOUBLE) AS score, substring(m[1], 1, 180) AS excerpt FROM (
  SELECT doc_id, (length(low) - length(replace(low, 'license', ''))) // 7 + (length(low) - length(replace(low, 'password', ''))) // 8 AS hits,
    list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '' AND (contains(lower(l), 'license') OR contains(lower(l), 'password'))) AS m
  FROM (SELECT doc_id, text, lower(text) AS low FROM documents)) WHERE hits > 0"""


@query("X20_memory_scores", _SEARCH)
def x20(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return O.search(docs, "doc_id", "text", "license password", F.greatest(F.lit(0), 50 - F.col("doc_id") % 80), None)


@query("O04_memory_search", f"{_SEARCH} ORDER BY score DESC, doc_id LIMIT 5")
def o04(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return O.search(docs, "doc_id", "text", "license password", F.greatest(F.lit(0), 50 - F.col("doc_id") % 80))


@query("K07_upsert", """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def k07(spark, sf_dir):
    old = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    return O.upserted(old, old.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X")), "o_orderkey")


@query("K09_upsert_actions", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'created' WHEN o_orderstatus = 'F' THEN 'skipped' ELSE 'updated' END AS action FROM orders""")
def k09(spark, sf_dir):
    new = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    old = new.where("o_orderkey % 3 != 0").withColumn("o_orderstatus", F.lit("F"))
    return O.upsert_actions(old, new, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("K10_newest", f"{_T} SELECT task_id FROM tasks ORDER BY updated_at_ms DESC, task_id DESC LIMIT 3")
def k10(spark, sf_dir):
    return O.newest(tasks(spark, sf_dir), "updated_at_ms", "task_id", 3).select("task_id")


@query("O10_ring_buffer", f"{_A} SELECT request_id FROM audit ORDER BY ts_ms DESC, request_id DESC LIMIT 50")
def o10(spark, sf_dir):
    return O.newest(view(spark, sf_dir, "audit"), "ts_ms", "request_id", 50).select("request_id")


@query("ST10_sticky_risk", f"""{_A} SELECT session_id, request_id, max(coalesce(outcome = 'blocked', false)) OVER (PARTITION BY session_id ORDER BY ts_ms, request_id ROWS UNBOUNDED PRECEDING) AS risk FROM audit""")
def st10(spark, sf_dir):
    return O.sticky(view(spark, sf_dir, "audit"), "session_id", F.coalesce(F.col("outcome") == "blocked", F.lit(False)), "ts_ms", "request_id")


@query("ST08_circuit", f"""{_A} SELECT session_id, request_id, coalesce(ts_ms - last_value(CASE WHEN outcome = 'error' THEN ts_ms END IGNORE NULLS) OVER (
  PARTITION BY session_id ORDER BY ts_ms, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 86400000, false) AS open FROM audit""")
def st08(spark, sf_dir):
    return O.circuit(view(spark, sf_dir, "audit"), "session_id", F.coalesce(F.col("outcome") == "error", F.lit(False)), "ts_ms", "request_id", 86_400_000)


@query("M09_last_usage", f"""{_A} SELECT session_id, max(struct_pack(t := ts_ms, r := request_id, v := total_tokens)).v AS last_tokens, CAST(sum(CASE WHEN exploring THEN 2 ELSE 1 END) AS BIGINT) AS tool_calls FROM audit GROUP BY 1""")
def m09(spark, sf_dir):
    return view(spark, sf_dir, "audit").groupBy("session_id").agg(F.max_by("total_tokens", F.struct("ts_ms", "request_id")).alias("last_tokens"), F.sum(F.when(F.col("exploring"), 2).otherwise(1)).alias("tool_calls"))


@query("J05_calendar_duplicates", """SELECT o.o_orderkey, EXISTS (SELECT 1 FROM orders e WHERE e.o_orderkey % 7 = 0 AND e.o_custkey = o.o_custkey AND CAST(e.o_orderdate AS DATE) = CAST(o.o_orderdate AS DATE)) AS duplicate
  FROM orders o WHERE o.o_orderkey % 5 = 0""")
def j05(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    drafts, events = rows.where("o_orderkey % 5 = 0"), rows.where("o_orderkey % 7 = 0").select("o_custkey", "day")
    twice = drafts.join(events, ["o_custkey", "day"], "left_semi").select("o_orderkey", F.lit(True).alias("duplicate"))
    return twice.unionByName(drafts.join(events, ["o_custkey", "day"], "left_anti").select("o_orderkey", F.lit(False).alias("duplicate")))


@query("J04_merge_signals", f"""{_A} SELECT session_id, arg_min(source_type, (ts_ms, request_id)) FILTER (source_type IS NOT NULL) AS first_source, list_sort(list(DISTINCT node)) [1] AS first_node, count(DISTINCT node) AS nodes FROM audit GROUP BY 1""")
def j04(spark, sf_dir):
    a = view(spark, sf_dir, "audit")
    known = F.col("source_type").isNotNull()
    return a.groupBy("session_id").agg(F.min_by(F.when(known, F.col("source_type")), F.when(known, F.struct("ts_ms", "request_id"))).alias("first_source"), F.min("node").alias("first_node"), F.count_distinct("node").alias("nodes"))
