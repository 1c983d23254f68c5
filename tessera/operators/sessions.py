"""The session store: messages, append-only task logs, timelines, budgets and memory search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.records import written

ACTIVE, TERMINAL, RETRYABLE = ("queued", "running"), ("completed", "failed", "cancelled"), ("failed", "cancelled")
BUDGET_CHARS, WARN_SHARE, CHARS_A_TOKEN = 120_000, 0.85, 4


def messages_of(messages: DataFrame, session_id) -> DataFrame:
    return messages.where(F.col("session_id") == session_id).orderBy("ts", "id").select("id", "role", "content")


def sessions(*sources: DataFrame) -> DataFrame:
    """The distinct ids of several stores, sorted."""
    return reduce(lambda a, b: a.unionByName(b), (s.select("session_id") for s in sources)).distinct().orderBy("session_id")


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last snapshot of each key of an append-only log; ``order`` ends in a tie-breaker."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(key, *(F.col(f"s.{c}").alias(c) for c in rest))


def find(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every argument that isn't empty."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in wanted.items() if v not in (None, "")), df)


def task_summary(tasks: DataFrame) -> DataFrame:
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    return tasks.groupBy("session_id").agg(
        F.count("*").alias("total"), *(of(s).alias(s) for s in ACTIVE + TERMINAL), of(*ACTIVE).alias("active"), of(*TERMINAL).alias("terminal"), of(*RETRYABLE).alias("retryable"), F.max("updated_at_ms").alias("latest_updated_at_ms")
    )


def retry_chains(tasks: DataFrame, depth: int | None = None) -> DataFrame:
    """Each task's first attempt and its attempt number, along all parents, or as many as ``depth`` needs.

    Pointer doubling: each step joins a task with its ancestor's ancestor, until nothing changes; in a
    cycle, which has no first attempt, until every chain would have ended.
    """
    now = tasks.select("task_id", F.coalesce("parent_task_id", "task_id").alias("root"), F.when(F.col("parent_task_id").isNull(), 0).otherwise(1).alias("steps"))
    known = tasks.select(F.col("task_id").alias("root")).distinct()
    now = now.join(known, "root", "left_semi").unionByName(now.join(known, "root", "left_anti").withColumn("root", F.col("task_id")).withColumn("steps", F.lit(0)))
    now = written(now, "chains")
    for _ in range((depth - 1 if depth else now.count()).bit_length()):
        up = now.select(F.col("task_id").alias("root"), F.col("root").alias("above"), F.col("steps").alias("more"))
        now = written(now.join(up, "root").select("task_id", F.col("above").alias("root"), (F.col("steps") + F.col("more")).cast("long").alias("steps"), (F.col("more") > 0).alias("moved")), "chains")
        if now.where("moved").isEmpty():
            break
    return now.select("task_id", "root", (F.col("steps") + 1).cast("long").alias("attempt"))


def by_status_groups(tasks: DataFrame, *order: str) -> DataFrame:
    """Tasks of these statuses, status by status."""
    rank = reduce(lambda c, s: c.when(F.col("status") == s[1], s[0]), list(enumerate(order))[1:], F.when(F.col("status") == order[0], 0))
    return tasks.where(F.col("status").isin(*order)).withColumn("rank", rank).orderBy("rank", "task_id")


def budget(messages: DataFrame, limit: int = BUDGET_CHARS) -> DataFrame:
    used = messages.groupBy("session_id").agg(F.sum(F.length("content")).cast("long").alias("chars"))
    status = F.when(F.col("chars") > limit, "exceeded").when(F.col("chars") >= int(limit * WARN_SHARE), "warn").otherwise("ok")
    return used.select("session_id", "chars", (F.lit(limit) - F.col("chars")).alias("remaining"), F.floor(F.col("chars") / CHARS_A_TOKEN).cast("long").alias("tokens"), status.alias("status"))


def timeline(messages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Messages, then tasks, of each session, at the offsets of their sections."""
    number = lambda *by: F.row_number().over(Window.partitionBy("session_id").orderBy(*by))
    said = messages.select("session_id", F.lit("message").alias("section"), (number("ts", "id") + 100).cast("long").alias("position"), F.col("role").alias("title"))
    done = tasks.select("session_id", F.lit("background-task").alias("section"), (number("created_at_ms", "task_id") + 200).cast("long").alias("position"), F.col("status").alias("title"))
    return said.unionByName(done)


def recent_dialogue(messages: DataFrame, n: int = 30, least: int = 4) -> DataFrame:
    """The last ``n`` human and assistant messages of sessions that have ``least`` of them."""
    spoken = messages.where(F.col("role").isin("human", "ai") & (F.trim("content") != ""))
    own = Window.partitionBy("session_id")
    rows = spoken.withColumn("back", F.row_number().over(own.orderBy(F.desc("ts"), F.desc("id")))).withColumn("all", F.count("*").over(own))
    return rows.where((F.col("back") <= n) & (F.col("all") >= least)).select("session_id", "id", "role")


def last_of_each_role(messages: DataFrame) -> DataFrame:
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("id")), F.when(F.col("role") == role, F.struct("ts", "id")))
    return messages.groupBy("session_id").agg(F.count("*").alias("messages"), last("ai").alias("last_ai"), last("human").alias("last_human"), F.floor(F.sum(F.length("content")) / CHARS_A_TOKEN).cast("long").alias("tokens"))


def search(docs: DataFrame, key: str, content: str, query: str, recency: Column, limit: int | None = 5) -> DataFrame:
    """Ten points an occurrence of a term, three a line with one, and a bonus for recent documents."""
    words = X.terms(query)
    low = F.lower(content)
    hits = reduce(lambda a, b: a + b, (X.occurrences(low, F.lit(w)) for w in words))
    with_term = lambda line: reduce(lambda a, b: a | b, (F.contains(F.lower(line), F.lit(w)) for w in words))
    lines = F.filter(F.split(content, "\n"), lambda line: F.trim(line) != "")
    scored = docs.withColumn("hits", hits).where("hits > 0").withColumn("matching", F.filter(lines, with_term))
    out = scored.select(key, (F.col("hits") * 10 + F.size("matching") * 3 + recency).cast("double").alias("score"), F.substring(F.try_element_at("matching", F.lit(1)), 1, 180).alias("excerpt"))
    return out.orderBy(F.desc("score"), key).limit(limit) if limit else out


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_actions(old: DataFrame, new: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """What an upsert does with each new row: created, updated, or skipped where all compared columns are equal."""
    o = old.select(key, *(F.col(c).alias(f"__{c}") for c in compared), F.lit(True).alias("__there"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in compared))
    return new.join(o, key, "left").select(key, F.when(F.col("__there").isNull(), "created").when(same, "skipped").otherwise("updated").alias("action"))


def newest(df: DataFrame, order: str, tie: str, keep: int) -> DataFrame:
    return df.orderBy(F.desc(order), F.desc(tie)).limit(keep)


def sticky(df: DataFrame, key: str, flag: Column, time: str, tie: str) -> DataFrame:
    """Whether the flag is or ever was set before, within each key."""
    w = Window.partitionBy(key).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(key, tie, F.max(flag).over(w).alias("risk"))


def circuit(df: DataFrame, key: str, tripped: Column, time: str, tie: str, open_ms: int = 300_000) -> DataFrame:
    """Whether a key's circuit is open at each event: a trip happened before it, less than ``open_ms`` ago."""
    w = Window.partitionBy(key).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(tripped, F.col(time)), ignorenulls=True).over(w)
    return df.select(key, tie, F.coalesce(F.col(time) - last < open_ms, F.lit(False)).alias("open"))
