"""Secret scans with corpus-wide ownership frequency.

1. Every whole text is scanned for candidates: the base kinds (``assign``, ``access``, ``hex``) and
   ``mixed``, long runs of letters and digits that hold both, outside the base spans.
2. The candidates' hashes, not the candidates, are aggregated over the corpus by distinct
   repositories and distinct owners. Counting starts from distinct (hash, repository, owner) rows,
   so a secret that a third of all rows hold is combined before it moves.
3. A candidate is a widely copied example if at least ``example_owners`` owners hold it, or if at least
   two owners hold it in ``example_repositories`` repositories or more. Anything else is live-looking:
   what one owner has in all its repositories is still its own, and what two owners have in a few is
   more likely shared than copied. Base spans always stay; a ``mixed`` span is added only if it is live-looking.
4. Each span meets its hash's counts in up to 64 tasks, so one value in a third of all rows is no long task.

Null text is empty text, a null repository or owner is one of its own. Repeated rows are scanned each,
and counted once where they share a repository. An empty table gives an empty result. Only the named
columns are read. The result has a row for each input row, of repeated ids too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import release, text_digest, written
from tessera.operators.skew import lookup

#: Kind, pattern, the group that is the secret, its least length. In the order of kinds.
BASE = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
KINDS = ("assign", "access", "hex", "mixed")
_RUN = re.compile(r"[A-Za-z0-9]{20,}")
SCHEMA = "row_id long, id long, digest binary, repository string, owner string, spans array<struct<kind:int, start:long, end:long, hash:binary>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in code points: leftmost and not overlapping for each kind."""
    found = []
    for kind, (_, pattern, group, least) in enumerate(BASE):
        if kind == 1 and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            start, end = m.span(group)
            if end - start >= least:
                found.append((start, kind, end))
    return sorted(found)


def mixed_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of maximal runs of 20 letters and digits or more that hold both, apart from base spans."""
    found = []
    for m in _RUN.finditer(text):
        run = m.group()
        if not run.isalpha() and not run.isdigit() and not any(s < m.end() and m.start() < e for s, _, e in base):
            found.append((m.start(), 3, m.end()))
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.binary())]))
    for batch in batches:
        spans = []
        for value in batch.column("text"):  # one text at a time
            text = value.as_py() or ""
            base = base_spans(text)
            every = sorted(base + mixed_spans(text, base))
            spans.append([{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(text[s:e].encode()).digest()} for s, k, e in every])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_id", "id", "digest", "repository", "owner")), pa.array(spans, kind)], ["row_id", "id", "digest", "repository", "owner", "spans"])
    release()


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", example_owners: int = 3, example_repositories: int = 10) -> DataFrame:
    """One row for each input row: id and ``spans``, an array of kind, start, end, hash, repositories, owners, live.

    The spans are ordered by start, then kind. Documents stand for repositories and their sources for
    owners unless other columns are named.
    """
    return _scanned(df, id_col, text_col, repository_col, owner_col, example_owners, example_repositories, F.lit(None).cast("binary")).select(F.col("id").alias(id_col), "spans")


def _scanned(df: DataFrame, id_col: str, text_col: str, repository_col: str, owner_col: str, example_owners: int, example_repositories: int, digest: Column) -> DataFrame:
    """id, digest and spans of each input row."""
    rows = df.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).cast("long").alias("id"),
        digest.alias("digest"),
        F.col(repository_col).cast("string").alias("repository"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(text_col).cast("string").alias("text"),
    )
    scanned = written(rows.mapInArrow(_scan, SCHEMA), "secrets")
    found = scanned.select("row_id", F.coalesce("repository", F.lit("")).alias("repository"), F.coalesce("owner", F.lit("")).alias("owner"), F.explode("spans").alias("span"))
    held = found.select(F.col("span.hash").alias("hash"), "repository", "owner").distinct()
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    frequency = by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))
    copied = (F.col("owners") >= example_owners) | (F.col("owners") > 1) & (F.col("repositories") >= example_repositories)
    judged = lookup(found.withColumn("hash", F.col("span.hash")), frequency, "hash", "row_id").withColumn("live", ~copied)
    judged = judged.where((F.col("span.kind") < 3) | F.col("live"))
    item = F.struct(F.col("span.start").alias("start"), F.col("span.kind").alias("kind"), F.col("span.end").alias("end"), "hash", "repositories", "owners", "live")
    lists = judged.groupBy("row_id").agg(F.sort_array(F.collect_list(item)).alias("spans"))
    every = scanned.select("row_id", "id", "digest", F.size("spans").alias("n"))
    found_rows = every.where("n > 0").join(lists, "row_id", "left").select("id", "digest", "spans")
    return found_rows.unionByName(every.where("n = 0").select("id", "digest", F.lit(None).cast(lists.schema["spans"].dataType).alias("spans"))).select(
        "id", "digest", F.coalesce("spans", F.array().cast(lists.schema["spans"].dataType)).alias("spans")
    )


def _without(text: Column, spans: Column, mark: str) -> Column:
    """The text with ``mark`` in the place of its spans, which are ordered by start; of overlapping ones the first is marked."""
    def step(state: Column, s: Column) -> Column:
        more = F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], more).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda state: F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text))))


def redacted(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", repository_col: str = "doc_id", owner_col: str = "source", example_owners: int = 3, example_repositories: int = 10
) -> DataFrame:
    """The input with the live-looking spans of its texts replaced by ``mark``; overlapping spans become one.

    Widely copied examples stay. Spans go back to their texts by id and digest, so ids may be null or repeated.
    """
    live = F.filter("spans", lambda s: s["live"])
    found = _scanned(df, id_col, text_col, repository_col, owner_col, example_owners, example_repositories, text_digest(text_col))
    found = found.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), live.alias("__spans")).where(F.size("__spans") > 0)
    own = F.col(id_col).eqNullSafe(F.col("__id")) & (text_digest(text_col) == F.col("__digest"))
    rows = df.join(found.dropDuplicates(["__id", "__digest"]), own, "left")
    text = _without(F.col(text_col), F.col("__spans"), mark)
    return rows.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(text)).select(*df.columns)
