"""Choices for a key: its current score, context, queries, lines, sections, and its row in a registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import score as S
from tessera.functions import text as X

MOST_LANGUAGES, MOST_TERMS, MOST_QUERIES, MOST_SECTIONS = 2, 3, 6, 4


def current_scores(results: DataFrame, key: str, at: int) -> DataFrame:
    """Each key's score as turn ``at`` reads it (key, last_turn, current): that of its last turn, 0 once the key is idle.

    A null score counts as 0, a null turn as turn 0; of one turn's rows the greatest score counts.
    """
    last = results.groupBy(key).agg(F.max(F.struct(F.coalesce("turn", F.lit(0)).alias("turn"), "score")).alias("l"))
    idle = F.lit(at) - F.col("l.turn") > S.IDLE_TURNS
    return last.select(key, F.col("l.turn").alias("last_turn"), F.when(idle, 0.0).otherwise(F.coalesce("l.score", F.lit(0.0))).alias("current"))


def decision_context(prior: Column, strategy: Column, category: Column, promoted: dict[str, str]) -> list[Column]:
    """What a decision knew: prior_reliability, exploration_rate, recommended, prediction_match (null without a recommendation)."""
    prior = F.coalesce(prior, F.lit(0.0))
    recommended = F.lit(None).cast("string")
    for name, best in promoted.items():
        recommended = F.when(category == name, best).otherwise(recommended)
    match = F.when(recommended.isNotNull(), strategy.eqNullSafe(recommended))
    return [S.band_reliability(prior).alias("prior_reliability"), S.exploration(prior).alias("exploration_rate"), recommended.alias("recommended"), match.alias("prediction_match")]


def capped_queries(domain: Column, languages: Column, terms: dict[str, list[str]]) -> Column:
    """Site queries as an array of (language, query): the first languages by their first terms, then a cap, then distinct.

    Without any, one fallback query of the domain alone. Null languages and unknown ones have no terms.
    """
    known = F.create_map(*(x for name, own in terms.items() for x in (F.lit(name), F.array(*map(F.lit, own)) if own else F.array().cast("array<string>"))))
    none = F.array().cast("array<string>")
    site = F.concat(F.lit("site:"), domain)
    of = lambda l: F.transform(F.slice(F.when(l.isNull(), none).otherwise(F.coalesce(F.try_element_at(known, l), none)), 1, MOST_TERMS), lambda t: F.struct(l.alias("language"), F.trim(F.concat(site, F.lit(" "), F.trim(t))).alias("query")))  # noqa: E731, E741
    found = F.slice(F.flatten(F.transform(F.slice(languages, 1, MOST_LANGUAGES), of)), 1, MOST_QUERIES)
    distinct = F.filter(found, lambda q, i: F.array_position(F.transform(found, lambda x: x["query"]), q["query"]) == i + 1)
    return F.when(F.size(found) > 0, distinct).otherwise(F.array(F.struct(F.lit("fallback").alias("language"), site.alias("query"))))


def line_signature(line: Column, stopwords: tuple[str, ...]) -> Column:
    """The first ten folded words of more than three letters that are no stop words."""
    words = F.regexp_extract_all(X.folded(line), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.array_join(F.slice(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*stopwords)), 1, 10), " ")


def distinct_lines(lines: DataFrame, of: str, place: str, line: str, stopwords: tuple[str, ...]) -> DataFrame:
    """Of lines of one text, bullets taken off, the first of each signature; lines without one by themselves. Blank and null lines go.

    Equal lines have equal signatures, so the first of a signature is what a walk with two seen sets keeps.
    """
    own = lines.withColumn(line, F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"[ \t\r\f]+", " ")), "^[-•] +", "")).where(F.col(line) != "")
    signature = line_signature(F.col(line), stopwords)
    by = F.when(signature != "", F.concat(F.lit("s"), signature)).otherwise(F.concat(F.lit("l"), F.lower(line)))
    order = Window.partitionBy(of, "__by").orderBy(place)
    return own.withColumn("__by", F.sha2(by, 256)).withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__by", "__r")


def top_sections(links: DataFrame, of: str, place: str, path: Column, score: Column, area: Column) -> DataFrame:
    """The best sections of each page: scored links, the first of each path, by score, area and short path; ``rank`` from 1."""
    scored = links.withColumn("__path", path).withColumn("__score", score).withColumn("__area", area).where("__score > 0")
    first = scored.withColumn("__r", F.row_number().over(Window.partitionBy(of, "__path").orderBy(place))).where("__r = 1")
    best = Window.partitionBy(of).orderBy(F.desc(F.col("__score") + F.col("__area")), F.desc("__area"), F.length("__path"), place)
    return first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= MOST_SECTIONS).drop("__path", "__score", "__area", "__r")


def updated_registry(workers: DataFrame, updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Workers (key, status, updated_at, metadata, ...) after updates (key, status, at, metadata): the last counts; null values leave those before.

    Updates of unknown or null keys are ignored. ``order``: columns of the updates that order them.
    """
    rank = [F.col(c) for c in order]
    last = updates.groupBy(key).agg(
        F.max(F.struct(*rank, F.col("status").alias("s"), F.col("at").alias("t"))).alias("__last"),
        F.max(F.when(F.col("metadata").isNotNull(), F.struct(*rank, F.col("metadata").alias("m")))).alias("__meta"),
    )
    out = workers.join(last, key, "left")
    for name, new in (("status", "__last.s"), ("updated_at", "__last.t"), ("metadata", "__meta.m")):
        out = out.withColumn(name, F.coalesce(new, name))
    return out.drop("__last", "__meta")
