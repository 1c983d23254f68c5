"""Answers of several workers to one question: scored, ranked, and joined to one answer with what others confirm and all sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.sections import full_lines, stripped

#: Markers of answers without a result, words of answers that show something, the line that a result stands on, what to say.
FAILED = ("no pude", "sin dato", "no encontré", "no logré")
SHOWING = ("respuesta", "verificable", "evidencia", "fuente", "dato", "hecho", "confirmado")
RESULT, RESULT_LINE = r"\b\d+\s*-\s*\d+\b", r"\b.+?\b\d+\s*-\s*\d+\b.+"
NOTHING, TRUSTED, BACKED = "No pude obtener resultados claros para esta consulta.", "Fuente más confiable: ", "Respaldo de "
MOST_LINES, MOST_SOURCES, FEW_WORDS = 4, 6, 12


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def probe_score(response: Column, source: Column) -> Column:
    """How much an answer shows: a result counts 8, its markers, its source's name and its length a little; blank answers -100."""
    low = F.lower(response)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    points = sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in SHOWING), F.lit(0)) - F.when(has(FAILED), 8).otherwise(0) + F.when(response.rlike(RESULT), 8).otherwise(0)
    points = points + F.when(F.contains(low, F.lower(F.replace(source, F.lit("_"), F.lit(" ")))), 2).otherwise(0)
    points = points + F.when(source.startswith("search_direct"), 2).when(source.startswith("search_refined"), 1).otherwise(0)
    return F.when(stripped(response) == "", -100).otherwise(points - F.when(_words(response) < 8, 2).when(_words(response) > 80, 1).otherwise(0))


def _firsts(rows: DataFrame, what: str, most: int) -> DataFrame:
    """q and the first ``most`` distinct values, each with its title, in the order of (rank, at)."""
    first = rows.groupBy("q", what).agg(F.min(F.struct("rank", "at", "source")).alias("o"))
    top = first.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy("o"))).where(F.col("i") <= most)
    return top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("i", F.col(what).alias("value"), F.col("o.source").alias("title")))).alias(f"{what}s"))


def synthesized(probes: DataFrame, question: str, place: str, response: str, source: str, urls: str) -> DataFrame:
    """question, best_source, score, answer of each question that was probed.

    Answers are ranked by score, length and ``place``. If any holds lines with results, the answer names the best source and lists the first four distinct ones
    in order of rank; else it is the best answer. The first six distinct URLs follow as sources, each under the name that brought it first; an answer that
    is still of twelve words or fewer is followed by the second one. Null answers are empty, null names ``worker``, null or empty URLs none; a null
    question is one of its own.
    """
    rows = probes.select(F.struct(F.col(question).alias("of")).alias("q"), F.col(place).alias("place"), F.coalesce(response, F.lit("")).alias("response"), F.coalesce(source, F.lit("worker")).alias("source"), F.col(urls).alias("urls"))
    rows = rows.withColumn("score", probe_score(F.col("response"), F.col("source"))).withColumn("rank", F.struct((-F.col("score")).alias("s"), (-F.length("response")).alias("l"), "place"))
    lines = F.filter(F.transform(full_lines(F.col("response")), X.collapsed), lambda line: line.rlike(RESULT_LINE))
    listed = _firsts(rows.select("q", "rank", "source", F.posexplode(lines).alias("at", "line")), "line", MOST_LINES)
    linked = _firsts(rows.select("q", "rank", "source", F.posexplode(F.filter("urls", lambda u: u != "")).alias("at", "url")), "url", MOST_SOURCES)
    two = rows.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).where("i <= 2")
    pick = lambda i, name: F.max(F.when(F.col("i") == i, F.col(name)))
    best = two.groupBy("q").agg(*(pick(i, c).alias(f"{c}{i}") for i in (1, 2) for c in ("response", "source", "score")))
    out = best.join(listed, "q", "left").join(linked, "q", "left")
    body = F.concat(F.lit(TRUSTED), F.col("source1"), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("\n- "), x["value"])), ""))
    alone = F.coalesce(F.nullif(stripped(F.col("response1")), F.lit("")), F.lit(NOTHING))
    sources = F.concat(F.lit("\n\nSources:\n"), F.array_join(F.transform("urls", lambda x: F.concat(F.lit("- ["), x["title"], F.lit("]("), x["value"], F.lit(")"))), "\n"))
    out = out.withColumn("answer", F.concat(F.coalesce(body, alone), F.coalesce(sources, F.lit(""))))
    second = stripped(F.coalesce("response2", F.lit("")))
    backed = (_words(F.col("answer")) <= FEW_WORDS) & (second != "") & (second != F.col("answer"))
    answer = F.when(backed, F.concat("answer", F.lit(f"\n\n{BACKED}"), "source2", F.lit(": "), second)).otherwise(F.col("answer"))
    return out.select(F.col("q.of").alias(question), F.col("source1").alias("best_source"), F.col("score1").alias("score"), answer.alias("answer"))
