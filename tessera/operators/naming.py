"""Which of the names that a group knows a query means: by number, exact, contained, by all words, with codes for doubt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.records import written
from tessera.operators.skew import lookup

GRAM = 3


def plain_name(name: Column) -> Column:
    """Folded, without combining marks, white space collapsed."""
    return X.collapsed(F.regexp_replace(X.folded(F.coalesce(name, F.lit(""))), r"\p{Mn}", ""))


def _grams(token: Column) -> Column:
    """All runs of three characters; a shorter token is its own."""
    size = F.length(token)
    return F.when(size <= GRAM, F.array(token)).otherwise(F.transform(F.sequence(F.lit(1), size - GRAM + 1), lambda i: F.substring(token, i, F.lit(GRAM))))


def _all_grams(name: Column) -> Column:
    """All runs of one to three characters of a name."""
    size = F.length(name)
    runs = lambda k: F.when(size >= k, F.transform(F.sequence(F.lit(1), F.greatest(size - k + 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(runs(k) for k in range(1, GRAM + 1))))


def resolved(queries: DataFrame, names: DataFrame, group: str = "g", query: str = "query", name: str = "name", position: str = "position", query_id: str = "query_id") -> DataFrame:
    """query_id, code, position, matches: the name of its group that each query means.

    A number is the place of a name in its group, by ``position``, from 1. Otherwise the first rule under which any name is met decides:
    exact: the same plain name; contains: the query within it; fuzzy: all words of the query within it. One name is a match; several are
    ``ambiguous_`` with their count, and no position. Blank queries are empty_query, numbers out of range index_out_of_range, others not_found.

    Query ids are distinct. Null names are empty, which only numbers find. Only queries that no exact name meets go on: the distinct ones meet
    the distinct names, with their counts, by the rarest gram of their words, of which each name that qualifies has all.
    """
    q = queries.select(F.col(query_id).alias("id"), F.col(group).alias("g"), F.trim(F.coalesce(F.col(query), F.lit(""))).alias("raw")).withColumn("q", plain_name(F.col("raw")))
    q = q.withColumn("digits", F.col("raw").rlike("^[0-9]+$"))
    n = written(names.select(F.col(group).alias("g"), F.col(position).alias("at"), plain_name(F.col(name)).alias("name")), "names")
    out = lambda df, code, at, count: df.select("id", code.alias("code"), at.alias("position"), count.cast("long").alias("matches"))
    none, zero = F.lit(None).cast(n.schema["at"].dataType), F.lit(0)

    empty = out(q.where("raw = ''"), F.lit("empty_query"), none, zero)
    numbers = q.where("digits").withColumn("place", F.try_to_number("raw", F.lit("9" * 18)).cast("long"))
    placed = numbered(n)
    met = numbers.join(placed.hint("merge"), ["g", "place"], "left")
    numbers = out(met, F.when(F.col("at").isNull(), "index_out_of_range").otherwise("index"), F.col("at"), F.when(F.col("at").isNull(), 0).otherwise(1))

    # of equal names, and of equal queries of a group, one goes on; no side is broadcast, as names grow by their grams only after Spark has judged their size
    kinds = written(n.groupBy("g", "name").agg(F.count("*").alias("n"), F.min("at").alias("at")), "kinds")
    words = written(q.where("raw <> '' and not digits").withColumn("key", F.struct("g", "q")), "queries")
    equal = kinds.select(F.struct(F.col("g"), F.col("name").alias("q")).alias("key"), "n", "at")
    exact = written(lookup(words, equal, "key", "id"), "exact")
    exact_out = out(exact, F.when(F.col("n") > 1, "ambiguous_exact").otherwise("exact"), F.when(F.col("n") == 1, F.col("at")), F.col("n"))

    left = written(words.join(exact.select("id").hint("merge"), "id", "left_anti"), "left")
    alike = left.select("key", "g", "q").distinct().withColumn("tokens", F.filter(F.split("q", " "), lambda t: t != ""))
    alike = written(alike, "alike")
    asked = alike.select("key", "g", F.explode(F.array_distinct(F.flatten(F.transform("tokens", _grams)))).alias("gram"))
    held = kinds.select("g", "at", "name", "n", F.explode(_all_grams(F.col("name"))).alias("gram"))
    spread = held.groupBy("g", "gram").agg(F.count("*").alias("d")).select(F.struct("g", "gram").alias("of"), "d")
    counted = lookup(asked.withColumn("of", F.struct("g", "gram")), spread, "of", "key", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    rarest = counted.groupBy("key", "g").agg(F.min(F.struct("d", "gram")).alias("r")).where("r.d > 0").select("key", "g", F.col("r.gram").alias("gram"))
    near = rarest.join(alike.select("key", "q", "tokens").hint("merge"), "key").join(held.hint("merge"), ["g", "gram"])
    near = near.withColumn("contains", F.contains("name", F.col("q"))).where(F.forall("tokens", lambda t: F.contains(F.col("name"), t)))
    own = F.when(F.col("contains"), F.col("n")).otherwise(0)
    sums = near.groupBy("key").agg(F.sum(own).alias("c"), F.sum("n").alias("f"), F.min(F.when(F.col("contains"), F.col("at"))).alias("c_at"), F.min("at").alias("f_at"))
    far = lookup(left, written(sums, "sums"), "key", "id", "left")
    code = (
        F.when(F.col("c") == 1, "contains").when(F.col("c") > 1, "ambiguous_contains").when(F.col("f") == 1, "fuzzy").when(F.col("f") > 1, "ambiguous_fuzzy").otherwise("not_found")
    )
    at = F.when(F.col("c") == 1, F.col("c_at")).when((F.col("c") == 0) & (F.col("f") == 1), F.col("f_at"))
    found = out(far, code, at, F.when(F.col("c") > 0, F.col("c")).otherwise(F.coalesce("f", F.lit(0))))
    return empty.unionByName(numbers).unionByName(exact_out).unionByName(found).withColumnRenamed("id", query_id)


def numbered(names: DataFrame) -> DataFrame:
    """g, place, at: the names of a group by position, from 1."""
    return names.select("g", "at", F.row_number().over(Window.partitionBy("g").orderBy("at")).cast("long").alias("place"))
