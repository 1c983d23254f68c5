"""Inputs of unknown form, one a row: a JSON array of numbers or of objects, CSV with a header, or text; and their profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.sections import lines, stripped

NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$"


def _fields(line: Column) -> Column:
    """The fields of a line of CSV; quotes may hold commas and doubled quotes."""
    bare = lambda f: F.when(f.rlike('^".*"$'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), bare)


def _all_elements(inputs: DataFrame, key: str, text: str) -> DataFrame:
    """id, form and the elements of each input: JSON values, or the fields of a line."""
    rows = inputs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("values", F.try_variant_get(F.try_parse_json("t"), "$", "array<variant>"))
    rows = rows.withColumn("first", F.schema_of_variant(F.get("values", F.lit(0))))
    rows = rows.withColumn("lines", F.filter(lines(stripped(F.col("t"))), lambda line: line != ""))
    numbers = (F.size("values") >= 2) & F.forall("values", lambda v: F.coalesce(F.schema_of_variant(v).rlike(NUMBER), F.lit(False)))
    form = F.when(F.coalesce(numbers, F.lit(False)), "numbers").when(F.coalesce(F.col("first").startswith("OBJECT"), F.lit(False)), "objects").when(F.size("lines") >= 2, "csv").otherwise("text")
    return rows.withColumn("form", form)


def profiles(inputs: DataFrame, key: str, text: str) -> DataFrame:
    """id, form, n_rows, column, kind, n, lo, hi, mean, std, total, n_distinct of each column of each input, rounded to two places.

    An input is numbers if it is a JSON array of two numbers or more, objects if it is one whose first element is an object, csv if it has two lines or more
    that aren't blank, else text, which has one row without figures. The columns are the keys of the first object, or the header's names; numbers have one
    column, ``value``. A column is number if any of its values is one: n counts those, and the figures are of them alone, std where there are two. Other columns are
    category, with the number of distinct values, null not counted for objects. Elements that are no objects, keys that the first object hasn't got,
    fields beyond the header, and missing ones hold nothing. Quoted line ends aren't read. Null counts as empty text. Keys are distinct.
    """
    rows = _all_elements(inputs, key, text)
    number = lambda v: F.when(F.schema_of_variant(v).rlike(NUMBER), F.try_variant_get(v, "$", "double"))
    many = rows.where("form = 'numbers'").select("id", "form", F.size("values").alias("n_rows"), F.explode("values").alias("v"))
    many = many.select("id", "form", "n_rows", F.lit("value").alias("column"), number(F.col("v")).alias("x"), F.lit(None).cast("string").alias("s"))

    whole = rows.where("form = 'objects'").withColumn("names", F.map_keys(F.try_variant_get(F.get("values", F.lit(0)), "$", "map<string,variant>")))
    objects = whole.select("id", "form", F.size("values").alias("n_rows"), "names", F.explode("values").alias("v"))
    objects = objects.withColumn("m", F.try_variant_get("v", "$", "map<string,variant>")).select("id", "form", "n_rows", "m", F.explode("names").alias("column"))
    objects = objects.withColumn("v", F.try_element_at("m", F.col("column"))).select("id", "form", "n_rows", "column", number(F.col("v")).alias("x"), F.try_variant_get("v", "$", "string").alias("s"))

    table = rows.where("form = 'csv'").select("id", "form", (F.size("lines") - 1).alias("n_rows"), _fields(F.get("lines", F.lit(0))).alias("names"), F.explode(F.slice("lines", 2, F.size("lines"))).alias("line"))
    table = table.withColumn("fields", _fields(F.col("line"))).select("id", "form", "n_rows", "fields", F.posexplode("names").alias("at", "column"))
    field = F.get("fields", F.col("at"))
    table = table.select("id", "form", "n_rows", "column", F.trim(field).try_cast("double").alias("x"), F.coalesce(field, F.lit("")).alias("s"))

    r = lambda c: F.round(c, 2)
    held = many.unionByName(objects).unionByName(table).groupBy("id", "form", "n_rows", "column")
    out = held.agg(
        F.when(F.count("x") > 0, "number").otherwise("category").alias("kind"), F.count("x").alias("n"), r(F.min("x")).alias("lo"), r(F.max("x")).alias("hi"), r(F.avg("x")).alias("mean"), r(F.when(F.count("x") > 1, F.stddev_samp("x"))).alias("std"),
        r(F.sum("x")).alias("total"), F.when(F.count("x") == 0, F.count_distinct("s")).alias("n_distinct"),
    )
    rest = rows.where("form = 'text'").select("id", "form", F.lit(0).alias("n_rows"))
    return out.unionByName(rest, allowMissingColumns=True).withColumnRenamed("id", key)
