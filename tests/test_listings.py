"""Listings on odd texts: nulls, no header, repeated links, lines of other forms, dates against Python's patterns."""

import re

from pyspark.sql import functions as F

from tessera.operators import listings as L


def test_search_hits(spark):
    texts = [None, "", "no hit\n- x", "1. [a](https://x/1)\r\n  one\n\n- noise\n - kept\n2. [hub] [b](https://x/2)\n3. [c](https://x/1)\nlost", "1. a](https://x)\n12. [d e](http://y/(1)"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", L.search_hits(F.col("text")).alias("h")).collect()
    hits = {r.i: [tuple(h) for h in r.h] for r in got}
    assert hits[0] == hits[1] == hits[2] == []
    assert hits[3] == [(1, "", "a", "https://x/1", "one - kept"), (2, "hub", "b", "https://x/2", "")]
    assert hits[4] == [(1, "", "d e", "http://y/(1", "")]


def test_numbered_items(spark):
    text = "head\n 1. Essay one ⚠ VENCIDA \n Curso: A\n Curso : B\nURL\n2. Two\nFecha: 2020-01-01"
    df = spark.createDataFrame([(0, None), (1, text)], "i int, text string")
    got = {r.i: [tuple(x) for x in r.n] for r in df.select("i", L.numbered_items(F.col("text"), {"course": "Curso", "due": "Fecha", "url": "URL"}).alias("n")).collect()}
    assert got == {0: [], 1: [(1, "Essay one", True, "B", "", ""), (2, "Two", False, "", "2020-01-01", "")]}


def test_relative_dates(spark):
    texts = ["hoy", "ahoy", "3 시간 전", "x 5日前 y", "5日前後", "hace 2 dias", "HACE 2 DÍAS", "", "just now, today", "12 days ago", "12 daysago"]
    plain = [next((m.group(0) for p in L.RELATIVE_DATES if (m := re.search(p, t, re.IGNORECASE))), t) for t in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(L.relative_date(F.col("t")).alias("d")).collect()
    assert [r.d for r in got] == plain


def test_property_documents(spark):
    kinds = {"a": "title", "b": "date", "c": "url"}
    df = spark.createDataFrame([('q"\n', None, "u"), (None, "2020-01-01", None)], "a string, b string, c string")
    back = df.select(L.property_document(kinds).alias("d")).select(*L.flattened_properties(F.col("d"), kinds)).collect()
    assert sorted(map(tuple, back)) == [("", "2020-01-01", ""), ('q"\n', "", "u")]


def test_letters_lose_their_marks(spark):
    import unicodedata

    from pyspark.sql import functions as F

    from tessera.functions import text as X

    rows = ["Ελλάδα Ὀδύσσεια", "ЁЖИК й", "Đường phố Việt Nam", "ａｂｃ１", "ñandú Ñ", "Crème BRÛLÉE", "e\u0301\u0308", "Łódź", "ẞtraße", "日本語 한글", "", "it's"]
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFC", s.lower())) if not unicodedata.combining(c))
    got = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", X.folded(F.col("t")).alias("f")).collect()
    assert {r.i: unicodedata.normalize("NFKD", r.f) for r in got} == {i: plain(t) for i, t in enumerate(rows)}
    assert len(X.MARKED) == len(set(X.MARKED)) and 500 < len(X.PLAIN) < len(X.MARKED)
