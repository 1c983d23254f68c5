"""Name resolution against the rules read off one by one."""

import random
import unicodedata

from tessera.operators.naming import resolved

r = random.Random(9)


def plain(s):
    return " ".join("".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c)).lower().split())


def meaning(query, names):
    """code, position, matches of one query among the (position, name) of its group."""
    raw = (query or "").strip()
    if not raw:
        return "empty_query", None, 0
    names = sorted(names)
    if raw.isdigit():
        return ("index", names[int(raw) - 1][0], 1) if 1 <= int(raw) <= len(names) else ("index_out_of_range", None, 0)
    q = plain(raw)
    for code, test in (("exact", lambda n: n == q), ("contains", lambda n: q in n), ("fuzzy", lambda n: all(t in n for t in q.split()))):
        met = [at for at, n in names if test(plain(n))]
        if met:
            return (code, met[0], 1) if len(met) == 1 else (f"ambiguous_{code}", None, len(met))
    return "not_found", None, 0


def test_resolved(spark):
    words = ["Álgebra", "lineal", "Física", "II", "historia", "de", "la", "ñandú", "x", "ab", "Análisis"]
    names = [(g, 10 * i, " ".join(r.choice(words) for _ in range(r.randrange(1, 5)))) for g in "abc" for i in range(25)]
    names += [("a", 900, None), ("a", 901, ""), ("b", 902, "  Algebra   LINEAL "), ("d", 1, "only"), (None, 2, "lost")]
    own = [None, "", "  ", "1", "26", "27", "0", "99999999999999999999999", "algebra lineal", "ÁLGEBRA", "gebra", "lineal algebra", "x", "a", "de la", "la de x", "zzz", "fis", "física  ii", "ali li", "only", "é", "12a"]
    own += [" ".join(r.choice(words)[: r.randrange(1, 8)] for _ in range(r.randrange(1, 4))) for _ in range(60)]
    queries = [(i, g, q) for i, (g, q) in enumerate((g, q) for g in ("a", "b", "c", "d", "none", None) for q in own)]
    df = spark.createDataFrame(queries, "query_id long, g string, query string")
    got = {x.query_id: (x.code, x.position, x.matches) for x in resolved(df, spark.createDataFrame(names, "g string, position long, name string")).collect()}
    held = {}
    for g, at, n in names:
        held.setdefault(g, []).append((at, n))
    assert got == {i: meaning(q, held.get(g, []) if g else []) for i, g, q in queries}
    assert len({c for c, *_ in got.values()}) == 10


def test_many_to_many(spark):
    names = spark.createDataFrame([("g", i, f"part {i % 2}") for i in range(2000)], "g string, position long, name string")
    df = spark.createDataFrame([(i, "g", q) for i, q in enumerate(["part 1"] * 300 + ["1 part"] * 3)], "query_id long, g string, query string")
    got = resolved(df, names).groupBy("code", "matches", "position").count().collect()
    assert {tuple(x) for x in got} == {("ambiguous_exact", 1000, None, 300), ("ambiguous_fuzzy", 1000, None, 3)}
