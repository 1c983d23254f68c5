"""Joined answers: what each rule makes of a few probes, written out."""

from tessera.operators import probes as P

LONG = "one two three four five six seven eight nine ten eleven twelve thirteen"


def answer(spark, rows):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "q int, i int, response string, source string, urls array<string>")
    (x,) = P.synthesized(df, "q", "i", "response", "source", "urls").collect()
    return x.best_source, x.score, x.answer


def test_results_of_all_are_listed(spark):
    got = answer(spark, [("Team A 1 - 2 Team B\n x  \nTeam  C 3-0 D and more words here to read", "w1", ["u1", "", "u2"]), ("Team C 3-0 D and more words here to read\nE 5 - 5 F more\nG 6-6 H more\nI 7-7 J more", "search_direct_x", ["u2", "u3"]), (None, None, None)])
    assert got == ("search_direct_x", 10, "Fuente más confiable: search_direct_x\n- Team C 3-0 D and more words here to read\n- E 5 - 5 F more\n- G 6-6 H more\n- I 7-7 J more\n\nSources:\n- [search_direct_x](u2)\n- [search_direct_x](u3)\n- [w1](u1)")


def test_a_short_answer_is_backed(spark):
    assert answer(spark, [("yes, dato", "a", None), ("  no ", "b", []), ("", "c", None)]) == ("a", 1, "yes, dato\n\nRespaldo de b: no")
    assert answer(spark, [(LONG, "a", None), ("short", "b", None)]) == ("a", 0, LONG)


def test_nothing(spark):
    assert answer(spark, [(" ", None, None)]) == ("worker", -100, P.NOTHING)
    none = spark.createDataFrame([], "q int, i int, response string, source string, urls array<string>")
    assert P.synthesized(none, "q", "i", "response", "source", "urls").collect() == []


def test_scores_and_ties(spark):
    rows = [("no pude, sin dato de nada que sea de verdad útil aquí", "x"), (LONG, "x"), (f"{LONG} my source", "my_source"), (" ".join(["w"] * 81), "x"), ("a 1-0 b", "search_refined_y")]
    df = spark.createDataFrame(rows, "r string, s string")
    assert [x.p for x in df.select(P.probe_score(df.r, df.s).alias("p")).collect()] == [-7, 2, 2, -1, 7]
    assert answer(spark, [("same text of eight words or more for all", "first", None), ("same text of eight words or more for all", "second", None)])[0] == "first"


def test_six_sources_at_most(spark):
    got = answer(spark, [(LONG, "w", [f"u{i}" for i in range(9)])])[2]
    assert got.count("](u") == 6 and got.endswith("- [w](u5)")
