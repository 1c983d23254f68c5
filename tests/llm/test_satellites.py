"""A class beside a large group: it meets the members that it can link with by a key, not all of them."""

from tessera.llm import jaccard_join as J


def test_members_meet_by_their_keys(spark):
    rows = [(7, c, 100, 0 if c == 3 else 15, 1) for c in range(1, 401)] + [(8, 5, 100, 11, 1), (7, 900, 100, 0, 2), (8, 900, 100, 12, 2), (9, 900, 100, 1, 2)]
    members = spark.createDataFrame(rows, "key long, c long, n int, i int, g long")
    qualifying = spark.createDataFrame([(2, 1)], "a long, b long")
    assert sorted(map(tuple, J._opened(qualifying, members, 80, 100).collect())) == [(900, 3)]
