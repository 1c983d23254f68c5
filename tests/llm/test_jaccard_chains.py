"""Links found only through a group of which a single class, not its label, has a frequent token."""

import random

from tessera.llm import jaccard_join
from tests.llm import brute


def test_chain_through_a_group_of_one_frequent_class(spark):
    r = random.Random(3)
    common = [f"g{i}" for i in range(40)]
    data = []
    for u in range(40):  # the classes' order is by hash: one vocabulary each
        often, rare = [f"f{u}x{i}" for i in range(7)], [f"r{u}x{i}" for i in range(3)]
        own = lambda name: [f"{name}{u}x{i}" for i in range(3)]  # noqa: E731, B023
        chain = [often + own("x"), often + rare, often[:4] + rare + own("p")]  # x links with q, q with p
        data += [" ".join(w) for w in chain + [often + r.sample(common, 18) for _ in range(12)]]
    data = list(enumerate(data))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.jaccard_components(df, words=1, num=50).collect()))
    want = brute.jaccard_components(data, 1, 50)
    assert all(want[15 * u + 2][2] == 15 * u for u in range(40))
    assert got == want
