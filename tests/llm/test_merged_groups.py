"""Links found between groups join whole groups, as a plain search over all links does."""

import random

from tessera.llm.components import components
from tessera.llm.jaccard_join import _merged


def plain(edges):
    label = {c: c for e in edges for c in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            least = min(label[a], label[b])
            changed |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return label


def test_merged_groups(spark):
    rng = random.Random(5)
    links = [(rng.randrange(-40, 40), rng.randrange(-40, 40)) for _ in range(35)]
    links = [(a, b) for a, b in links if a != b]
    extra = [(-3, 77), (77, 78), (90, 91), (links[0][0], links[-1][1]), (links[5][0], 90), (links[0][0], links[-1][1])]
    groups = components(spark.createDataFrame(links, "a long, b long"))
    more = spark.createDataFrame(extra, "a long, b long")
    ends = more.selectExpr("a AS c").union(more.selectExpr("b AS c")).distinct()
    got = [tuple(r) for r in _merged(groups, more, ends).select("c", "label").collect()]
    assert len(got) == len(dict(got))
    assert dict(got) == plain(links + extra)
