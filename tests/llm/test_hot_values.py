"""One value in a third of all rows or more; secrets by owners and repositories, against plain counts."""

import hashlib
import random
from collections import defaultdict

from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.q_secrets import op2_secret_scan
from tessera.llm.secrets import scan_secrets


def value(n):
    return "token=" + hashlib.sha256(str(n).encode()).hexdigest()[:14].upper() + "Zz"


def test_secrets_by_owners_and_repositories(spark):
    r = random.Random(7)
    plan = {0: (1, 3000), 1: (2, 2), 2: (2, 10), 3: (2, 9), 4: (3, 3), 5: (5, 400), 6: (1, 1), 7: (2, 1000)}
    data, held = [], defaultdict(set)
    for v, (owners, repositories) in plan.items():
        for k in range(repositories):
            doc, owner = len(data), f"o{k % owners}"
            data.append((doc, f"{'x ' * r.randrange(4)}{value(v)} end", owner))
            held[v].add((owner, doc))
    r.shuffle(data)
    got = {x.doc_id: x.spans for x in scan_secrets(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(7)).collect()}
    assert len(got) == len(data)
    for v, pairs in held.items():
        owners, repositories = len({o for o, _ in pairs}), len({d for _, d in pairs})
        live = not (owners >= 3 or (owners == 2 and repositories >= 10))
        for _, doc in pairs:
            (span,) = got[doc]
            assert (span.owners, span.repositories, span.live) == (owners, repositories, live)
    assert [v for v in plan if got[min(d for _, d in held[v])][0].live] == [0, 1, 3, 6]


def test_the_query_counts_examples(spark, tmp_path):
    data = [(i, f"a {value(1)} b", f"o{i % 3}") for i in range(30)] + [(50, value(2), "o1"), (51, None, "o1")]
    spark.createDataFrame(data, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op2_secret_scan(spark, str(tmp_path)).collect()}
    assert (got[0].n_live, got[0].n_example, got[0].n_assign, got[0].spans) == (0, 1, 1, "assign:8:24")
    assert (got[50].n_live, got[50].n_example, got[51].n_assign, got[51].spans) == (1, 0, 0, "")
    assert got[0].base_sha256 == hashlib.sha256(b"assign:8:24").hexdigest() and got[51].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_exact_dedup_of_a_hot_text(spark):
    r = random.Random(1)
    data = [(i if i % 50 else None, "same" if i % 3 else None if i % 2 else f"t{r.randrange(200)}") for i in range(3000)] + [(1, "same")] * 40
    got = sorted((x.doc_id is None, x.doc_id, x.text_sha256, x.keep_id, x.group_size, x.kept) for x in exact_dedup(spark.createDataFrame(data, "doc_id long, text string")).fillna(-1, ["doc_id"]).collect())
    groups = defaultdict(list)
    for i, t in data:
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(False, -1 if i is None else i, hashlib.sha256(t.encode()).hexdigest(), keep, len(ids), i == keep) for i in ids]
    assert got == sorted(want)
