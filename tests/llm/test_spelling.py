"""Spelling variants against all pairs, in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm.q_spelling import op11_spelling
from tessera.llm.spelling import digit, roots, variants, words

rng = random.Random(8)
NAMES = ["word", "form", "root", "n", "n_near", "form_n"]


def plain_words(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(counts):
    form, rows = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if near(v, w)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
        rows[w] = (n, len(others), counts[best] if form[w] else None)
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, *rows[w]))
    return out


def changed(w):
    i, c = rng.randrange(len(w) + 1), rng.choice("abcéÿ×")
    return rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])


def vocabulary():
    out = ["aaaaaa", "aaaaaaa", "aabbaabb", "aabaabb", "internationally", "internationale", "international", "ababababab", "zzzzzzzzzzzz", "éééééééé", "long" * 40, "long" * 40 + "s"]
    for _ in range(25):
        w = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(6, 14)))
        out += [w, *(changed(w) for _ in range(6))]
    return sorted({w for x in out for w in (x, changed(x), changed(changed(x)))})


def test_variants(spark):
    counts = {w: int(5 * 6 ** rng.randrange(5)) for w in vocabulary() if len(w) > 5}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    got = {tuple(r[c] for c in NAMES) for r in variants(df).collect()}
    assert got == plain(counts)
    assert sum(r[1] is not None and r[2] != r[1] for r in got) > 5


@pytest.fixture(scope="module")
def docs():
    own = vocabulary()
    rows = [(i, " ".join(rng.choice(own[:200]).title() if rng.random() < 0.2 else rng.choice(own) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(i, ("Recieve receive-receive_recieved " * 40)) for i in range(300, 340)]
    odd = [(None, "Nullness nullness NULLNESS nullness nullness nullnes"), (None, "nullnes " * 9), (7, None), (8, ""), (9, "1 2 -- ÀÉÎ×÷ßÿ ÀÉÎ×÷ßÿ"), (400, "ÀÉÎ×÷ßÿ " * 5 + "àéî×÷ßÿ " * 30), (401, "hundreds " * 60_000), (401, "hundreds " * 3)]
    return rows + odd + rows[:20]


def test_query(spark, docs, tmp_path):
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, n long, word string").repartition(4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    counts = plain_words(docs)
    assert {r.word: r.n for r in words(df, "doc_id", "text").collect()} == counts and len(counts) > 100
    assert {tuple(r[c] for c in NAMES) for r in op11_spelling(spark, str(tmp_path)).collect()} == plain(counts)


def test_one_first_half(spark):
    counts = {"commonfirst" + "".join(rng.choice("abc") for _ in range(rng.randrange(6))): rng.randrange(5, 400) for _ in range(300)}
    got = {tuple(r[c] for c in NAMES) for r in variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == plain(counts)


def test_roots_of_a_long_chain(spark):
    forms = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(200)], "word string, form string")
    assert {r.root for r in roots(forms).collect()} == {"w200"}


def test_digits_and_empty(spark):
    assert sorted(map(digit, "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100))))) == list(range(1, 91))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants(words(empty, "doc_id", "text")).collect() == []
