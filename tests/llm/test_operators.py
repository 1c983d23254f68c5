"""Each operator on odd rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import jaccard_join, perplexity, toxicity
from tessera.llm.chat import format_conversations, read_back
from tessera.llm.components import components
from tessera.llm.exact_dedup import deduplicated, exact_dedup
from tessera.llm.packing import ChunkEncoder, pack, pack_documents
from tessera.llm.pieces import decode, encode
from tessera.llm.secrets import BASE, redacted, scan_secrets
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.topk import top_k
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, block long, n int, c long, keep_id long, ids string, group int, rank string"
rng = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(rng.choice(WORDS) for _ in range(30_000))
PASSAGE = " ".join(rng.choice(WORDS) for _ in range(40))


def sentence(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _texts():
    base = sentence(200)
    near = base.split()
    near[17] = "changed"
    return [
        None, "", " \t\n ", "one", "one", "Two words", "two WORDS", base, base, " ".join(near), base + " tail", LONG, LONG + " x",
        sentence(30) + " " + PASSAGE + " " + sentence(20), PASSAGE, PASSAGE + " " + PASSAGE, "é ü 日本 x <|im_end|> ▁ a", "de " * 500,
        'password = "abcDEF123456789" and AKIA' + "A1" * 9 + " " + "0f" * 20, "token: " + "A1b2C3d4E5f6G7h8", "x\x1cy z",
    ]


TEXTS = _texts()


def texts():
    return list(TEXTS)


def rows(ids=None):
    t = texts()
    ids = ids or list(range(len(t)))
    return [(i, x, ("en", "de", None)[k % 3], f"s{k % 4}", None, 1, 2, 3, 4, 5, "i", 6, "r") for k, (i, x) in enumerate(zip(ids, t, strict=True))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def repeated(spark):
    """Every row twice, and rows without an id."""
    r = rows()
    return spark.createDataFrame(r + r + [(None, *x[1:]) for x in r], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(21)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def test_exact_dedup(docs, repeated, empty):
    got = {r.doc_id: r for r in exact_dedup(docs, salts=2).collect()}
    for i, t in enumerate(texts()):
        same = [k for k, x in enumerate(texts()) if (x or "") == (t or "")]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))
        assert got[i].text_sha256 == brute.sha(t or "")
    assert exact_dedup(repeated).count() == 63 and exact_dedup(empty).count() == 0 and deduplicated(empty).count() == 0
    once = deduplicated(repeated)
    assert once.count() == len({t or "" for t in texts()}) and once.columns == repeated.columns


def test_chat(spark):
    odd = ["", None, "<|im_end|>", "a<\\|b<|", "<\\\\|", "x\n\ny", "<|im_start|>assistant\nhi<|im_end|>\n", "%0A \\"]
    data = [(c, t, ("user", "assistant", None, "sys\ntem<|", "%0A")[(c + t) % 5], odd[(c * 3 + t) % len(odd)], "x") for c in range(6) for t in range(4)]
    data += [(0, 1, "user", "tie", "x"), (0, 1, "user", "tie", "x"), (None, None, None, None, None)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, segments string")
    got = {r.conv_id: r for r in format_conversations(df).withColumn("turns", read_back("formatted")).collect()}
    assert len(got) == 7
    for c in got:
        want = sorted(((-1 if t is None else t), r or "", x or "") for k, t, r, x, _ in data if k == c)
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in want]
        assert got[c].formatted == "".join(s.text for s in got[c].segments)
    valid = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "user", "u")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.valid for r in format_conversations(valid).collect()} == {1: True, 2: False, 3: False}
    assert format_conversations(df.limit(0)).count() == 0


def test_secrets(docs, repeated, empty):
    got = {r.doc_id: r.spans for r in scan_secrets(docs).collect()}
    for i, t in enumerate(texts()):
        want = []
        for k, (_, pattern, group, least) in enumerate(BASE):
            pattern = re.compile("[0-9a-f]+") if k == 2 else pattern
            want += [(m.start(group), k, m.end(group)) for m in pattern.finditer(t or "") if m.end(group) - m.start(group) >= least]
        assert [(s.start, s.kind, s.end) for s in got[i] if s.kind < 3] == sorted(want)
    assert scan_secrets(repeated).count() == 63 and scan_secrets(empty).count() == 0
    clean = {r.doc_id: r.text for r in redacted(docs).collect()}
    assert "abcDEF123456789" not in clean[18] and clean[7] == texts()[7] and clean[0] is None
    assert redacted(empty).count() == 0


def test_widely_copied_secrets_are_examples(spark):
    common, own = "token=" + "Ab1" * 8, "token=" + "Zx9" * 8
    df = spark.createDataFrame([(i, common, f"o{i}") for i in range(5)] + [(9, own, "o1"), (10, own, "o1")], "doc_id long, text string, source string")
    got = {r.doc_id: [s.live for s in r.spans] for r in scan_secrets(df).collect()}
    assert not any(got[0]) and all(got[9]) and got[9]


def test_substring_dedup(docs, repeated, empty, spark):
    got = sorted((r.doc_id, r.n_words, sum(s.end - s.start for s in r.removed), r.kept_text) for r in substring_dedup(docs).collect())
    assert got == sorted(brute.substring_dedup([(i, t) for i, t in enumerate(texts())]))
    key = lambda r: (r[0] is None, r)
    twice = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.removed), r.kept_text) for r in substring_dedup(repeated).collect()]
    want = brute.substring_dedup([(r[0], r[1]) for r in repeated.select("doc_id", "text").collect()])
    assert sorted(twice, key=key) == sorted(want, key=key)
    assert substring_dedup(empty).count() == 0


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard(spark, docs, words, num):
    family = sentence(120).split()
    more = []
    for i in range(40):
        copy = list(family)
        for _ in range(i % 5):
            copy[rng.randrange(120)] = f"e{rng.randrange(10_000)}"
        more.append((100 + i, " ".join(copy)))
    data = [(i, t) for i, t in enumerate(texts())] + more
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.jaccard_components(df, words=words, num=num).collect()))
    assert got == brute.jaccard_components(data, words, num)


def test_jaccard_odd(repeated, empty):
    got = jaccard_join.jaccard_components(repeated, words=3, num=90).collect()
    assert len(got) == 63 and {r.component_id for r in got if r.doc_id is None and r.n_shingles} <= set(range(21))
    assert jaccard_join.jaccard_components(empty).count() == 0
    kept = jaccard_join.one_of_each(repeated, words=3, num=90)
    assert kept.where("doc_id is not null").count() == len({c for _, _, c in brute.jaccard_components(list(enumerate(texts())))})


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.c: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 140))


def test_top_k(spark):
    r = np.random.default_rng(1)
    vectors = [r.normal(0, 0.3, 16).tolist() for _ in range(300)] + [[0.5] * 16] * 60
    data = list(enumerate(vectors)) + [(500, None), (501, [None] * 16), (502, [float("nan")] * 16), (503, []), (None, [0.1] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<float>, score int")
    whole = {i: np.floor(64 * np.array(v, np.float32).astype(np.float64)) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all()}
    got = {}
    for x in top_k(df, df.where("vec_id % 20 = 0"), 7).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    for q in (i for i in whole if i % 20 == 0):
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:7]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert top_k(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert top_k(few, few.where("vec_id = 0")).count() == 2


def test_packing(docs, repeated, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = ChunkEncoder(path)
    whole = [np.array([*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts()]
    got = pack_documents(docs, path, size=256).collect()
    pieces, sequences = {}, {}
    for r in got:
        assert zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(whole[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, w in enumerate(whole):
        ends = np.cumsum([0, *(n for _, n in sorted(pieces[i]))])
        assert [s for s, _ in sorted(pieces[i])] == ends[:-1].tolist() and ends[-1] == len(w)
    for s in sequences.values():
        ends = np.cumsum([0, *(n for _, n in sorted(s))])
        assert [o for o, _ in sorted(s)] == ends[:-1].tolist() and ends[-1] <= 256
    assert pack_documents(repeated, path).count() >= 63 and pack_documents(empty, path).count() == 0


def test_pack():
    h = {n: rng.randrange(1, 50) for n in range(1, 2048)} | {2048: 3}
    patterns = pack(h)
    placed = {}
    for n, content in patterns:
        assert sum(content) <= 2048
        for length in content:
            placed[length] = placed.get(length, 0) + n
    assert placed == h and len(patterns) <= 4096
    assert sum(n for n, _ in patterns) * 2048 < 1.02 * sum(k * v for k, v in h.items())


def test_pieces(docs, repeated, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode(docs, path)
    got = {r.doc_id: r for r in coded.collect()}
    back = {r.doc_id: r.text for r in decode(coded, path).collect()}
    assert back == dict(enumerate(texts()))
    again = {r.doc_id: r.ids for r in encode(docs.repartition(1), path).collect()}
    assert all(again[i] == got[i].ids for i in again)
    english = docs.where("doc_id = 3").selectExpr("doc_id", "repeat('The international organisation understands everything. ', 300) AS text")
    assert encode(english, path, seed=1).first().ids != encode(english, path, seed=2).first().ids
    assert encode(repeated, path).count() == 63 and decode(encode(empty, path), path).count() == 0


def test_sampling_follows_the_lattice():
    from tessera.llm.pieces import sample, vocabulary

    v = vocabulary(public_tokenizers.path("piece_bpe_32k.model"), 0.3)
    data = np.frombuffer(b" the" * 4000, np.uint8)
    ids, bounds = sample(data, np.arange(0, len(data) + 1, 4), np.arange(4000).astype(np.uint64), v, 0)
    ways = {}
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        way = tuple(v.raw[i] for i in ids[a:b])
        ways[way] = ways.get(way, 0) + 1
    weight = {v.raw[i]: w for i, w in zip(v.ids.tolist(), v.weights.tolist(), strict=True)}

    def splits(s):
        return [[s]] * (s in weight) + [[s[:i], *r] for i in range(1, len(s)) if s[:i] in weight for r in splits(s[i:])]

    mass = {tuple(s): np.exp(sum(weight[x] for x in s)) for s in splits(b" the")}
    total = sum(mass.values())
    for way, m in mass.items():
        assert abs(ways.get(way, 0) / 4000 - m / total) < 0.03


def test_toxicity(spark, docs, labels, repeated, empty):
    good, bad = [sentence(40) for _ in range(300)], [sentence(20) + " awful nasty " + sentence(15) for _ in range(300)]
    data = [(i, t, "en", int(i >= 300)) for i, t in enumerate(good + bad)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df.drop("toxic"), df.select("doc_id", "toxic")).collect()}
    held = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.predicted == (r.doc_id >= 300) for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert toxicity.score_toxicity(docs, labels).count() == 21 and toxicity.score_toxicity(repeated, labels).count() == 63
    assert toxicity.score_toxicity(empty, labels).count() == 0 and toxicity.score_toxicity(docs, labels.limit(0)).count() == 21


def kneser_ney(train, order=4):
    """A plain version of the model: the probability of a byte after its context."""
    from collections import Counter, defaultdict

    tables = []
    top = Counter()
    for t in train:
        b = b"\n" * (order - 1) + t.encode()
        top.update(b[i : i + order] for i in range(len(b) - order + 1))
    for _ in range(order):
        tables.append(top)
        top = Counter(k[1:] for k in top)

    levels = []
    for t in tables:
        n = Counter(v for v in t.values() if v <= 4)
        if min(n[1], n[2], n[3]) == 0:
            d = [0.5, 0.75, 0.9]
        else:
            y = n[1] / (n[1] + 2 * n[2])
            d = [min(max(x, 0.05), k - 0.05) for k, x in ((1, 1 - 2 * y * n[2] / n[1]), (2, 2 - 3 * y * n[3] / n[2]), (3, 3 - 4 * y * n[4] / n[3]))]
        sums, kept = defaultdict(float), defaultdict(float)
        for k, v in t.items():
            sums[k[:-1]] += v
            kept[k[:-1]] += d[min(v, 3) - 1]
        levels.append((t, d, sums, kept))

    def p(gram, level=0):
        if level == order:
            return 1 / 256
        t, d, sums, kept = levels[level]
        lower = p(gram[1:], level + 1)
        if gram[:-1] not in sums:
            return lower
        v = t.get(gram, 0)
        return (v - d[min(v, 3) - 1] if v else 0) / sums[gram[:-1]] + kept[gram[:-1]] / sums[gram[:-1]] * lower

    return p


def test_perplexity(docs, labels, repeated, empty):
    got = {r.doc_id: r for r in perplexity.quality(docs, labels).collect()}
    p = kneser_ney([t for i, t in enumerate(texts()) if i % 2 and t])
    for i, t in enumerate(texts()):
        if not t:
            assert got[i].perplexity is None and not got[i].kept
        elif len(t) < 5000:
            b = b"\n\n\n" + t.encode()
            logs = [np.log(p(b[k : k + 4])) for k in range(len(b) - 3)]
            assert got[i].perplexity == pytest.approx(np.exp(-np.mean(logs)), rel=1e-4)
    assert perplexity.quality(repeated, labels).count() == 63 and perplexity.quality(empty, labels).count() == 0
    none = perplexity.quality(docs, labels.limit(0)).collect()
    assert sum(r.kept for r in none) == 19 and all(r.perplexity is None for r in none)
    assert perplexity.kept_by_quality(docs, labels).columns == docs.columns


def test_sha():
    assert brute.sha("a") == hashlib.sha256(b"a").hexdigest()
