"""BPE by forced boundaries against the tokenizers library on whole texts."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.bpe import Encoder, decode, encode, joined_pairs, portions
from tessera.llm.q_bpe import op13_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
rng = random.Random(3)
LETTERS = "abcdefghijklmnopqrstuvwxyzABCXYZ" + "éüßñÀİΣσς" + "日本語한글กข" + "0123456789²½" + "'’`-_.,!?<>|/\\" + "́̈​\xa0　\x1c\x1f\x85" + "😀👍🏽" + "ﬁÅ가"
ODD = [
    None, "", " ", "\n\t", "it's WE'RE you'LL 'S 'd", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endof text|>", "x </w> y</w>z",
    "é e ́", "word\xa0word　word", "a\x1cb", "AÀ" * 50, "zq" * 300, "日本語" * 500, "a" * 5000, "!" * 999, "�   x",
]


def texts():
    out = list(ODD)
    for _ in range(400):
        out.append("".join(rng.choice(LETTERS) + (" " if rng.random() < 0.15 else "") for _ in range(rng.randrange(120))))
    words = ["The", "quick", "fox's", "naïve", "Internationalization", "xqzjkv", "12345", "foo_bar", "e-mail@x.org", "…", "日本"]
    out.append(" ".join(rng.choice(words) for _ in range(400_000)))  # megabytes, worked off in portions
    return out


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_against_the_library(spark, plain):
    own = texts()
    rows = [(i if i % 7 else None, t, "i", 1) for i, t in enumerate(own)] + [(1, own[1], "i", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    want = []
    for i, t, *_ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), ids, plain.decode(ids, skip_special_tokens=False)))
    got = [(str(r.doc_id), list(r.ids), r.text) for r in decode(encode(df, PATH), PATH).collect()]
    assert sorted(got) == sorted(want)


def test_query(spark, plain, tmp_path):
    own = texts()[:60]
    spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in enumerate(own):
        ids = plain.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), sha(" ".join(map(str, ids))), sha(plain.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in op13_bpe(spark, str(tmp_path)).collect()} == want


def test_cuts_and_small_cache(plain):
    assert joined_pairs({"ab": 0, "abc</w>": 1, "d</w>": 2}, "</w>") == {"ab", "bc"}
    small = Encoder(PATH, most=100)
    assert any(len(small.fragments(w)) > 1 for w in ("xqzjkv", "zqzqzq"))
    for t in texts()[4:200]:
        assert small.encode(small.words(t or ""))[0].tolist() == plain.encode(t or "", add_special_tokens=False).ids
    assert "".join(portions("ab cd ef" * 9, 5)) == "ab cd ef" * 9


def test_every_character_of_the_latin_rule(plain):
    own = Encoder(PATH)
    for i in range(0x180):
        for t in (chr(i), f"a{chr(i)}b", f"'{chr(i)}s", f"1{chr(i)}{chr(i)}!"):
            assert own.encode(own.words(t))[0].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_ids_that_are_none(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, 320, 10**6, -1, 320]), (None, [49407])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decode(df, PATH).collect()} == {1: "", 2: "", 3: "a</w> a</w>", None: "<|endoftext|>"}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert decode(encode(df, PATH), PATH).collect() == []
