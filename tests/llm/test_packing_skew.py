"""Packing where one length is far more common than all others."""

import public_tokenizers
import pytest

from tessera.llm.packing import pack, pack_documents


@pytest.mark.parametrize("h", [{100: 1000}, {100: 1001, 7: 3}, {1500: 40, 100: 100_000, 30: 5}, {1: 5000}, {2048: 2, 2047: 1, 1024: 9, 1025: 2}])
def test_a_hot_length_shares_packs(h):
    placed = {}
    for n, content in pack(h):
        assert n > 0 and sum(content) <= 2048 and list(content) == sorted(content, reverse=True)
        for length in content:
            placed[length] = placed.get(length, 0) + n
    assert placed == h


def test_little_padding_with_a_hot_length():
    assert sum(n for n, _ in pack({100: 1000})) == 50
    h = {n: 3 for n in range(1, 2049)} | {100: 300_000}
    assert sum(n for n, _ in pack(h)) * 2048 < 1.03 * sum(k * v for k, v in h.items())


def test_copies_of_one_text_fill_sequences(spark):
    data = [(i, "one short text") for i in range(500)] + [(1000 + i, "word " * (20 + i)) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = pack_documents(df, public_tokenizers.path("byte_bpe_50k.json"), size=256).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {r.doc_id for r in got} == {i for i, _ in data}
    for s in sequences.values():
        ends = 0
        for offset, length in sorted(s):
            assert offset == ends
            ends += length
        assert ends <= 256
    assert sorted(sequences) == list(range(len(sequences)))
    assert len(sequences) * 256 < 1.1 * sum(r.length for r in got)
