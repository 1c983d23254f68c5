"""Packing gives the ids of the tokenizer's file, also for texts that name a special token."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
rng = random.Random(3)
PARTS = ["<|endoftext|>", "<|endoftext", "|>", " ", "\n", "  ", " ", "word", " the", "é", "x<|", "日本", "\t\n", "1 2"]


@pytest.mark.parametrize("special_as_text", [False, True])
def test_ids_of_the_file(spark, special_as_text):
    fresh = Tokenizer.from_file(PATH)
    if special_as_text:
        fresh.encode_special_tokens = True
    data = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randrange(12)))) for i in range(600)] + [(600, "a <|endoftext|> b<|endoftext|><|endoftext|>\n\n c"), (601, None)]
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in pack_documents(spark.createDataFrame(data, "doc_id long, text string"), PATH, special_as_text=special_as_text).collect()}
    for i, t in data:
        ids = np.array([*fresh.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes())), t
    assert (50256 in fresh.encode("<|endoftext|>", add_special_tokens=False).ids) != special_as_text
