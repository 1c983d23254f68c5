"""BPE encoding and decoding by forced boundaries.

A byte pair that stands inside no token of the vocabulary is a certain cut: no merge ever joins its
two bytes, so what lies on either side is encoded alone, whatever surrounds it. The cuts of a text are

1. the strings of special tokens, and white space, which no token holds;
2. the borders of words by the tokenizer file's own rule;
3. within a word, each byte pair that no token holds.

A worker encodes each fragment by the file's merges when it meets its word first, and keeps the word's ids
for a while; a word's last fragment takes the end-of-word mark, the others don't. A text's ids are those of its
fragments, one after the other, which are the ids that the tokenizers library gives for the whole text. Decoding
joins the tokens by one space, as the library does for a file without a decoder.

Null text is empty text, which has no ids. Null ids decode to the empty text, null or unknown ids within
a list are left out. Rows are independent, so repeated rows and ids, ties and null ids of rows come back as they are, and an
empty table gives an empty result. Only the named columns are read. A long text is worked off in
pieces of a megabyte, cut at white space; what has no white space is held whole, however long.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import release
from tessera.llm.text import SEGMENT_BYTES, segments, utf8

_SPACE = re.compile(r"[ \t\n\r\x0b\f]")

#: The normaliser and the word rule of the files whose words ``LATIN`` finds in lower-cased text without characters from U+0180 on.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_L, _N, _S = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", " \\t\\n\\r\\x0b\\f\u0085\u00a0"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_L}{_N}{_S}]+")
_OTHER = re.compile("[^\\x00-\u017f]")


def byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies: printable bytes are themselves, the others follow U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of words. Holds those of the words that it has met, up to ``most`` letters."""

    def __init__(self, path: str, most: int = 3 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, added, before = file["model"], file["added_tokens"], file["pre_tokenizer"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take more than their own string are not supported")
        steps = before.get("pretokenizers", [before])
        if steps[-1]["type"] != "ByteLevel" or steps[-1]["add_prefix_space"]:
            raise ValueError("only byte-level vocabularies without a first space are supported")
        self.latin = file["normalizer"] == NORMALISER and steps[:-1] == [WORDS] and not steps[-1]["use_regex"]
        self.special = {t["content"]: t["id"] for t in added}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.joined = joined_pairs(model["vocab"], model.get("end_of_word_suffix") or "")
        bare = dict.fromkeys(file) | {"version": file["version"], "added_tokens": []}
        self.last = Tokenizer.from_str(json.dumps(bare | {"model": model}))
        self.inner = Tokenizer.from_str(json.dumps(bare | {"model": model | {"end_of_word_suffix": None}}))
        del file, model, bare
        whole = Tokenizer.from_file(path)
        self.normalise = whole.normalizer.normalize_str if whole.normalizer else lambda s: s
        self.rule = whole.pre_tokenizer.pre_tokenize_str
        self.letters = byte_letters()
        self.most = most
        self.clear()
        release()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.count, self.ids = array("q"), array("q"), array("i")
        self.held = 0
        for text, i in self.special.items():  # no word holds white space, so these keys are no words
            self._add(" " + text, [i])

    def _add(self, word: str, ids: list[int]) -> None:
        self.index[word] = len(self.start)
        self.start.append(len(self.ids))
        self.count.append(len(ids))
        self.ids.extend(ids)
        self.held += len(word)

    def words(self, text: str) -> list[str]:
        """The words of a text, normalised; a special token is a space and its string."""
        if self.at_special and self.at_special.search(text):
            return [w for x in self.at_special.split(text) for w in ([" " + x] if x in self.special else self.words(x))]
        if self.latin and not _OTHER.search(text):
            return LATIN.findall(text.lower())
        text = self.normalise(text)
        return [text[a:b] for _, (a, b) in self.rule(text)]

    def fragments(self, word: str) -> list[str]:
        """The parts of a word, as letters of bytes, between its forced boundaries."""
        if not (word.isascii() and word.isprintable()):
            word = word.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        cuts = [i for i, pair in enumerate(map(add, word, word[1:]), 1) if pair not in self.joined]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def learn(self, words: set[str]) -> None:
        split = [(w, self.fragments(w)) for w in words]
        ids = []
        for tokenizer, of in ((self.last, {x[-1] for _, x in split}), (self.inner, {f for _, x in split for f in x[:-1]})):
            of = list(of)
            ids.append(dict(zip(of, (x.ids for x in tokenizer.encode_batch_fast(of, add_special_tokens=False)), strict=True)))
        last, inner = ids
        for word, own in split:
            self._add(word, [i for f in own[:-1] for i in inner[f]] + last[own[-1]])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and the number of each."""
        if self.held > self.most:
            self.clear()
        self.learn({w for w in words if w not in self.index})
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        counts = np.frombuffer(self.count, np.int64)[at] if len(at) else at
        if not len(at):
            return np.zeros(0, np.int32), counts
        first = np.repeat(np.frombuffer(self.start, np.int64)[at] - (np.cumsum(counts) - counts), counts)
        return np.frombuffer(self.ids, np.int32)[first + np.arange(len(first))], counts


def joined_pairs(vocabulary: dict[str, int], suffix: str) -> set[str]:
    """All pairs of neighbouring symbols inside tokens, which stand for a byte each; a token's end mark is none."""
    out = set()
    for token in vocabulary:
        own = token.removesuffix(suffix) if suffix else token
        out.update(own[i : i + 2] for i in range(len(own) - 1))
    return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(2)
def tokens(path: str) -> dict[int, str]:
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    if file["decoder"] is not None:
        raise ValueError("a file with a decoder of its own is not supported")
    return {i: t for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}


def portions(text: str, most: int = SEGMENT_BYTES) -> Iterator[str]:
    """A text in pieces of ``most`` characters or a little more, each but the last up to white space."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + most)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _text(ids: np.ndarray, known: dict[int, str], step: int = 1 << 17) -> str:
    return " ".join(x for a in range(0, len(ids), step) if (x := " ".join(filter(None, map(known.get, ids[a : a + step].tolist())))))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for a, b in segments(offsets):
            raw = data[offsets[a] : offsets[b]].tobytes()
            if len(raw) > SEGMENT_BYTES:
                ids = [own.encode(own.words(p))[0] for p in portions(raw.decode("utf-8", "replace"))]
                values, ends = np.concatenate(ids), np.array([0, sum(map(len, ids))])
            else:
                rows = [own.words(raw[s:e].decode("utf-8", "replace")) for s, e in zip(offsets[a:b] - offsets[a], offsets[a + 1 : b + 1] - offsets[a])]
                values, counts = own.encode([w for row in rows for w in row])
                ends = np.append(0, np.cumsum(counts))[np.append(0, np.cumsum([len(row) for row in rows]))]
            out = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))]
            if len(names) > 2:
                out.append(pa.array([_text(values[s:e], tokens(path)) for s, e in zip(ends, ends[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """The id of each row, and the token ids of its whole text by the tokenizer file at ``path``.

    With ``decoded_col``, also the text that these ids decode to, made by the same workers.
    """
    rows = df.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = rows.schema[0].dataType.simpleString()
    names = [id_col, ids_col] + ([decoded_col] if decoded_col else [])
    schema = f"`{id_col}` {kind}, `{ids_col}` array<int>" + (f", `{decoded_col}` string" if decoded_col else "")
    return rows.mapInArrow(lambda batches: _encoded(batches, path, names), schema)


def _decoded(batches: Iterator[pa.RecordBatch], path: str, names: list[str], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    known = tokens(path)
    for batch in batches:
        lists = batch.column(1)
        offsets = np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, lists.offset * 4) if len(lists) else np.zeros(1, np.int32)
        values = lists.values.fill_null(-1).to_numpy(zero_copy_only=False)
        held = np.array(lists.is_valid())
        for a, b in segments(offsets, most):
            own = [_text(values[offsets[i] : offsets[i + 1]], known) if held[i] else "" for i in range(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists.slice(a, b - a), pa.array(own, pa.string())], names)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The id of each row, its token ids, and the text that they decode to."""
    rows = df.select(F.col(id_col), F.col(ids_col).cast("array<int>"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _decoded(batches, path, [id_col, ids_col, text_col]), f"`{id_col}` {kind}, `{ids_col}` array<int>, `{text_col}` string")
