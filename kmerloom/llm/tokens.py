"""Problem 7: a byte-pair encoding of whole texts by backtracking over longest matches.

An Aho-Corasick automaton over the vocabulary gives, for every place of a word,
the longest token that begins there. The encoder takes the longest token that the
merges would leave standing beside the token before it; where none does it shortens
the token, and where nothing is left it steps back. Every place is given up once at
most, so the work is linear in the length of the word.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern that cuts a text into words before the merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words, and pairs of tokens, that a Python worker remembers.
REMEMBERED = 1 << 17


def _byte_of_sign() -> dict[str, int]:
    """The signs that stand for bytes in the vocabulary file: printable bytes for themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 0xAD]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairEncoder:
    """Exact merges of one vocabulary; no special tokens."""

    def __init__(self, path: str = VOCABULARY):
        model = json.loads(open(path, encoding="utf-8").read())["model"]
        sign, ids = _byte_of_sign(), model["vocab"]
        raw = {i: bytes(sign[c] for c in t) for t, i in ids.items() if all(c in sign for c in t)}
        self.joined = {}  # (left, right) -> the token of their merge
        self.parts = {i: None for i in raw}  # token -> (left, right)
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, whole = (ids[left], ids[right]), ids[left + right]
            self.joined[pair] = whole
            if self.parts[whole] is None:
                self.parts[whole] = pair
        self.length = {i: len(b) for i, b in raw.items()}
        by_text = {b: i for i, b in raw.items()}
        #: token -> the longest token that is a true prefix of it
        self.shorter = {i: next((by_text[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in by_text), None) for i, b in raw.items()}
        self.automaton = ahocorasick.Automaton()
        for i, b in raw.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        # decoding: all tokens' bytes in one array, and where each begins
        size = max(raw) + 1
        lengths = np.zeros(size, np.int64)
        for i, b in raw.items():
            lengths[i] = len(b)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = np.frombuffer(b"".join(raw.get(i, b"") for i in range(size)), np.uint8)
        self.words = regex.compile(WORDS)
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}

    def stands(self, left: int, right: int) -> bool:
        """Whether the merges leave `left` and `right` side by side as two tokens."""
        pair = (left, right)
        if (known := self.compatible.get(pair)) is None:
            if len(self.compatible) >= REMEMBERED:
                self.compatible.clear()
            known = self.compatible[pair] = self._stands(left, right)
        return known

    def _stands(self, a: int, b: int) -> bool:
        # Undo the merges of both tokens, the latest first. At every stage the two
        # neighbours must not have had a merge that comes before the one just undone.
        undone = 1 << 62
        while True:
            if self.joined.get((a, b), undone) < undone:
                return False
            pa_, pb = self.parts[a], self.parts[b]
            if pa_ is None and pb is None:
                return True
            if pb is None or (pa_ is not None and a > b):
                undone, a = a, pa_[1]
            else:  # the left one wins a tie, so an equal merge across the border comes after it
                undone, b = b + 1, pb[0]

    def encode_word(self, word: str) -> list[int]:
        text = word.encode("utf-8").decode("latin-1")
        n, length = len(text), self.length
        longest: list[int | None] = [None] * n
        for last, token in self.automaton.iter(text):
            begin = last + 1 - length[token]
            if (have := longest[begin]) is None or length[have] < length[token]:
                longest[begin] = token
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else None
        while at < n:
            end = at + length[token] if token is not None else -1
            if token is None:  # nothing can begin here: give the place up and step back
                open_at[at] = 0
                before = out.pop()
                at -= length[before]
                token = self.shorter[before]
            elif open_at[end] and (not out or self.stands(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else None
            else:
                token = self.shorter[token]
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; an empty list for null and empty texts."""
        out: list[int] = []
        known = self.known
        for word in self.words.findall(text or ""):
            ids = known.get(word)
            if ids is None:
                ids = self.encode_word(word)
                if len(word) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        at = np.asarray(ids, np.int64)
        size = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - size), size)
        return self.bytes[place].tobytes().decode("utf-8")


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> PairEncoder:
    """One encoder for each Python worker."""
    return PairEncoder(path)


def encoded(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every row's text; [] for null and empty texts.

    Strings that look like special tokens are plain text. Rows stay in their
    partitions; every text is encoded whole.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                lists = [own.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                flat = np.fromiter((i for x in lists for i in x), np.int32, offsets[-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, f"key {kind}, ids array<int>")


def decoded(df: DataFrame, key: str, ids: str, path: str = VOCABULARY) -> DataFrame:
    """(key, text): the texts that the ids of encoded() came from; '' for an empty or null list."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(work, f"key {kind}, text string")
