"""BPE encoding and decoding with a contiguous rank array per word (operator 6).

A word's parts are held as an array of boundaries and an array of the ranks of adjacent pairs. The
smallest rank is found by scanning, its boundary is deleted and the two neighbouring ranks are
refreshed. Words longer than ``SCAN_LIMIT`` bytes keep the same boundaries as a linked list and
take the minimum from a heap, because repeated scans would be quadratic.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_slices, release

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Unicode's White_Space characters.
SPACES = r"\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SCAN_LIMIT = 64
CACHE_WORDS = 20_000
CACHED_BYTES = 64
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NO_PAIR = 1 << 62


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by rule."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def char_class(kind: str, below: int) -> str:
    """Ranges of a regular-expression class for the characters of a Unicode category (L or N)."""
    inside = [c for c in range(below) if unicodedata.category(chr(c))[0] == kind]
    starts = [c for a, c in zip([-2, *inside], inside) if c != a + 1]
    ends = [c for c, b in zip(inside, [*inside[1:], -2]) if b != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


@functools.cache
def word_pattern(below: int) -> re.Pattern:
    """The published pre-tokenisation pattern of byte-level BPE: contractions, letters, digits, rest, spaces.

    It is right for texts whose code points are all under ``below``; small classes match much faster.
    """
    letter, digit = char_class("L", below), char_class("N", below)
    return re.compile(
        rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{digit}]+| ?[^{SPACES}{letter}{digit}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
    )


def pattern_for(text: str) -> re.Pattern:
    if text.isascii():
        return word_pattern(128)
    wide = max(text)
    return word_pattern(256 if wide < "\u0100" else 65536 if wide < "\U00010000" else sys.maxunicode + 1)


class Codec:
    """Encoder and decoder for one vocabulary file; each Python worker makes its own once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocabulary = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.single = [vocabulary.get(bytes([b])) for b in range(256)]
        #: Key: both ids in one integer; value: rank and merged id in one, so values compare by rank.
        self.pairs: dict[int, int] = {}
        for rank, (left, right) in enumerate(merges):
            a, b = raw(left), raw(right)
            self.pairs.setdefault(vocabulary[a] << ID_BITS | vocabulary[b], rank << ID_BITS | vocabulary[a + b])
        self.bytes_of = {i: token for token, i in vocabulary.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: token.encode() for token, i in self.added.items()}
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.cache: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a word that is not in the young cache; the two caches together forget unused words."""
        found = self.old.get(word)
        if found is None:
            raw = word.encode("utf-8", "replace")
            found = tuple(self._scan(raw) if len(raw) <= SCAN_LIMIT else self._heap(raw))
            if len(raw) > CACHED_BYTES:
                return found
        if len(self.cache) >= CACHE_WORDS:
            self.old = dict(self.cache)
            self.cache.clear()
        self.cache[word] = found
        return found

    def _scan(self, raw: bytes) -> list[int]:
        ids = [self.single[b] for b in raw]
        get = self.pairs.get
        ranks = [get(a << ID_BITS | b, NO_PAIR) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_PAIR:
                break
            i = ranks.index(best)
            new = ids[i] = best & ID_MASK
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << ID_BITS | new, NO_PAIR)
            if i < len(ranks):
                ranks[i] = get(new << ID_BITS | ids[i + 1], NO_PAIR)
        return ids

    def _heap(self, raw: bytes) -> list[int]:
        ids = [self.single[b] for b in raw]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        get, end = self.pairs.get, len(ids)
        keys = (a << ID_BITS | b for a, b in zip(ids, ids[1:]))
        heap = [(found, i, key) for i, key in enumerate(keys) if (found := get(key)) is not None]
        heapq.heapify(heap)
        while heap:
            found, i, key = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= end or ids[i] << ID_BITS | ids[j] != key:
                continue
            ids[i], ids[j] = found & ID_MASK, -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < end and (found := get(key := ids[x] << ID_BITS | ids[after[x]])) is not None:
                    heapq.heappush(heap, (found, x, key))
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; strings of added tokens become those tokens; null is empty."""
        ids: list[int] = []
        at, text = 0, text or ""
        for match in self.added_pattern.finditer(text) if self.added_pattern else ():
            self._plain(text[at : match.start()], ids)
            ids.append(self.added[match[0]])
            at = match.end()
        self._plain(text[at:] if at else text, ids)
        return ids

    def _plain(self, text: str, ids: list[int]) -> None:
        get, word = self.cache.get, self.word
        for piece in pattern_for(text).findall(text):
            ids += get(piece) or word(piece)

    def forget(self) -> None:
        """Drop the cached words."""
        self.cache, self.old = {}, {}

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, special tokens kept; bytes that are no UTF-8 become U+FFFD."""
        get = self.bytes_of.__getitem__
        return b"".join(map(get, ids)).decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> Codec:
    gc.set_threshold(200_000, 50, 1000)  # the word cache is large and holds no cycles
    own = Codec(path)
    release()  # what the file was parsed into
    return own


def bpe(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again: ``id_col``, ``ids``, ``decoded``, and the text if kept.

    One row per input row, repeated rows included; null or empty texts give no ids and an empty
    text; other columns are not carried. ``path`` is the vocabulary file on the executors, which
    every worker opens once. No shuffle.
    """
    path = path or public_tokenizers.path(DEFAULT_VOCABULARY)
    carry = ["_id", "_text"] if keep_text else ["_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in batches:
            ids = [own.encode(t) for t in batch["_text"]]
            decoded = [own.decode(x) for x in ids]
            yield batch[carry].assign(ids=[np.array(x, np.int32) for x in ids], decoded=decoded)
        own.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    fields = f"_id {kind}, _text string" if keep_text else f"_id {kind}"
    out = map_slices(rows, run, f"{fields}, ids array<int>, decoded string")
    return out.withColumnsRenamed({"_id": id_col, "_text": text_col})


def bpe_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and digests of what ``bpe`` gives, computed where the ids are made.

    Same rows and null rules as ``bpe``: ``n_tokens``, ``ids_sha256`` over little-endian unsigned
    32-bit ids, ``decoded_sha256`` over the decoded text in UTF-8.
    """
    path = path or public_tokenizers.path(DEFAULT_VOCABULARY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in batches:
            rows = []
            for text in batch["_text"]:
                ids = own.encode(text)
                packed = np.array(ids, dtype="<u4").tobytes()
                decoded = own.decode(ids).encode("utf-8")
                rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "_id", batch["_id"].to_numpy())
            yield out
        own.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = map_slices(rows, run, f"_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("_id", id_col)
