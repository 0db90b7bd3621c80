"""SentencePiece encoding and decoding with a table of distinct marked words (operator 13).

Spaces become the marker U+2581 and a text gets one in front. No piece of the vocabulary holds a marker
behind another character (checked when it is opened), so merges never cross from a character to a
marker and a text falls into marked words that are segmented on their own. Each slice of texts makes a table
of its distinct marked words, segments each of them once, and joins ids and decoded text back by the
words' positions.
"""

from __future__ import annotations

import functools
import gc
import heapq
import re
import sys
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches
from weftline.llm.merges import SHORT, PairTable, in_word_order

DEFAULT_MODEL = "piece_bpe_32k.model"
MARK = "\u2581"
#: Longer words take the best pair from a heap instead of a scan.
SCAN_LIMIT = 48
NO_PAIR = 1 << 62


class Pieces:
    """The vocabulary of a BPE model with byte fallback; each Python worker opens it once.

    Raises ValueError for a model whose pieces cross markers, or that has no bytes to fall back on.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = [i for i in range(size) if model.is_byte(i)]
        self.byte_of = {i: int(self.names[i][3:5], 16) for i in self.byte_ids}
        self.ids = {name: i for i, name in enumerate(self.names) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        order = {score: rank for rank, score in enumerate(sorted({model.get_score(i) for i in self.ids.values()}, reverse=True))}
        #: The order of merges, equal for equal scores.
        self.ranks = {name: order[model.get_score(i)] for name, i in self.ids.items()}
        if len(self.byte_ids) != 256 or any(MARK in name.lstrip(MARK) for name in self.ids) or any(model.is_unused(i) for i in self.ids.values()):
            raise ValueError(f"{path}: pieces that cross markers, unused pieces or missing bytes")
        # A character in no longer piece never merges: it ends a word. The line break is such a one in the known models.
        alone = "" if any("\n" in name and len(name) > 1 for name in self.ids) else r"\n"
        self.word_pattern = re.compile(rf"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|{alone}" if alone else ""))
        splits = [(self.ids[name[:k]], self.ids[name[k:]], self.ranks[name], i) for name, i in self.ids.items() for k in range(1, len(name)) if name[:k] in self.ids and name[k:] in self.ids]
        self.pairs = PairTable(*np.array(splits, np.int64).T)
        #: Id of each code point that is a piece; -1: it is none, or it merges though it is none.
        self.of_char = np.full(sys.maxunicode + 1, -1, np.int32)
        for name, i in self.ids.items():
            if len(name) == 1:
                self.of_char[ord(name)] = i

    def words(self, text: str) -> list[str]:
        """Marked words whose concatenation is the marked text; none for an empty text."""
        return self.word_pattern.findall(MARK + text.replace(" ", MARK)) if text else []

    def word(self, word: str) -> list[int]:
        """Ids of one marked word."""
        parts = self._scan(list(word)) if len(word) <= SCAN_LIMIT else self._heap(list(word))
        return [i for part in parts for i in self._ids(part)]

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, and how many each has.

        Short words of known characters are merged together; the others, and runs of markers (whose pieces
        have equal scores), one by one.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)]
        starts = np.cumsum(sizes) - sizes
        plain = sizes <= SHORT
        if len(words):
            plain &= np.minimum.reduceat(symbols, starts) >= 0
            plain &= (sizes < 2) | (symbols[np.minimum(starts + 1, len(symbols) - 1)] != self.ids.get(MARK, -2))
        ids, merged = self.pairs.segment(symbols[np.repeat(plain, sizes)], sizes[plain])
        rest = np.flatnonzero(~plain)
        single = [self.word(words[k]) for k in rest.tolist()]
        flat = np.array([i for each in single for i in each], np.int32)
        return in_word_order([(np.flatnonzero(plain), ids, merged), (rest, flat, np.array([len(x) for x in single], np.int64))], len(words))

    def _ids(self, part: str) -> tuple[int, ...] | list[int]:
        known = self.ids.get(part)
        return (known,) if known is not None else [self.byte_ids[b] for b in part.encode("utf-8", "replace")]

    def _scan(self, parts: list[str]) -> list[str]:
        get = self.ranks.get
        ranks = [get(a + b, NO_PAIR) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_PAIR:
                break
            i = ranks.index(best)
            parts[i] += parts[i + 1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], NO_PAIR)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], NO_PAIR)
        return parts

    def _heap(self, parts: list[str]) -> list[str]:
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        get, end = self.ranks.get, len(parts)
        heap = [(rank, i, pair) for i, pair in enumerate(map(str.__add__, parts, parts[1:])) if (rank := get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= end or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j] = pair, ""
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < end and (rank := get(both := parts[x] + parts[after[x]])) is not None:
                    heapq.heappush(heap, (rank, x, both))
        return [p for p in parts if p]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null is empty."""
        return [i for word in self.words(text or "") for i in self.word(word)]

    def raw(self, ids) -> bytes:
        """Bytes that the ids stand for, markers as spaces, with the one in front."""
        name, byte = self.names.__getitem__, self.byte_of.get
        return b"".join(name(i).replace(MARK, " ").encode() if (b := byte(i)) is None else bytes((b,)) for i in ids)

    def decode(self, ids: list[int]) -> str:
        """Text of the ids without the marker in front; bytes that are no UTF-8 become U+FFFD."""
        return self.raw(ids).decode("utf-8", "replace").removeprefix(" ")


@functools.cache
def pieces(path: str) -> Pieces:
    gc.set_threshold(200_000, 50, 1000)  # the tables are large and hold no cycles
    return Pieces(path)


def word_table(own: Pieces, texts: list[str | None]) -> tuple[np.ndarray, pa.ListArray, list[str], np.ndarray]:
    """Marked words of a slice of texts: how many each text has, the ids and names of the distinct ones, and which stands where."""
    found = [own.words(t or "") for t in texts]
    coded = pa.array([w for words in found for w in words], pa.large_string()).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    flat, sizes = own.table(distinct)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return np.array([len(w) for w in found], np.int64), pa.LargeListArray.from_arrays(ends, flat), distinct, coded.indices.to_numpy(zero_copy_only=False)


def joined(counts: np.ndarray, values: pa.Array, at: np.ndarray) -> pa.LargeListArray:
    """A list for each text: the values at its words' positions, lists flattened."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    taken = values.take(pa.array(at))
    if pa.types.is_large_list(values.type):
        sizes = np.concatenate([[0], np.cumsum(pc.list_value_length(taken).to_numpy(zero_copy_only=False))])
        return pa.LargeListArray.from_arrays(sizes[ends], taken.flatten())
    return pa.LargeListArray.from_arrays(ends, taken)


def spelled(starts: np.ndarray, parts: pa.Array) -> pa.Array:
    """Parts put together, those from one start to the next."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), parts), pa.scalar("", parts.type))


def sentence_pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again: ``id_col``, ``ids``, ``decoded``.

    One row per input row, repeated rows included; null or empty texts give no ids and an empty text; other
    columns are not carried. A marker that stands in a text is read as a space, as the model has it.
    ``path`` is the model file on the executors, which every worker opens once. No shuffle: a word is
    segmented once for each slice that has it, since the words of all slices would be a shuffle larger than the texts.
    """
    path = path or public_tokenizers.path(DEFAULT_MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            counts, ids, distinct, at = word_table(own, batch.column(1).to_pylist())
            spans = ids.offsets.to_numpy().tolist()
            flat = ids.values.to_numpy().tolist()
            said = pa.array([own.raw(flat[a:b]).decode("utf-8", "replace") for a, b in zip(spans, spans[1:])], pa.large_string())
            parts = joined(counts, said, at)
            text = spelled(parts.offsets.to_numpy(), parts.flatten())
            text = pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)
            out = joined(counts, ids, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), out.cast(pa.list_(pa.int32())), text.cast(pa.string())], ["_id", "ids", "decoded"])
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return map_batches(rows, run, f"_id {kind}, ids array<int>, decoded string").withColumnRenamed("_id", id_col)
