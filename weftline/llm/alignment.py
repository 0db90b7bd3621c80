"""Alignment of two tokenizers over whole texts, with counts of aligned ids (operator 12).

Both encodings of a slice of texts are Arrow lists. Flattened with their parents' indices, the tokens' byte
lengths give byte ends by a cumulative sum that starts anew with each text. A hash join on (text, end)
finds the places where tokens of both end, a group-by counts each text's pairs of ids, and Spark adds
those partial counts up. Of two tokens that end together in equal bytes one is a suffix of the other, so
there are at most as many pairs of ids as the tokens of both vocabularies have bytes: that table is
small whatever the corpus, and it is broadcast.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import bpe, pieces
from weftline.llm.common import Rounds, cut, map_batches
from weftline.llm.merges import SHORT, PairTable, in_word_order

#: Texts of a slice and byte ends share a key: ends take so many bits.
END_BITS = 40
FIELDS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<struct<a:int,b:int,times:int>>"


class ByteTokens:
    """Byte-level BPE over tables of distinct words; special tokens' strings are plain text."""

    def __init__(self, path: str):
        self.codec = bpe.codec(path)
        keys = np.fromiter(self.codec.pairs, np.int64, len(self.codec.pairs))
        values = np.fromiter(self.codec.pairs.values(), np.int64, len(self.codec.pairs))
        self.pairs = PairTable(keys >> bpe.ID_BITS, keys & bpe.ID_MASK, values >> bpe.ID_BITS, values & bpe.ID_MASK)
        self.single = np.array(self.codec.single, np.int32)
        self.raw = [self.codec.bytes_of.get(i, b"") for i in range(max(self.codec.bytes_of) + 1)]

    def encode(self, texts: list[str]) -> pa.LargeListArray:
        found = [bpe.pattern_for(t).findall(t) if t else [] for t in texts]
        coded = pa.array([w for words in found for w in words], pa.large_string()).dictionary_encode()
        words = [w.encode("utf-8", "replace") for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols, short = self.single[np.frombuffer(b"".join(words), np.uint8)], sizes <= SHORT
        ids, merged = self.pairs.segment(symbols[np.repeat(short, sizes)], sizes[short])
        rest = np.flatnonzero(~short)
        single = [self.codec._heap(words[k]) for k in rest.tolist()]
        flat = np.array([i for each in single for i in each], np.int32)
        flat, sizes = in_word_order([(np.flatnonzero(short), ids, merged), (rest, flat, np.array([len(x) for x in single], np.int64))], len(words))
        table = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), flat)
        return pieces.joined(np.array([len(w) for w in found], np.int64), table, coded.indices.to_numpy(zero_copy_only=False))


class PieceTokens:
    """A SentencePiece model, which puts a space in front of each text itself."""

    def __init__(self, path: str):
        self.own = pieces.pieces(path)
        self.raw = [self.own.raw([i]) if i in self.own.byte_of or name in self.own.ids else b"" for i, name in enumerate(self.own.names)]

    def encode(self, texts: list[str]) -> pa.LargeListArray:
        counts, ids, _, at = pieces.word_table(self.own, texts)
        return pieces.joined(counts, ids, at)


class Tokens:
    """One side's tokens of a slice: ids, whose text and where in it they end, in bytes."""

    def __init__(self, lists: pa.LargeListArray, lengths: pa.Array):
        self.starts = lists.offsets.to_numpy()
        self.ids, self.text = pc.list_flatten(lists), pc.list_parent_indices(lists)
        running = pc.cumulative_sum(pc.take(lengths, self.ids))
        before = pa.array(np.concatenate([[0], running.to_numpy(zero_copy_only=False)])).take(pa.array(self.starts[:-1]))
        self.end = pc.subtract(running, before.take(self.text))

    def keyed(self, name: str) -> pa.Table:
        """Where each token stands, by its text and end in one key."""
        key = pc.bit_wise_or(pc.shift_left(self.text.cast(pa.int64()), END_BITS), self.end)
        return pa.table({"text_end": key, name: pa.array(np.arange(len(self.ids)))})


class Aligner:
    """Both tokenizers of a Python worker, and the strings that groups are written with."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.lengths = [pa.array([len(x) for x in side.raw], pa.int64()) for side in (self.a, self.b)]
        self.spelled = [pa.array(side.raw, pa.large_binary()) for side in (self.a, self.b)]
        #: Ids of A before a comma and a bar, then ids of B before a comma, a semicolon and nothing.
        self.written = pa.array([f"{i}{mark}" for side, marks in ((self.a, ",|"), (self.b, (",", ";", ""))) for mark in marks for i in range(len(side.raw))], pa.large_string())

    def batch(self, texts: list[str | None]) -> list[pa.Array]:
        spaced = [f" {t}" if t else "" for t in texts]
        sides = [self.a.encode(spaced), self.b.encode([t or "" for t in texts])]
        whole = self._whole(sides, spaced)
        a, b = (Tokens(_only(lists, whole), lengths) for lists, lengths in zip(sides, self.lengths))
        joined = a.keyed("at_a").join(b.keyed("at_b"), keys="text_end", join_type="inner", use_threads=False).sort_by("at_a")
        at_a, at_b = (joined[c].combine_chunks() for c in ("at_a", "at_b"))
        links = pa.table({"text": a.text.take(at_a), "a": a.ids.take(at_a), "b": b.ids.take(at_b), "at_a": at_a, "at_b": at_b})
        text = links["text"].to_numpy()
        n_links = np.bincount(text, minlength=len(texts)).astype(np.int64)
        return [*(pa.array(np.diff(x.starts)) for x in (a, b)), pa.array(n_links), pa.array(n_links), self._groups(a, b, links), _pairs(links, len(texts))]

    def _whole(self, sides: list[pa.LargeListArray], spaced: list[str]) -> np.ndarray:
        """Which texts both sides spell in full: all are compared at once, and one by one where that fails."""
        wanted = [t.encode("utf-8", "replace") for t in spaced]
        everything, good = b"".join(wanted), np.ones(len(spaced), bool)
        ends = np.cumsum(list(map(len, wanted)))
        for side, raw, lists in zip((self.a, self.b), self.spelled, sides):
            parts = raw.take(lists.values)
            run = np.concatenate([[0], np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False))])[lists.offsets.to_numpy()[1:]]
            if len(parts) and np.array_equal(run, ends) and np.array_equal(np.frombuffer(parts.buffers()[2], np.uint8)[: len(everything)], np.frombuffer(everything, np.uint8)):
                continue
            starts, flat = lists.offsets.to_numpy().tolist(), lists.values.to_numpy(zero_copy_only=False).tolist()
            for k, text in enumerate(wanted):
                good[k] &= b"".join(map(side.raw.__getitem__, flat[starts[k] : starts[k + 1]])) == text
        return good

    def _groups(self, a: Tokens, b: Tokens, links: pa.Table) -> pa.Array:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``: every token's written form is put where it belongs, and all are joined."""
        last_a, last_b = links["at_a"].to_numpy(), links["at_b"].to_numpy()
        at_a, at_b = np.arange(len(a.ids)), np.arange(len(b.ids))
        group_a, group_b = np.searchsorted(last_a, at_a), np.searchsorted(last_b, at_b)
        ends_a, ends_b = at_a == last_a[group_a] if len(at_a) else at_a > 0, at_b == last_b[group_b] if len(at_b) else at_b > 0
        closes = np.zeros(len(b.ids), bool)
        closes[b.starts[1:][np.diff(b.starts) > 0] - 1] = True
        size_a, size_b = len(self.a.raw), len(self.b.raw)
        code = np.zeros(len(at_a) + len(at_b), np.int64)
        code[at_a + np.concatenate([[0], last_b + 1])[group_a]] = a.ids.to_numpy(zero_copy_only=False) + size_a * ends_a
        code[at_b + last_a[group_b] + 1 if len(at_b) else at_b] = b.ids.to_numpy(zero_copy_only=False) + 2 * size_a + size_b * (ends_b.astype(np.int64) + closes)
        return pieces.spelled(a.starts + b.starts, self.written.take(pa.array(code)))


def _only(lists: pa.LargeListArray, whole: np.ndarray) -> pa.LargeListArray:
    """The lists of the texts that are whole; the others have none."""
    sizes = np.diff(lists.offsets.to_numpy())
    kept = lists.values.filter(pa.array(np.repeat(whole, sizes))) if not whole.all() else lists.values
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes * whole)]), kept)


def _pairs(links: pa.Table, n: int) -> pa.Array:
    """Each text's pairs of ids and how often it has them."""
    counted = links.group_by(["text", "a", "b"], use_threads=False).aggregate([([], "count_all")]).sort_by("text")
    ends = np.concatenate([[0], np.cumsum(np.bincount(counted["text"].to_numpy(), minlength=n))]).astype(np.int32)
    columns = [counted[c].combine_chunks().cast(pa.int32()) for c in ("a", "b", "count_all")]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, ["a", "b", "times"]))


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both encodings of each text aligned, before anything is counted over the corpus: ``id_col, n_a, n_b, n_groups, n_links, groups, pairs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            out = own.batch(batch.column(1).to_pylist())
            out[4] = out[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return map_batches(rows, run, f"_id {kind}, {FIELDS}").withColumnRenamed("_id", id_col)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Add up ``a, b, times``: ``a, b, count`` and whether no other ``a`` has more with that ``b`` (``is_best``)."""
    counts = pairs.groupBy("a", "b").agg(F.sum("times").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("_most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("_most")).alias("is_best"))


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_groups: Column | None = None) -> DataFrame:
    """Align each text's tokens of A (byte-level BPE of a space and the text) and B (SentencePiece) and count aligned ids.

    One row per input row, repeated rows included: ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``.
    ``groups`` is the alignment, written; ``keep_groups``, an expression over it, says what to keep of it
    instead, so that a digest is taken before anything is stored. Texts that are null or empty, or that a
    side can't spell (it holds the marker U+2581), have no tokens: zeros and an empty string. Other columns are not
    carried. A table in the shared folder holds what each text has; the texts are encoded once.
    """
    path_a, path_b = path_a or public_tokenizers.path(bpe.DEFAULT_VOCABULARY), path_b or public_tokenizers.path(pieces.DEFAULT_MODEL)
    found = aligned(docs, path_a, path_b, id_col, text_col).withColumn("groups", F.col("groups") if keep_groups is None else keep_groups)
    tables = Rounds(docs.sparkSession)
    kept = tables.put("aligned", found.withColumn("_row", F.monotonically_increasing_id()))
    pairs = kept.select("_row", F.inline("pairs"))
    counts = cut(pair_counts(pairs))
    told = pairs.join(F.broadcast(counts), ["a", "b"]).groupBy("_row").agg(
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    )
    rows = kept.drop("pairs").join(told, "_row", "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return rows.select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")
