"""Benchmark decontamination by SimHash of item-sized windows (operator 9).

Every window of a document as long as a benchmark item, or a shorter document as a whole, has a
64-bit SimHash of its weighted shingles. Items are indexed under every value of eight 8-bit blocks within two bits of their own,
so each item within the Hamming radius of a window shares a key with it; candidates within the
radius are then verified by exact weighted Jaccard similarity.

An item and a window that link share four fifths of the item's weight. So a stretch of text is held against an item only where it
has shingles of that weight, and windows of it only where they have: a phrase that very many items share costs one sum.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, map_slices
from weftline.llm.words import ALNUM_WORDS, pieces_of, shingle_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Eight blocks with two free bits each cover all fingerprints up to 8 * (2 + 1) - 1 bits away.
BLOCKS, FREE_BITS = 8, 2
RADIUS = BLOCKS * (FREE_BITS + 1) - 1
#: Items and characters of the benchmark that one pass over the documents holds.
ITEMS_A_PASS, CHARS_A_PASS = 20_000, 8_000_000
_MARK_BITS = 20
_BITS = np.arange(64, dtype=np.uint64)
_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def shingle_weights(words: np.ndarray, size: int) -> np.ndarray:
    """Weight of each shingle: its distinct words, so repetitive ones count less."""
    n = len(words) - size + 1
    weights = np.ones(max(n, 0), np.int32)
    for j in range(1, size):
        fresh = np.ones(n, bool)
        for i in range(j):
            fresh &= words[i : i + n] != words[j : j + n]
        weights += fresh
    return weights


def _signs(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (((hashes[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1) * weights[:, None]


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles; equal shingles have equal weights."""
    bags: list[dict[int, int]] = []
    for hashes, weights in ((a, wa), (b, wb)):
        bag: dict[int, int] = defaultdict(int)
        for h, w in zip(hashes.tolist(), weights.tolist()):
            bag[h] += w
        bags.append(bag)
    common = sum(min(w, bags[1].get(h, 0)) for h, w in bags[0].items())
    return common / (sum(bags[0].values()) + sum(bags[1].values()) - common)


class ItemIndex:
    """The items of one pass, and for each of their shingles the items that have it and with what weight."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.marks = np.zeros(1 << _MARK_BITS, bool)
        self.items: list[tuple[int, np.ndarray, np.ndarray]] = []
        lengths, totals, prints, owners = [], [], [], []
        words, bounds = word_hashes([t.lower() for t in texts], ALNUM_WORDS)
        for item, a, b in zip(ids, bounds[:-1], bounds[1:]):
            own = words[a:b]
            if len(own):
                size = min(SHINGLE, len(own))
                hashes, weights = shingle_hashes(own, size), shingle_weights(own, size)
                self.marks[hashes >> np.uint64(64 - _MARK_BITS)] = True
                prints.append(_fingerprints(_signs(hashes, weights).sum(axis=0)[None])[0])
                lengths.append(len(own))
                totals.append(int(weights.sum()))
                owners.append((hashes, np.full(len(hashes), len(self.items)), weights))
                self.items.append((item, hashes, weights))
        self.lengths, self.totals, self.prints = np.array(lengths, np.int64), np.array(totals, np.int64), np.array(prints, np.uint64)
        self.shingle_sizes = sorted({min(SHINGLE, length) for length in lengths})
        self.longest = max(lengths, default=0)
        #: For each block and each of its 256 values, whether an item is within FREE_BITS of it there.
        keys = self.prints.view(np.uint8).reshape(-1, BLOCKS)
        self.blocks = [_POPCOUNT[np.arange(256)[:, None] ^ keys[:, b]] <= FREE_BITS for b in range(BLOCKS)]
        none = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        hashes, item, weight = (np.concatenate(x) for x in zip(*(owners or none)))
        order = np.argsort(hashes, kind="stable")
        self.shingles, self.first = np.unique(hashes[order], return_index=True)
        self.first = np.append(self.first, len(hashes))
        self.owner, self.owner_weight = item[order], weight[order]

    def matches(self, words: np.ndarray) -> dict[int, float]:
        """Items that a text contains, with their best similarity."""
        found: dict[int, float] = {}
        for size in self.shingle_sizes:
            if len(words) < size:
                continue
            hashes = shingle_hashes(words, size)
            hits = np.flatnonzero(self.marks[hashes >> np.uint64(64 - _MARK_BITS)])
            if len(hits):  # the marks let a few other shingles through
                at = np.searchsorted(self.shingles, hashes[hits])
                hits = hits[self.shingles[np.minimum(at, len(self.shingles) - 1)] == hashes[hits]]
            for lo, hi in self._regions(hits, len(hashes), size):
                near = self._near(np.unique(hashes[hits[np.searchsorted(hits, lo) : np.searchsorted(hits, hi)]]), size)
                if len(near):
                    self._windows(hashes[lo:hi], shingle_weights(words[lo : hi + size - 1], size), size, near, found)
        return found

    def _near(self, there: np.ndarray, size: int) -> np.ndarray:
        """Items of which these shingles have enough weight for a link."""
        at = np.searchsorted(self.shingles, there)
        counts = self.first[at + 1] - self.first[at]
        places = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        owned, where = np.unique(self.owner[places], return_inverse=True)
        weight = np.bincount(where, self.owner_weight[places], len(owned))
        return owned[(weight >= THRESHOLD * self.totals[owned] - 0.5) & (np.minimum(self.lengths[owned], SHINGLE) == size)]

    def _regions(self, hits: np.ndarray, n: int, size: int) -> Iterator[tuple[int, int]]:
        """Stretches that hold every window with a marked shingle; other windows share nothing with any item."""
        reach = self.longest if size == SHINGLE else size
        lo = hi = None
        for hit in hits.tolist():
            if hi is None or hit - reach > hi or hi - lo > 20_000:  # long stretches come in pieces that overlap by a window
                if hi is not None:
                    yield lo, hi
                lo = max(0, hit - reach)
            hi = min(n, hit + reach + 1)
        if hi is not None:
            yield lo, hi

    def _windows(self, hashes: np.ndarray, weights: np.ndarray, size: int, near: np.ndarray, found: dict[int, float]) -> None:
        """Match the windows of a stretch with items, each with those that have enough of its weight, nearest fingerprints first."""
        sums = np.zeros((len(hashes) + 1, 64), np.int32)
        np.cumsum(_signs(hashes, weights), axis=0, out=sums[1:])
        for length in np.unique(self.lengths[near]).tolist():
            k = min(length - size + 1, len(hashes))  # a stretch shorter than the item is the whole text
            windows = _fingerprints(sums[k:] - sums[:-k])
            for place in near[self.lengths[near] == length].tolist():
                name, own, own_weights = self.items[place]
                run = np.concatenate([[0], np.cumsum(weights * np.isin(hashes, own))])
                at = np.flatnonzero(run[k:] - run[:-k] >= THRESHOLD * self.totals[place] - 0.5)
                keys = windows[at].view(np.uint8).reshape(-1, BLOCKS)
                at = at[np.any([self.blocks[b][keys[:, b], place] for b in range(BLOCKS)], axis=0)]
                apart = np.bitwise_count(windows[at] ^ self.prints[place])
                for i in np.argsort(apart, kind="stable").tolist():
                    if apart[i] > RADIUS or found.get(name, 0) >= 1:
                        break
                    p = at[i]
                    similarity = weighted_jaccard(hashes[p : p + k], weights[p : p + k], own, own_weights)
                    if similarity >= THRESHOLD and similarity > found.get(name, 0):
                        found[name] = similarity


def _scan(index: Broadcast, carry: list[str], hits_only: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, items, best = batch["_text"].tolist(), [], []
            for lo, hi in pieces_of(texts):
                words, bounds = word_hashes([(t or "").lower() for t in texts[lo:hi]], ALNUM_WORDS)
                for a, b in zip(bounds[:-1], bounds[1:]):
                    found = index.value.matches(words[a:b])
                    items.append(sorted(found))
                    best.append(max(found.values(), default=0.0))
            out = batch[carry].assign(_items=items, _best=best)
            yield out[[len(x) > 0 for x in items]] if hits_only else out

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    items_a_pass: int = ITEMS_A_PASS, chars_a_pass: int = CHARS_A_PASS,
) -> DataFrame:
    """Benchmark items in every document: ``id_col, contaminated, item_ids, n_items, similarity``, one row per input row.

    Words are runs of letters and digits, lower-cased. A document contains an item if one of its
    windows of the item's length, or the whole of a shorter document, has weighted Jaccard
    similarity >= 0.8 with it over 5-word shingles; an item of fewer words is one shingle and must occur as it is. ``item_ids`` are
    sorted, ``similarity`` is the best, 0 without any. Null or wordless texts contain nothing;
    items with a null id, or without words, match nothing; items that share an id count as one.

    The benchmark's size is measured: blocks of about ``items_a_pass`` items and ``chars_a_pass``
    characters are broadcast, each in a pass over the documents of its own. One block needs no
    shuffle; of more, each pass gives its hits by text digest, which are joined to the ids in the end.
    A window of similarity 0.8 is beyond the Hamming radius with a chance of about one in 10**5.
    """
    context = docs.sparkSession.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    items = cut(benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    passes = max(1, -(-size["n"] // items_a_pass), -(-size["chars"] // chars_a_pass))

    def index_of(part: int) -> Broadcast:
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == part).collect()
        return context.broadcast(ItemIndex([r["item"] for r in block], [r["text"] for r in block]))

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = "_items array<bigint>, _best double"
    if passes == 1:
        judged = map_slices(rows, _scan(index_of(0), ["_id"], False), f"_id {kind}, {found}")
    else:
        digested = rows.select("_id", F.md5("_text").alias("_digest"), "_text")
        texts = digested.select("_digest", "_text")
        hits = [cut(map_slices(texts, _scan(index_of(part), ["_digest"], True), f"_digest string, {found}").dropDuplicates(["_digest"])) for part in range(passes)]
        together = reduce(DataFrame.unionByName, hits).groupBy("_digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"), F.max("_best").alias("_best"))
        judged = digested.select("_id", "_digest").join(together, "_digest", "left").select("_id", F.coalesce("_items", F.array().cast("array<bigint>")).alias("_items"), F.coalesce("_best", F.lit(0.0)).alias("_best"))
    n_items = F.size("_items").cast("long")
    return judged.select(F.col("_id").alias(id_col), (n_items > 0).alias("contaminated"), F.col("_items").alias("item_ids"), n_items.alias("n_items"), F.col("_best").alias("similarity"))
