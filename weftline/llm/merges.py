"""Byte-pair merges over many words at once, shared by the operators that segment tables of distinct words."""

from __future__ import annotations

import numpy as np

NO_RANK = np.int64(1 << 40)
#: Words of more symbols need too many rounds; they are merged one by one elsewhere.
SHORT = 64
_SHIFT = np.int64(24)


class PairTable:
    """Pairs of ids that merge, with the rank of the merge (least first, equal ranks leftmost first) and the id it gives.

    Pairs stand in an open hash table with room for eight times as many, so nearly all look-ups are one read.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        keys = left.astype(np.int64) << _SHIFT | right.astype(np.int64)
        self.bits = max(4, int(len(keys)).bit_length() + 3)
        size = 1 << self.bits
        self.keys, self.ranks, self.merged = np.full(size, -1, np.int64), np.full(size, NO_RANK), np.zeros(size, np.int32)
        todo, slots = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slots] == -1
            put, first = np.unique(slots[free], return_index=True)
            chosen = todo[free][first]
            self.keys[put], self.ranks[put], self.merged[put] = keys[chosen], ranks[chosen], merged[chosen]
            left_over = self.keys[slots] != keys[todo]
            todo, slots = todo[left_over], (slots[left_over] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = left.astype(np.int64) << _SHIFT | right
        at = self._slot(wanted)
        there = self.keys[at]
        todo = np.flatnonzero((there != wanted) & (there != -1))
        while len(todo):  # another key stands there: go on to the next slot
            at[todo] = (at[todo] + 1) % len(self.keys)
            there = self.keys[at[todo]]
            todo = todo[(there != wanted[todo]) & (there != -1)]
        return self.ranks[at], self.merged[at]

    def segment(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every word's symbols: the words' ids one after another, and how many each has.

        A round merges the leftmost least pair of every word that still has one, so there are as many rounds as
        the longest word has merges, over ever fewer symbols.
        """
        word = np.repeat(np.arange(len(sizes)), sizes)
        ids, done = ids.astype(np.int32), []
        rank, into = self._pairs(ids, word)
        while len(ids):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(starts, append=len(ids))
            open_ = np.repeat(best < NO_RANK, lengths)
            if not open_.all():
                done.append((word[~open_], ids[~open_]))
                ids, word, rank, into = ids[open_], word[open_], rank[open_], into[open_]
                best, lengths = best[best < NO_RANK], lengths[best < NO_RANK]
            if not len(ids):
                break
            hits = np.flatnonzero(rank == np.repeat(best, lengths))
            hits = hits[np.diff(word[hits], prepend=-1) != 0]
            ids[hits] = into[hits]
            kept = np.ones(len(ids), bool)
            kept[hits + 1] = False
            at = hits - np.arange(len(hits))  # where they stand when the deleted ones are gone
            ids, word, rank, into = ids[kept], word[kept], rank[kept], into[kept]
            changed = np.concatenate([at, at[at > 0] - 1])
            nexts = np.minimum(changed + 1, len(ids) - 1)
            new_rank, new_into = self.look_up(ids[changed], ids[nexts])
            same = (nexts > changed) & (word[nexts] == word[changed])
            rank[changed], into[changed] = np.where(same, new_rank, NO_RANK), new_into
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        words, values = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(words, kind="stable")
        return values[order], np.bincount(words, minlength=len(sizes))

    def _pairs(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, into = np.full(len(ids), NO_RANK), np.zeros(len(ids), np.int32)
        if len(ids) > 1:
            found, merged = self.look_up(ids[:-1], ids[1:])
            rank[:-1], into[:-1] = np.where(word[1:] == word[:-1], found, NO_RANK), merged
        return rank, into


def in_word_order(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Put lists of ids of disjoint sets of words together: of ``(which words, ids, sizes)`` the ids in the words' order, and all sizes."""
    sizes = np.zeros(n, np.int64)
    for which, _, own in parts:
        sizes[which] = own
    starts, out = np.concatenate([[0], np.cumsum(sizes)]), np.zeros(int(sizes.sum()), np.int32)
    for which, ids, own in parts:
        first = np.repeat(starts[which] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) if len(own) else np.zeros(0, np.int64)
        out[first + np.arange(len(ids))] = ids
    return out, sizes
