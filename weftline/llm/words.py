"""Vectorised word hashing shared by the operators that compare word shingles.

A batch of texts is treated as one byte array: words are maximal runs of word bytes, and every word
gets a 64-bit hash from prefix sums of a polynomial over its bytes, so no Python loop runs per word.
"""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the polynomial and its inverse modulo 2**64.
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
_CHUNK = 1 << 17
_BYTE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _powers(base: int) -> np.ndarray:
    out = np.full(_CHUNK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _POW_INV = _powers(_MUL), _powers(_INV)

#: Byte tables: lower-cased byte, or 0 for a separator.
SPACE_WORDS = np.arange(256, dtype=np.uint8)
SPACE_WORDS[[9, 10, 11, 12, 13, 32]] = 0
SPACE_WORDS[65:91] += 32
#: As above, but every ASCII character other than a letter or digit separates words.
ALNUM_WORDS = SPACE_WORDS.copy()
ALNUM_WORDS[[b for b in range(128) if not chr(b).isalnum()]] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hash_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of raw[start:end] for sorted, disjoint spans; equal bytes give equal hashes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, lo + _CHUNK, "right")))
        hi = int(ends[stop - 1])
        if hi - lo > _CHUNK:  # one word longer than a chunk: fold it chunk by chunk
            value = np.zeros(1, np.uint64)
            for piece in range(lo, hi, _CHUNK):
                part = _BYTE[raw[piece : min(hi, piece + _CHUNK)]]
                value = mix(value + (part * _POW[: len(part)]).sum(dtype=np.uint64))
            out[at] = value[0]
        else:
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE[raw[lo:hi]] * _POW[: hi - lo], out=sums[1:])
            s, e = starts[at:stop] - lo, ends[at:stop] - lo
            out[at:stop] = (sums[e] - sums[s]) * _POW_INV[s]
        at = stop
    return mix(out)


def word_hashes(texts: list[str | None], table: np.ndarray = SPACE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the bounds: text i has words[bounds[i]:bounds[i + 1]]."""
    blobs = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    raw = table[np.frombuffer(b"\0".join(blobs) + b"\0", np.uint8)]
    inside = np.empty(len(raw) + 1, bool)
    inside[0] = False
    np.not_equal(raw, 0, out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    cuts = np.cumsum([len(b) + 1 for b in blobs])
    bounds = np.concatenate([[0], np.searchsorted(starts, cuts)]).astype(np.int64)
    return _hash_bytes(raw, starts, ends), bounds


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all windows of ``size`` words; fewer words make one window; none make none."""
    if not len(words):
        return words
    k = min(size, len(words))
    n = len(words) - k + 1
    out = mix(words[:n] + np.uint64(k))
    for i in range(1, k):
        out = out * np.uint64(_MUL) + words[i : i + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def pieces_of(texts: list[str | None], chars: int = 500_000):
    """Split a batch into slices of about ``chars`` characters; one text is never split."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def shingle_sets(texts: list[str | None], size: int = 5):
    """For each text its distinct shingle hashes in ascending order, without a loop over words."""
    for lo, hi in pieces_of(texts):
        words, bounds = word_hashes(texts[lo:hi])
        for a, b in zip(bounds[:-1], bounds[1:]):
            hashes = shingle_hashes(words[a:b], size)
            hashes.sort()
            if len(hashes) > 1:
                keep = np.empty(len(hashes), bool)
                keep[0] = True
                np.not_equal(hashes[1:], hashes[:-1], out=keep[1:])
                hashes = hashes[keep]
            yield hashes
