"""Quality classifier (operator 1): random Fourier features over document statistics.

The features approximate a Gaussian kernel; every partition sums its part of the normal equations,
ridge regression solves their total, and isotonic regression on rows kept apart makes calibrated
scores of the regression's values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, map_slices
from weftline.llm.words import ALNUM_WORDS, pieces_of, shingle_hashes, word_hashes

#: Random features, width of the Gaussian kernel on standardised statistics, ridge penalty, seed.
FEATURES, WIDTH, RIDGE, SEED = 256, 4.0, 1.0, 7
#: Rows that fit and calibrate the model at most; of more labelled rows those with the least hash are taken.
TRAIN_ROWS = 400_000
#: Partitions into which partial sums are gathered before the driver adds them up, and bins of the calibration.
GATHER, BINS = 16, 512
ACCEPT = 0.7
HELD_OUT, CALIBRATE, FOLDS = 2, 3, 4

_CLASSES = np.full(256, 7)
for _i, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\v\f", b"\n", b".,;:?'\"()-", b"!")):
    _CLASSES[list(_bytes)] = _i
_CLASSES[128:] = 8
STATISTICS = 20


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of STATISTICS numbers for each text, from its characters, words, shingles and lines only."""
    out = np.zeros((len(texts), STATISTICS))
    for lo, hi in pieces_of(texts):
        words, bounds = word_hashes(texts[lo:hi], ALNUM_WORDS)
        for i in range(lo, hi):
            text, own = texts[i] or "", words[bounds[i - lo] : bounds[i - lo + 1]]
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            row = out[i]
            row[0], row[1] = np.log1p(len(text)), np.log1p(len(own))
            if not len(raw):
                continue
            kinds = np.bincount(_CLASSES, np.bincount(raw, minlength=256), minlength=9) / len(raw)
            row[2:11] = np.sqrt(kinds)
            row[11] = len(text) / (len(own) + 1)
            if len(own):
                distinct, counts = np.unique(own, return_counts=True)
                row[12] = len(distinct) / len(own)
                row[13] = len(distinct) / len(own) ** 0.8
                row[14] = counts.max() / len(own)
                row[15] = (own[1:] == own[:-1]).mean() if len(own) > 1 else 0
                shingles = shingle_hashes(own)
                row[16] = len(np.unique(shingles)) / len(shingles)
            lines = text.split("\n")
            row[17] = len(set(lines)) / len(lines)
            row[18] = np.log1p(len(text) / len(lines))
            row[19] = np.log1p(text.count(". ") + text.count(".\n"))
    return out


@dataclass(frozen=True)
class Model:
    """Everything that scores a row of statistics; its size does not depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(fourier((rows - self.mean) / self.scale) @ self.weights, self.knots, self.levels)


def fourier(rows: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    random = np.random.default_rng(SEED)
    spread, shift = random.normal(size=(STATISTICS, FEATURES)) / WIDTH, random.uniform(0, 2 * np.pi, FEATURES)
    waves = np.sqrt(2 / FEATURES) * np.cos(np.clip(rows, -8, 8) @ spread + shift)
    return np.hstack([waves, np.ones((len(rows), 1))])


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the closest non-decreasing sequence."""
    pools: list[list[float]] = []
    for value, weight in zip(values, weights):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, w, n = pools.pop()
            last = pools[-1]
            last[0] = (last[0] * last[1] + v * w) / (last[1] + w)
            last[1] += w
            last[2] += n
    return np.concatenate([np.full(n, v) for v, _, n in pools]) if pools else np.zeros(0)


def fold(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS


def _summed(rows: DataFrame, width: int, part_of) -> np.ndarray:
    """Sum over all partitions of a matrix that ``part_of`` makes of each batch.

    Partial sums are gathered into GATHER partitions and summed there, so the driver adds up no
    more than GATHER of them.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for batch in batches:
            total += part_of(batch)
        yield pd.DataFrame({"sums": [total.tobytes()]})

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for batch in batches:
            for sums in batch["sums"]:
                total += np.frombuffer(sums)
        yield pd.DataFrame({"sums": [total.tobytes()]})

    found = map_slices(map_slices(rows, partial, "sums binary").repartition(GATHER), gather, "sums binary").collect()
    return np.sum([np.frombuffer(s) for (s,) in found], axis=0) if found else np.zeros(width)


def fit(labelled: DataFrame) -> Model:
    """Fit on ``labelled(x: array<double>, y: int, part: int)``; part CALIBRATE calibrates, the rest fits.

    Statistics that do not vary are left alone; without rows all scores are 0.5.
    """
    size = FEATURES + 1
    fitting, calibrating = labelled.where(F.col("part") != CALIBRATE), labelled.where(F.col("part") == CALIBRATE)
    stack = lambda batch: np.array(batch["x"].tolist()).reshape(len(batch), STATISTICS)

    def moments(batch: pd.DataFrame) -> np.ndarray:
        x = stack(batch)
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    n, sums, squares = np.split(_summed(fitting, 2 * STATISTICS + 1, moments), [1, STATISTICS + 1])
    count = max(1.0, float(n[0]))
    mean = sums / count
    scale = np.sqrt(np.maximum(squares / count - mean**2, 0))
    scale[scale < 1e-9] = 1.0

    def equations(batch: pd.DataFrame) -> np.ndarray:
        z = fourier((stack(batch) - mean) / scale)
        return np.concatenate([(z.T @ z).ravel(), z.T @ batch["y"].to_numpy(float)])

    gram, right = np.split(_summed(fitting, size * (size + 1), equations), [size * size])
    weights = np.linalg.solve(gram.reshape(size, size) + RIDGE * np.eye(size), right)
    low, high = -0.5, 1.5

    def binned(batch: pd.DataFrame) -> np.ndarray:
        values = fourier((stack(batch) - mean) / scale) @ weights
        at = np.clip(((values - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, batch["y"].to_numpy(float), minlength=BINS)])

    totals, good = np.split(_summed(calibrating, 2 * BINS, binned), [BINS])
    seen = np.flatnonzero(totals)
    if not len(seen):
        seen, totals, good = np.array([0]), np.ones(1), np.full(1, 0.5)
    return Model(mean, scale, weights, low + (seen + 0.5) * (high - low) / BINS, isotonic(good[seen] / totals[seen], totals[seen]))


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.drop(columns="_text").assign(x=list(statistics(batch["_text"].tolist())))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS,
    key_col: str | None = None,
) -> DataFrame:
    """Score every whole text: ``id_col, held_out, score, predicted``, one row per input row.

    The score uses the text alone. Labels are learned only from rows whose crc32(id as text) mod 4
    is not 2, in at most ``train_rows`` rows: of more, those with the least hash of their id, which
    is a uniform sample by the hash's range. Null labels and null ids teach nothing, repeated
    labels count each. Null and empty texts are scored like any other. ``predicted`` is 1 from
    ACCEPT. ``key_col`` names one more column to carry. Shuffles carry a few numbers per labelled document, never texts.
    """
    context = docs.sparkSession.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    carried = {"_id": (id_col, kind)} | ({"_key": (key_col, docs.schema[key_col].dataType.simpleString())} if key_col else {})
    fields = ", ".join(f"{a} {t}" for a, (_, t) in carried.items())
    rows = docs.select(*(F.col(c).alias(a) for a, (c, _) in carried.items()), F.col(text_col).alias("_text"))
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id is not null and y is not null")
    marks = marks.withColumn("part", fold("_id").cast("int")).where(F.col("part") != HELD_OUT)
    known = marks.count()
    if known > train_rows:
        marks = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < F.lit(int((1 << 40) * train_rows / known)))
    described = map_slices(rows, _described, f"{fields}, x array<double>")
    described = cut(described)
    model = context.broadcast(fit(cut(described.join(marks, "_id").select("x", "y", "part"))))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["x"].tolist()).reshape(len(batch), STATISTICS)
            yield batch[list(carried)].assign(score=np.clip(model.value.score(x), 0, 1))

    out = map_slices(described, scored, f"{fields}, score double")
    predicted = (F.col("score") >= ACCEPT).cast("int")
    return out.select(F.col("_id").alias(id_col), (fold("_id") == HELD_OUT).alias("held_out"), "score", predicted.alias("predicted"), *([F.col("_key").alias(key_col)] if key_col else []))
