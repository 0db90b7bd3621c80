"""Ranked lexical search by best-first intervals over range-maximum tables (operator 11).

One reading of the texts keeps, of every document, the occurrences of the items' terms. Corpus counts come
from those rows. A shard is a run of documents of bounded size: each term has a posting list of document
places and impacts, and a sparse table of the places where impacts are greatest. For an item, the interval of all
documents is bounded by the sum of the lists' greatest impacts in it. The interval of the greatest bound
is split at the document of the greatest impact, which is scored in full, until no bound reaches the item's
k-th score. Intervals of few documents are scored whole. Shards' best documents meet in a window per item.

Scores are integers, so all orders of summing give the same, and a bound is never below a score it bounds.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, IntegerType, StructField, StructType

from weftline.llm.common import Rounds, map_batches

#: Terms are runs of letters and digits of ASCII and of all that is not ASCII; bytes of UTF-8 tell as much.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: A shard has at most so many documents and, but for a longer single document, so many postings.
SHARD_DOCUMENTS, SHARD_POSTINGS = 1 << 13, 1 << 20
#: Intervals of so many documents are scored whole.
LEAF = 128
#: Items whose terms are looked for in one reading; more items mean more readings.
ITEMS_A_PASS, ITEM_BYTES = 20_000, 1 << 25
#: One in so many documents is searched first, for a k-th score that bounds the search of all.
FIRST_LOOK = 16


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text in order, only A-Z lower-cased; none for null."""
    return TERM.findall((text or "").encode("utf-8", "replace").lower())


def impact(weight: np.ndarray, times: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score; all are 64-bit integers. ``length`` is the document's m."""
    return weight * ((1_000_000_000 * times) // (1000 * times + 20 * length))


class Shard:
    """Posting lists of a run of ``size`` documents, with a sparse table of greatest impacts for each.

    Postings come sorted by term and place; ``value`` is a posting's impact.
    """

    def __init__(self, size: int, term: np.ndarray, place: np.ndarray, value: np.ndarray, n_terms: int):
        self.size, self.place, self.value = size, place, value
        self.start = np.searchsorted(term, np.arange(n_terms + 1))
        #: tables[j][i]: where the greatest impact of the 2**j postings from i on is; lists lie one after another and are never crossed.
        longest = int(np.diff(self.start).max(initial=0))
        self.tables = [np.arange(len(value), dtype=np.int32)]
        while 2 << len(self.tables) - 1 <= longest:
            last, half = self.tables[-1], 1 << len(self.tables) - 1
            left, right = last[: len(last) - half], last[half:]
            self.tables.append(np.where(value[left] >= value[right], left, right))

    def greatest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of each range of postings, none of them empty, where its greatest impact is: two look-ups."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for j in np.unique(level):
            own = level == j
            left, right = self.tables[j][lo[own]], self.tables[j][hi[own] - (1 << j)]
            out[own] = np.where(self.value[left] >= self.value[right], left, right)
        return out

    def best(self, wanted: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """``(score, place)`` of documents that may be among the ``k`` best for the terms: all that are, of scores from ``floor`` on."""
        lists = [(int(self.start[t]), int(self.start[t + 1])) for t in wanted if self.start[t] < self.start[t + 1]]
        if not lists:
            return []
        bounds = np.array(lists, np.int64)
        found: list[int] = []  # the k greatest scores so far, a heap
        out: list[tuple[int, int]] = []

        def take(scores: np.ndarray, places: np.ndarray) -> None:
            for score, at in zip(scores.tolist(), places.tolist()):
                if score >= max(floor, 1) and (len(found) < k or score >= found[0]):
                    out.append((score, at))
                    heapq.heappush(found, score) if len(found) < k else heapq.heappushpop(found, score)

        def interval(first: int, last: int, lo: np.ndarray, hi: np.ndarray) -> None:
            """Queue the documents from first to before last, whose postings are given; short ones are scored at once."""
            some = lo < hi
            lo, hi = lo[some], hi[some]
            if not len(lo):
                return
            if last - first <= LEAF:
                postings = np.concatenate([np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist())])
                scores = np.zeros(last - first, np.int64)
                np.add.at(scores, self.place[postings] - first, self.value[postings])
                good = np.flatnonzero(scores >= max(floor, 1, found[0] if len(found) == k else 0))
                take(scores[good], good + first)
                return
            peak = self.greatest(lo, hi)
            bound = int(self.value[peak].sum())
            if bound >= max(floor, 1) and (len(found) < k or bound >= found[0]):
                heapq.heappush(queue, (-bound, first, last, lo, hi, int(self.place[peak[np.argmax(self.value[peak])]])))

        queue: list[tuple] = []
        interval(0, self.size, bounds[:, 0], bounds[:, 1])
        while queue:
            bound, first, last, lo, hi, middle = heapq.heappop(queue)
            if -bound < max(floor, found[0] if len(found) == k else 0):
                break
            cut_at = np.array([a + np.searchsorted(self.place[a:b], middle) for a, b in zip(lo.tolist(), hi.tolist())])
            here = (cut_at < hi) & (self.place[np.minimum(cut_at, len(self.place) - 1)] == middle)
            take(self.value[cut_at[here]].sum(keepdims=True), np.array([middle]))
            interval(first, middle, lo, cut_at)
            interval(middle + 1, last, cut_at + here, hi)
        return out


def occurrences(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Of each document that has a term: ``_id``, how many terms with repeats (``n``), and the vocabulary's terms (``term``) and their times (``tf``)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            kept, lengths, sizes, term, times = [], [], [0], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = terms(text)
                if not found:
                    continue
                counts = Counter(found)
                own = sorted((known[t], counts[t]) for t in counts.keys() & known.keys())
                kept.append(k)
                lengths.append(len(found))
                term += [t for t, _ in own]
                times += [n for _, n in own]
                sizes.append(len(term))
            ends = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((term, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(lengths, pa.int64()), *lists], ["_id", "n", "term", "tf"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return map_batches(rows, run, f"_id {kind}, n bigint, term array<int>, tf array<bigint>")


def searched(found: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_documents: int, n_terms: int, k: int, floors: np.ndarray) -> DataFrame:
    """Search the shards that each task reads: ``item, _id, score`` of documents that may be among the ``k`` best.

    ``items`` holds each item's terms, ``floors`` a score that its k-th best document reaches at least.
    """
    shared, kind = found.sparkSession.sparkContext.broadcast((items, weights, floors)), to_arrow_type(found.schema["_id"].dataType)

    def search(ids: list, lengths: list, term: list, tf: list, floor: np.ndarray) -> pa.RecordBatch:
        wanted, weight, _ = shared.value
        place = np.repeat(np.arange(len(ids)), list(map(len, term)))
        terms_, times = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (term, tf))
        length = 50 + (50 * np.array(lengths, np.int64) * n_documents) // n_terms
        order = np.lexsort((place, terms_))
        place, terms_, times = place[order], terms_[order], times[order]
        shard = Shard(len(ids), terms_, place, impact(weight[terms_], times, length[place]), len(weight))
        rows: list[tuple[int, int, int]] = []
        for item, own in enumerate(wanted):
            best = sorted(shard.best(own, k, int(floor[item])), reverse=True)
            last = best[k - 1][0] if len(best) >= k else 1
            floor[item] = max(floor[item], last)
            rows += [(item, at, score) for score, at in best if score >= last]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([ids[r[1]] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], ["item", "_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = shared.value[2].copy()  # rises from shard to shard of a task
        held: tuple[list, ...] = ([], [], [], [])
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(2)), *(batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))):
                if held[0] and (len(held[0]) >= SHARD_DOCUMENTS or sum(map(len, held[2])) + len(row[2]) > SHARD_POSTINGS):
                    yield search(*held, floor)
                    held = ([], [], [], [])
                for column, value in zip(held, row):
                    column.append(value)
        if held[0]:
            yield search(*held, floor)

    return map_batches(found, run, f"item int, _id {found.schema['_id'].dataType.simpleString()}, score bigint")


def _one_pass(docs: DataFrame, items: list[tuple], k: int, kind: DataType, id_col: str, text_col: str) -> DataFrame:
    """The ``k`` best documents of each of ``((item id,), texts)``: ``_item, rank, _id, score``."""
    spark, tables = docs.sparkSession, Rounds(docs.sparkSession)
    words = [set(t for text in texts for t in terms(text)) for _, texts in items]
    vocabulary = {t: n for n, t in enumerate(sorted(set().union(*words)))}
    wanted = [np.array(sorted(vocabulary[t] for t in own), np.int64) for own in words]
    found = tables.put("occurrences", occurrences(docs, vocabulary, id_col, text_col))
    n_documents, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    with_term = dict(found.select(F.explode("term").alias("term")).groupBy("term").count().collect())
    weights = np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * with_term.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    order = lambda: Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("_id"))
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order()))
    floors = np.zeros(len(items), np.int64)
    first = searched(found.where(F.pmod(F.xxhash64("_id", "n"), F.lit(FIRST_LOOK)) == 0), wanted, weights, n_documents, n_terms, k, floors)
    for item, score in ranked(first).where(F.col("rank") <= k).where(F.col("rank") == k).select("item", "score").collect():
        floors[item] = score
    top = ranked(searched(found, wanted, weights, n_documents, n_terms, k, floors)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, *key) for n, (key, _) in enumerate(items)], StructType([StructField("item", IntegerType()), StructField("_item", kind)]))
    return top.join(F.broadcast(names), "item").select("_item", "rank", "_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rank all documents for each item: ``item_col, rank, id_col, score``, the ``k`` best with a score above 0.

    Ranks are unique and start at 1; equal scores go by ascending id, null ids last. Documents that share an id are
    ranked each on its own; rows of ``items`` that share an id (null is one, too) are one item with the terms of all.
    Null or empty texts have no terms: such documents count nowhere and are never found, such items find nothing.
    Other columns are not carried.

    Items are taken about ITEMS_A_PASS at a time and no more than ITEM_BYTES of text; each pass reads the texts once
    and broadcasts its items' terms. Every task sends on the documents that reach an item's bound, which a
    first look at one document in FIRST_LOOK sets.
    """
    kind = items.schema[item_col].dataType
    rows = items.select(F.col(item_col).alias("_item"), F.coalesce(item_text_col, F.lit("")).alias("_text"))
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    passes = max(1, -(-count // ITEMS_A_PASS), -(-size // ITEM_BYTES))
    out = None
    for n in range(passes):
        own = rows.where(F.pmod(F.xxhash64("_item"), F.lit(passes)) == n).groupBy("_item").agg(F.collect_list("_text").alias("_texts"))
        found = _one_pass(docs, [((x["_item"],), x["_texts"]) for x in own.collect()], k, kind, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("_item").alias(item_col), "rank", F.col("_id").alias(id_col), "score")
