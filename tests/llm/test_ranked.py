"""Operator 11 against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from weftline.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    counts = [(i, Counter(TERM.findall((t or "").translate(lower)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_all, terms = len(counts), sum(sum(c.values()) for _, c in counts)
    with_term = Counter(t for _, c in counts for t in c)
    own: dict = {}
    for i, t in items:
        own.setdefault(i, set()).update(TERM.findall((t or "").translate(lower)))
    out = []
    for item, words in own.items():
        scores = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n_all) // terms
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * with_term[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if c[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, n + 1, i, -s) for n, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return out


def words(rng, n):
    return " ".join(f"W{int(rng.paretovariate(0.6)) % 400}" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    docs = [(n, words(rng, rng.choice([3, 20, 60]))) for n in range(900)]
    docs += [(5000 + n, "same words here W1 W2") for n in range(120)] + [(7, "W9 W9"), (7, "W9 W9"), (None, "w9 É w9-É"), (8000, None), (8001, ""), (8002, "--- !"), (8003, "É 日本 w1 " * 4000)]
    items = [(n, words(rng, 12)) for n in range(25)] + [(100, "same WORDS w1"), (101, None), (102, ""), (103, "nowhere"), (104, "w9"), (104, "É 日本"), (None, "w2 w3")]
    wide = "doc_id bigint, text string, item int, score string"
    return docs, items, spark.createDataFrame([(*d, 1, "x") for d in docs], wide).repartition(4), spark.createDataFrame([(*i, 2) for i in items], "item_id int, text string, rank int")


@pytest.mark.parametrize("small", [False, True])
def test_same_ranking_as_scoring_all(tables, small, monkeypatch):
    if small:  # many shards, deep intervals, several passes
        for name, value in {"SHARD_DOCUMENTS": 100, "SHARD_POSTINGS": 900, "LEAF": 1, "ITEMS_A_PASS": 9, "FIRST_LOOK": 2}.items():
            monkeypatch.setattr(ranked, name, value)
    docs, items, docs_table, items_table = tables
    got = ranked.ranked_search(docs_table, items_table, k=20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == Counter(plain(docs, items, 20))


@pytest.mark.parametrize("leaf", [1, 7, 10_000])
def test_interval_search_of_one_shard(leaf, monkeypatch):
    """Intervals find the same documents as sums over all, with few or many intervals, from any floor."""
    monkeypatch.setattr(ranked, "LEAF", leaf)
    rng = np.random.default_rng(5)
    for size in (1, 2, 50, 700):
        term = np.sort(rng.integers(0, 9, size * 3))
        keyed = np.unique(np.stack([term, rng.integers(0, size, size * 3)]), axis=1)
        value = rng.integers(0, 40, keyed.shape[1])
        shard = ranked.Shard(size, keyed[0], keyed[1], value, 9)
        for wanted in ([0], [1, 4, 8], list(range(9))):
            scores = np.zeros(size, np.int64)
            use = np.isin(keyed[0], wanted)
            np.add.at(scores, keyed[1][use], value[use])
            for k, floor in ((1, 0), (5, 0), (5, 60), (1000, 0)):
                ordered = sorted(((int(s), n) for n, s in enumerate(scores) if s >= max(floor, 1)), reverse=True)
                least = ordered[k - 1][0] if len(ordered) >= k else 1
                found = sorted(shard.best(np.array(wanted), k, floor), reverse=True)
                assert [x for x in found if x[0] >= least] == [x for x in ordered if x[0] >= least]


def test_range_maximum_tables():
    rng = np.random.default_rng(1)
    value = rng.integers(0, 9, 300)
    shard = ranked.Shard(300, np.repeat([0, 1], 150), np.tile(np.arange(150), 2), value, 2)
    lo, hi = np.array([(a, b) for a in range(0, 150, 7) for b in range(a + 1, 151, 5)]).T
    assert (value[shard.greatest(lo, hi)] == [value[a:b].max() for a, b in zip(lo, hi)]).all()


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b")], "item_id int, text string")
    assert ranked.ranked_search(docs, items).collect() == []
    some = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert ranked.ranked_search(some, items.where("false")).collect() == []
    assert len(ranked.ranked_search(some, items).collect()) == 1
