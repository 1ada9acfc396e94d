"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelwise.llm import ranked_search as R


def words(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, items, k):
    docs = [(d, Counter(words(t))) for d, t in docs if d is not None]
    n_of = [sum(c.values()) for _, c in docs]
    N, L = sum(n > 0 for n in n_of), sum(n_of)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(words(t))
    out = []
    for i, q in asked.items():
        rows = []
        for (d, c), n in zip(docs, n_of):
            m = 100 - 25 + (25 * n * N) // max(L, 1)
            s = sum(r * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, r in q.items() if c[t])
            if s > 0:
                rows.append((-s, d))
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


def corpus(rng, n):
    vocab = [f"w{i}" for i in range(60)] + ["Ünï", "A_b", "x-y", "DE", "de"]
    weight = [1 / (i + 1) for i in range(len(vocab))]
    rows = [(rng.randrange(n), " ".join(rng.choices(vocab, weight, k=rng.randrange(0, 60)))) for _ in range(n)]
    return rows + [(n + 1, None), (n + 2, ""), (n + 3, "\x00 .. __"), (None, "w1 w2"), (n + 4, "w1 " * 3000), *rows[:10]]


@pytest.mark.parametrize("seed,k,queries,block", [(1, 3, 2000, 16), (2, 20, 4, 50), (3, 5, 7, 8192)])
def test_equals_scoring_all(spark, seed, k, queries, block):
    rng = random.Random(seed)
    docs = corpus(rng, 300)
    items = [(i, " ".join(rng.choices(["w1", "w2", "w9", "w30", "w59", "ÜNï", "none", "de", "a", "w1"], k=rng.randrange(0, 12))))
             for i in range(12)] + [(3, "w5 w5"), (None, "w1"), (50, None), (51, "none")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS block", "3 AS query").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank")
    got = sorted(tuple(r) for r in R.search(d, q, k, queries, block).select("item_id", "rank", "doc_id", "score").collect())
    assert got == plain(docs, items, k)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert R.search(none, items).count() == 0
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert R.search(some, items.limit(0)).count() == 0 and R.search(some, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_pair_bounds_are_tighter_and_hold():
    """Terms that never meet are worth the larger maximum; a pair is worth no more than both and no less than any document."""
    plan = R.Plan([0], [b"a", b"b"], np.array([5, 5]), [np.array([0, 1])], [np.array([2, 1])], np.array([[0, 1]]), [np.array([0])], 9, 9)
    assert R._unit_bounds(np.array([10, 7, -1]), plan, 0).tolist() == [20]
    assert R._unit_bounds(np.array([10, 7, 12]), plan, 0).tolist() == [22]
    assert R._unit_bounds(np.array([10, 7, 17]), plan, 0).tolist() == [27]


def test_skips_documents_below_the_floor():
    """With a floor that only pairs reach, documents of the common term alone are never candidates."""
    plan = R.Plan([0], [b"a", b"b"], np.array([1, 1]), [np.array([0, 1])], [np.array([1, 1])], np.array([[0, 1]]), [np.array([0])], 9, 9)
    lists = {0: (np.array([1]), np.array([50])), 1: (np.arange(9), np.full(9, 10))}
    places, score = R._search_block(lists, 9, np.array([50, 10, 60]), plan, 0, 55)
    assert places.tolist() == [1] and score.tolist() == [60]
    assert not len(R._search_block(lists, 9, np.array([50, 10, 60]), plan, 0, 61)[0])


def test_blocks_are_neither_joined_nor_held_as_arrays(spark):
    """What grows with the input stays in its task: before, blocks met their maxima in a join, and in the JVM as arrays."""
    rng = random.Random(4)
    docs, items = corpus(rng, 200), [(i, f"w1 w{i} DE") for i in range(9)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = R.build_index(d, 16)
    assert {t for c, t in index.dtypes if c not in ("block", "ids", "lengths")} == {"binary"}
    found = R.search_index(index, spark.createDataFrame(items, "item_id long, text string"), 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # the names of queries
    assert sorted(map(tuple, found.collect())) == plain(docs, items, 5)


@pytest.mark.parametrize("x,size", [([], 1), ([0], 1), ([255, 0], 1), ([256], 2), ([65535], 2), ([65536, 1], 4), ([1 << 32], 8), ([(1 << 62) + 3, 7], 8)])
def test_packed_numbers(x, size):
    raw = R._packed(np.array(x, np.int64))
    batch = pa.RecordBatch.from_arrays([pa.array([b"odd", raw], pa.binary())], ["c"])
    assert len(raw) == size * len(x) + 1 and R._numbers(batch, 1, "c").tolist() == x
