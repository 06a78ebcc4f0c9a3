"""Operator 13 against scores computed one document at a time."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from small import corpus, frame, tables
from tokenloom.llm import queries, treap_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({c: c + 32 for c in range(65, 91)})


def terms(text):
    return Counter(TERM.findall((text or "").translate(FOLD)))


def scores(docs, text):
    """(score, id) of every document with a score above 0."""
    bags = [(i, terms(t)) for i, t in docs]
    total = sum(1 for _, b in bags if b)
    length = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for i, bag in bags:
        if not bag:
            continue
        m = 75 + (25 * sum(bag.values()) * total) // length
        s = sum(k * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                for t, k in terms(text).items() if t in bag)
        if s > 0:
            out.append((s, i))
    return out


def first(docs, text, k=20):
    order = sorted(scores(docs, text), key=lambda x: (-x[0], x[1] is not None, x[1] or 0))[:k]
    return [(r + 1, i, s) for r, (s, i) in enumerate(order)]


ITEMS = [(0, "abc ABC abc é1"), (1, None), (2, ""), (3, "one two x"), (4, "... !!"), (5, "nowhere at-all"), (6, "ab ab ab bb ca"), (0, "x X"), (7, "ñ")]


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_query_equals_brute_force(spark, tmp_path):
    rows = corpus(n=150)
    items = [*ITEMS, *((100 + k, t) for k, (_, t) in enumerate(rows[:12]))]
    bench = spark.createDataFrame([*items, items[3]], "item_id long, text string").selectExpr("*", "1 as key", "2 as score", "3 as weight")
    sf = tables(spark, tmp_path, documents=frame(spark, rows).repartition(3), benchmark=bench)
    want = {}
    for i, t in items:
        if top := first(rows, t):
            want.setdefault(i, []).extend(top)
    assert result(queries.op13_treap_search(spark, sf)) == {k: sorted(v, key=str) for k, v in want.items()}


def test_small_shards_and_blocks(spark, monkeypatch):
    """Several shards a task, waves of two states, and a pass for nearly every item give the same."""
    rows = corpus(seed=8, n=90)
    docs, items = frame(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = result(treap_search.search(docs, items, 5))
    monkeypatch.setattr(treap_search, "SHARD", 3000)
    monkeypatch.setattr(treap_search, "WAVE", 2)
    assert result(treap_search.search(docs.repartition(2), items, 5, block_terms=2)) == whole


@pytest.mark.parametrize("seed", range(6))
def test_treap_holds_every_point_and_finds_the_best(seed):
    rng = np.random.default_rng(seed)
    n_rows, n_cols = int(rng.integers(1, 300)), int(rng.integers(1, 70))
    at = rng.choice(n_rows * n_cols, int(rng.integers(1, n_rows * n_cols + 1)), replace=False)
    grid = np.zeros((n_rows, n_cols), np.int64)
    grid.ravel()[at] = rng.integers(1, 9, len(at))
    row, col = np.nonzero(grid)
    treap = treap_search.Treap.build(row, col, grid[row, col])
    assert len(treap.masks) == len(row)
    treap.impacts, treap.masks = treap.impacts.astype(np.int64), treap.masks.astype(np.int64)
    treap.open()
    assert sorted(zip(treap.row, treap.col, treap.impacts, strict=True)) == sorted(zip(row, col, grid[row, col], strict=True))
    for _ in range(10):
        rows = rng.choice(n_rows, min(n_rows, 5), replace=False)
        weights, k = rng.integers(1, 4, len(rows)), int(rng.integers(1, 8))
        score = weights @ grid[rows]
        least = max(1, int(np.sort(score)[-k])) if n_cols > k else 1
        got = dict(zip(*treap.top(rows, weights, n_cols, k), strict=True))
        assert got == {c: score[c] for c in np.flatnonzero(score >= least)}


def test_ties_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(5, "one two"), (3, "One two"), (None, "one, two"), (3, "one two"), (9, None), (8, "three"), (1, "four five")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string")
    got = result(treap_search.search(docs, items))[1]
    assert [(r, i) for r, i, _ in sorted(got)] == [(1, None), (2, 3), (3, 3), (4, 5)] and len({s for _, _, s in got}) == 1
    assert treap_search.search(docs.limit(0), items).count() == 0
    assert treap_search.search(docs, items.limit(0)).count() == 0


def test_long_text_is_searched_whole(spark):
    rng = random.Random(2)
    long = " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300_000))
    rows = [(1, long + " needle"), (2, "needle in hay"), (3, "hay")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "needle")], "item_id long, text string")
    assert result(treap_search.search(docs, items))[1] == [(1, 2, got) for got in [first(rows, "needle")[0][2]]] + first(rows, "needle")[1:]
