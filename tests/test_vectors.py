"""Vector index: upsert/delete properties and exact top-k against brute force."""

import numpy as np

from conftest import SF001
from pyspark.sql import functions as F
from tokenloom.operators import vectors as V
from tokenloom.plans import domain


def test_upsert_idempotent_and_delete(spark):
    cur = domain.vectors(spark, SF001)
    batch = domain.index_batch(spark, SF001)
    once = V.upsert(cur, batch)
    twice = V.upsert(once, batch)
    key = lambda df: sorted((r.doc_id, r.path) for r in df.select("doc_id", "path").collect())
    assert key(once) == key(twice)
    assert once.count() == once.select("doc_id").distinct().count()
    missing = spark.createDataFrame([("nope",)], "doc_id string")
    assert V.delete(once, missing).count() == once.count()
    gone = V.delete(once, batch.select("doc_id"))
    assert gone.join(batch.select("doc_id"), "doc_id").count() == 0


def test_knn_batch_brute_force(spark):
    vec = domain.vectors(spark, SF001)
    rows = vec.select("doc_id", "path", "embedding").collect()
    X = np.array([r.embedding for r in rows], dtype=np.float64)
    ids = np.array([r.doc_id for r in rows])
    qs = V.centroids(vec, "label").withColumnRenamed("label", "query_id")
    got = {}
    for r in V.knn_batch(vec, qs, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id))
    for q in qs.collect():
        d = ((X - np.array(q.embedding)) ** 2).sum(axis=1)
        order = sorted(range(len(d)), key=lambda i: (round(d[i], 12), ids[i]))[:5]
        assert [i for _, i in sorted(got[q.query_id])] == [ids[i] for i in order]


def test_knn_single_k_larger_than_index(spark):
    vec = domain.vectors(spark, SF001).limit(3)
    out = V.knn_single(vec, [0.0] * 64, 10).collect()
    assert len(out) == 3
    empty = V.knn_single(vec.filter(F.lit(False)), [0.0] * 64, 5).collect()
    assert empty == []


def test_ties_and_rows_without_a_vector(spark, monkeypatch):
    rows = [(f"k{i:03d}", None, [1.0, 0.0] if i < 200 else None if i < 210 else [float(i), 1.0]) for i in range(300)]
    idx = spark.createDataFrame(rows, "doc_id string, path string, embedding array<float>")
    qs = spark.createDataFrame([(i, [1.0, 0.0 if i < 5 else 0.5]) for i in range(9)] + [(99, None)], "query_id long, embedding array<float>")
    monkeypatch.setattr(V, "INDEX_BLOCK", 40)
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    for metric in V.METRICS:
        got = {}
        for r in V.knn_batch(idx, qs, 7, metric).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.distance))
        single = [r.doc_id for r in V.knn_single(idx, [1.0, 0.0], 7, metric).collect()]
        assert sorted(got) == list(range(9))
        assert [i for _, i, _ in sorted(got[0])] == single
        if metric != "ip":
            assert single == [f"k{i:03d}" for i in range(7)]


def test_repeated_key_needs_an_order(spark):
    import pytest

    cur = spark.createDataFrame([("a", "old", 0)], "doc_id string, content string, v int")
    batch = spark.createDataFrame([("b", "one", 1), ("b", "two", 2)], "doc_id string, content string, v int")
    assert {r.content for r in V.upsert(cur, batch, "v").collect()} == {"old", "two"}
    with pytest.raises(Exception, match="repeated key"):
        V.upsert(cur, batch).collect()


def test_hits_show_todays_view_or_the_stored_text(spark):
    """Keys with a path, without one (short, long, null content), and with a path whose file is gone."""
    long = "word " * 200
    rows = [("a", "src/a.py", "old text of a", [0.0, 0.0]), ("b", None, "note of b", [1.0, 0.0]), ("c", None, long, [2.0, 0.0]),
            ("d", "src/gone.py", "old text of d", [3.0, 0.0]), ("e", None, None, [4.0, 0.0]), ("f", "src/a.py", "another key of a", [5.0, 0.0]),
            ("g", None, "far away", [900.0, 0.0])]
    index = spark.createDataFrame(rows, "doc_id string, path string, content string, embedding array<double>")
    queries = spark.createDataFrame([(7, [0.0, 0.0]), (8, [5.0, 0.0])], "query_id long, embedding array<double>")
    hits = V.knn_batch(index, queries, 6)
    views = spark.createDataFrame([("src/a.py", "def f(): ...", "py_outline", 6), ("src/other.py", "x", "stripped", 1)],
                                  "path string, text string, stage string, tokens long")
    got = {(r.query_id, r.doc_id): r for r in V.retrieve(hits, index, views).collect()}
    assert len(got) == 12 and "g" not in {k for _, k in got}
    want = {"a": ("def f(): ...", "py_outline", 6, False), "b": ("note of b", "snippet", 0, False), "c": (long, "snippet", 0, True),
            "d": (None, "missing", 0, False), "e": (None, "snippet", 0, False), "f": ("def f(): ...", "py_outline", 6, False)}
    for (_, key), r in got.items():
        assert (r.text, r.stage, r.tokens, r.is_long) == want[key] and r.query_tokens == 12
    assert [got[7, k].rank for k in "abcdef"] == [1, 2, 3, 4, 5, 6] and [got[7, k].within_max for k in "ef"] == [True, False]
    cut = {r.doc_id: r.text for r in V.retrieve(hits, index, views, 500).collect()}
    assert cut["c"] == long[:500] + "\n...[Content Truncated]" and cut["b"] == "note of b" and cut["a"] == "def f(): ..."
    assert V.retrieve(hits.limit(0), index, views).count() == 0


def test_blocks_without_queries(spark, monkeypatch):
    """More blocks of queries than queries that hash into them."""
    monkeypatch.setattr(V, "QUERY_BLOCK", 1)
    index = spark.createDataFrame([(f"k{i}", None, [float(i)]) for i in range(9)], "doc_id string, path string, embedding array<double>")
    queries = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "query_id long, embedding array<double>")
    got = {(r.query_id, r.doc_id) for r in V.knn_batch(index, queries, 1).collect()}
    assert got == {(i, f"k{i}") for i in range(6)}
