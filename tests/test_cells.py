"""Pruned search by cells against the full search."""

import numpy as np
import pytest

from conftest import SF01
from pyspark.sql import functions as F
from tokenloom.operators import cells
from tokenloom.operators import vectors as V
from tokenloom.plans import domain

ROW, QUERY = "doc_id string, path string, embedding array<float>", "query_id long, embedding array<float>"


def same(spark, index, queries, k, path, pivots):
    cells.build(index, path, pivots)
    hits, report = cells.search(spark, path, queries, k)
    got = {(r.query_id, r["rank"]): (r.doc_id, r.path, r.distance) for r in hits.collect()}
    want = {(r.query_id, r["rank"]): (r.doc_id, r.path, r.distance) for r in V.knn_batch(index, queries, k).collect()}
    assert got == want and got
    return {r.query_id: r for r in report.collect()}


def test_equal_to_the_full_search_and_most_cells_are_skipped(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 50, (40, 6))
    rows = [(f"k{i}", f"p/{i}", [float(x) for x in centres[i % 40] + rng.normal(0, 1, 6)]) for i in range(4000)]
    queries = spark.createDataFrame([(i, [float(x) for x in centres[i] + rng.normal(0, 1, 6)]) for i in range(20)], QUERY)
    report = same(spark, spark.createDataFrame(rows, ROW), queries, 5, f"{tmp_path}/i", 64)
    assert len(report) == 20 and all(r["rows"] == 4000 for r in report.values())
    assert sum(r.rows_read for r in report.values()) < 0.25 * 20 * 4000


@pytest.mark.parametrize("pivots", [1, 7, 500])
def test_ties_null_vectors_dimensions_and_hot_cells(spark, tmp_path, monkeypatch, pivots):
    monkeypatch.setattr(V, "INDEX_BLOCK", 30)
    monkeypatch.setattr(V, "QUERY_BLOCK", 2)
    rows = [(f"k{i:03d}", None if i % 2 else f"p/{i}", [1.0, 0.0] if i < 150 else None if i < 155 else [] if i < 160 else [float(i % 13), 1.0]) for i in range(300)]
    rows += [("d3", "p", [1.0, 2.0, 3.0]), ("nan", "p", [float("nan"), 0.0]), ("far", "p", [1e6, 1e6])]
    queries = spark.createDataFrame([(i, [1.0, 0.0 if i < 5 else 0.5]) for i in range(9)] + [(99, None), (100, [0.0, 0.0, 0.0]), (101, [1.0])], QUERY)
    for k in (7, 1000):
        report = same(spark, spark.createDataFrame(rows, ROW), queries, k, f"{tmp_path}/{pivots}-{k}", pivots)
        assert 99 not in report


def test_given_vectors_and_an_empty_index(spark, tmp_path):
    vec = domain.vectors(spark, SF01)
    queries = V.centroids(vec, "label").withColumnRenamed("label", "query_id")
    same(spark, vec, queries, 5, f"{tmp_path}/g", cells.PIVOTS)
    cells.build(vec.limit(0), f"{tmp_path}/e")
    hits, report = cells.search(spark, f"{tmp_path}/e", queries)
    assert hits.count() == 0 and report.count() == 0
    cells.build(vec, f"{tmp_path}/q")
    assert cells.search(spark, f"{tmp_path}/q", queries.where(F.lit(False)))[0].count() == 0
