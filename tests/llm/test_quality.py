from itertools import product

import duckdb
import numpy as np
from pyspark.sql import functions as F

from conftest import SF01
from small import corpus, frame
from tokenloom.llm import quality, queries


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    fld = quality.Field(rng.normal(size=4), rng.normal(size=2), rng.normal(size=(2, 2)), (1.0, 0.0))
    lines = np.array([1, 4, 3, 5])
    x = rng.normal(size=(lines.sum(), 4))
    got, pairs, first = fld.marginals(x, lines, pairs=True)
    at, want_pairs, want_first, want = 0, np.zeros((2, 2)), np.zeros(2), []
    for n in lines:
        e = x[at:at + n] @ fld.weight
        mass, ones, here = 0.0, np.zeros(n), np.zeros((2, 2))
        head = np.zeros(2)
        for y in product((0, 1), repeat=int(n)):
            m = np.exp(fld.start[y[0]] + sum(e[i] for i in range(n) if y[i]) + sum(fld.step[a, b] for a, b in zip(y, y[1:], strict=False)))
            mass += m
            ones += m * np.array(y)
            head[y[0]] += m
            for a, b in zip(y, y[1:], strict=False):
                here[a, b] += m
        want.append(ones / mass)
        want_pairs += here / mass / n
        want_first += head / mass / n
        at += n
    assert np.allclose(got, np.concatenate(want)) and np.allclose(pairs, want_pairs) and np.allclose(first, want_first)


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries.op7_quality(spark, SF01).collect()}
    lab = dict(duckdb.sql(f"select doc_id, quality from '{SF01}/labels.parquet'").fetchall())
    held = [k for k in lab if got[k]["held_out"]]
    assert len(held) > 80 and sum(got[k]["predicted"] == lab[k] for k in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.5) == (r["predicted"] == 1) for r in got.values())


def test_awkward_rows_and_labels(spark):
    rows = corpus()
    lab = spark.createDataFrame([(k, i % 2) for i, (k, _) in enumerate(rows)] + [(None, 1), (7, None), (99999, 1), (7, 0)], "doc_id long, quality int")
    fld = quality.fit(frame(spark, rows), lab)
    out = quality.score(frame(spark, rows), fld)
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    blank = {r["score"] for r in got if not r["text"]}
    assert len(blank) == 1                                # null and empty texts are the same empty line
    alone = {r["doc_id"]: r["score"] for r in quality.score(frame(spark, rows[:3]), fld).collect()}
    assert all(abs(r["score"] - alone[r["doc_id"]]) < 1e-9 for r in got if r["doc_id"] in alone)


def test_one_kind_of_label_or_no_rows(spark):
    lab = spark.createDataFrame([(0, 1), (7, 1)], "doc_id long, quality int")
    assert quality.fit(frame(spark, corpus()), lab) is None
    assert {r["score"] for r in quality.score(frame(spark, corpus()), None).collect()} == {0.5}
    assert quality.score(frame(spark, corpus()).limit(0), None).where(F.col("score") >= 0).count() == 0
