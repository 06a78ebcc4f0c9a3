"""The versioned index sink equals a plain dictionary per version, and a version never changes once it is there."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.sources import index_store as S

SCHEMA = "project string, doc_id string, content string, n int"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def _held(state):
    return sorted(state.values(), key=repr)


def test_versions_equal_a_dictionary(spark, tmp_path):
    rng, root = random.Random(5), str(tmp_path / "ix")
    projects = [None, "", "007", "a b", "x=1/y%", "hot", "hot", "hot"]

    def some(n):
        rows = {}
        for _ in range(n):
            p, d = rng.choice(projects), f"d{rng.randrange(60)}"
            rows[p, d] = (p, d, rng.choice([None, "", "text", "ein Satz"]), rng.randrange(9))
        return rows

    state = some(80)
    assert S.replace(_frame(spark, _held(state)), root, buckets=4) == 0
    seen = [dict(state)]
    for step in range(1, 5):
        if step % 2:
            batch = some(12)
            assert S.upsert(_frame(spark, _held(batch)), root, SCHEMA, buckets=4) == step
            state |= batch
        else:
            keys = rng.sample(sorted(state, key=repr), 15) + [("nobody", "d1"), (None, None)]
            assert S.delete(_frame(spark, keys, "project string, doc_id string"), root, SCHEMA, buckets=4) == step
            state = {k: v for k, v in state.items() if k not in keys}
        seen.append(dict(state))
    assert S.versions(spark, root) == [0, 1, 2, 3, 4]
    for v, want in enumerate(seen):                    # also the old ones, after all later writes
        assert _rows(S.read(spark, root, SCHEMA, v)) == _held(want)
    for p in ("", "007", "x=1/y%", "nobody"):
        assert _rows(S.read(spark, root, SCHEMA, project=p)) == sorted((r for k, r in state.items() if k[0] == p), key=repr)


def test_a_reader_keeps_its_version_and_untouched_places_are_not_rewritten(spark, tmp_path):
    root = str(tmp_path / "ix")
    S.replace(_frame(spark, [(p, f"d{i}", "old", i) for p in "ab" for i in range(40)]), root, buckets=8)
    reader = S.read(spark, root, SCHEMA, 0)
    S.upsert(_frame(spark, [("a", "d3", "new", 3)]), root, SCHEMA, buckets=8)
    assert reader.where("content = 'old'").count() == 80
    now = S.read(spark, root, SCHEMA)
    assert _rows(now.where("content = 'new'")) == [("a", "d3", "new", 3)] and now.count() == 80
    written = [d for d, _, names in os.walk(f"{root}/data/in_version=1") if any(n.endswith(".parquet") for n in names)]
    assert len(written) == 1 and "/in_project=pa/" in written[0]


def test_unfinished_write_is_no_version(spark, tmp_path):
    root = str(tmp_path / "ix")
    S.replace(_frame(spark, [("a", "d1", "x", 1)]), root)
    _frame(spark, [("a", "d9", "junk", 9)]).withColumns(S._place(S.BUCKETS)).write.partitionBy(*S.PLACE).parquet(S._folder(root, 1))
    os.makedirs(S._manifest(root, 1))
    assert S.versions(spark, root) == [0]
    assert S.upsert(_frame(spark, [("a", "d2", "y", 2)]), root, SCHEMA) == 1
    assert _rows(S.read(spark, root, SCHEMA)) == [("a", "d1", "x", 1), ("a", "d2", "y", 2)]


def test_expire_lists_what_it_removes(spark, tmp_path):
    root = str(tmp_path / "ix")
    S.replace(_frame(spark, [("a", f"d{i}", "v0", i) for i in range(30)]), root, buckets=4)
    for v in (1, 2, 3):
        S.upsert(_frame(spark, [("a", "d5", f"v{v}", v)]), root, SCHEMA, buckets=4)
    want = {v: _rows(S.read(spark, root, SCHEMA, v)) for v in (1, 3)}
    assert _rows(S.expire(spark, root, [1])) == [("data", 2), ("manifest", 0), ("manifest", 2)]      # rows of 0 still count
    assert {v: _rows(S.read(spark, root, SCHEMA, v)) for v in (1, 3)} == want
    with pytest.raises(ValueError):
        S.read(spark, root, SCHEMA, 2)
    assert S.compact(spark, root, SCHEMA) == 4
    assert _rows(S.expire(spark, root, [])) == [("data", 0), ("data", 1), ("data", 3), ("manifest", 1), ("manifest", 3)]
    assert sorted(os.listdir(f"{root}/data")) == ["in_version=4"] and _rows(S.read(spark, root, SCHEMA)) == want[3]


def test_keys_and_empty_batches(spark, tmp_path):
    root = str(tmp_path / "ix")
    none = _frame(spark, [])
    with pytest.raises(ValueError):
        S.read(spark, root, SCHEMA)
    assert S.upsert(none, root, SCHEMA) == 0 and S.read(spark, root, SCHEMA).count() == 0
    twice = _frame(spark, [("a", "d1", "x", 1), ("a", "d1", "y", 2), ("a", "d1", "z", None)])
    with pytest.raises(Exception, match="repeated key"):
        S.upsert(twice, root, SCHEMA)
    with pytest.raises(Exception, match="no doc_id"):
        S.upsert(_frame(spark, [("a", None, "x", 1)]), root, SCHEMA)
    assert S.upsert(twice, root, SCHEMA, order_col="n") == 1
    assert _rows(S.read(spark, root, SCHEMA)) == [("a", "d1", "y", 2)]
    assert S.upsert(none, root, SCHEMA) == 2 and S.delete(none.select("project", "doc_id"), root, SCHEMA) == 3
    assert S.delete(_frame(spark, [("a", "d1")], "project string, doc_id string"), root, SCHEMA) == 4
    assert S.read(spark, root, SCHEMA).count() == 0 and S.read(spark, root, SCHEMA, 3).count() == 1


def test_one_project_reads_its_own_folders(spark, tmp_path):
    root = str(tmp_path / "ix")
    S.replace(spark.range(4000).select(F.concat(F.lit("p"), F.col("id") % 20).alias("project"), F.col("id").cast("string").alias("doc_id"),
                                       F.lit("t").alias("content"), F.col("id").cast("int").alias("n")), root, buckets=4)
    one = S.read(spark, root, SCHEMA, project="p3")
    assert one.count() == 200 and len(one.inputFiles()) >= 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(in_project" in plan and "pp3" in plan
