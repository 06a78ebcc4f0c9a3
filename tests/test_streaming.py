"""Streaming forms equal their batch forms when micro-batches arrive in time order."""

import os
import tempfile

from conftest import SF001
from pyspark.sql import functions as F
from tokenloom.operators import changes as CH
from tokenloom.operators import ledger
from tokenloom.plans import domain
from tokenloom.streaming import jobs as S


def _split_by_time(df, d, n=3, col="ts"):
    """Write ``df`` as n parquet folders ordered in time (one micro-batch each)."""
    rows = df.withColumn("_u", F.unix_micros(col))
    bounds = rows.approxQuantile("_u", [i / n for i in range(1, n)], 0.0)
    edges = [None] + bounds + [None]
    for i in range(n):
        part = rows
        if edges[i] is not None:
            part = part.filter(F.col("_u") > edges[i])
        if edges[i + 1] is not None:
            part = part.filter(F.col("_u") <= edges[i + 1])
        part.drop("_u").coalesce(1).write.parquet(os.path.join(d, f"part{i}"))
    return [os.path.join(d, f"part{i}") for i in range(n)]


def _stage_files(dirs, target):
    """Move the single data file of each folder into one stream folder, in order."""
    import glob
    import shutil

    os.makedirs(target, exist_ok=True)
    for i, d in enumerate(dirs):
        f = glob.glob(os.path.join(d, "*.parquet"))[0]
        shutil.copy(f, os.path.join(target, f"{i:03d}.parquet"))
        os.utime(os.path.join(target, f"{i:03d}.parquet"), (1_000_000 + i, 1_000_000 + i))


def test_index_sync_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="tl-sync-", dir="/tmp")
    base = domain.vectors(spark, SF001)
    ch = domain.changes(spark, SF001)
    S.write_version(base.select("project", "doc_id", "path", "content", "embedding", "label"), os.path.join(d, "index"), 0)
    _stage_files(_split_by_time(ch, os.path.join(d, "split")), os.path.join(d, "changes"))
    q = S.start_index_sync(spark, os.path.join(d, "changes"), os.path.join(d, "index"),
                           os.path.join(d, "ckpt"), trigger_once=True, max_files=1)
    q.awaitTermination(300)
    final = S.read_version(spark, os.path.join(d, "index"), 3)
    assert S._versions(spark, os.path.join(d, "index"), 3) != S._versions(spark, os.path.join(d, "index"), 0)
    want = CH.sync_index(base, ch)
    key = lambda df: sorted((r.doc_id, r.h) for r in df.select("doc_id", F.sha2("content", 256).alias("h")).collect())
    assert key(final) == key(want)


def test_daily_usage_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="tl-usage-", dir="/tmp")
    usage = domain.usage(spark, SF001).drop("day")
    _stage_files(_split_by_time(usage, os.path.join(d, "split")), os.path.join(d, "in"))
    stream = spark.readStream.schema(S.USAGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(os.path.join(d, "in"))
    q = (S.daily_usage_stream(stream).writeStream.outputMode("update").format("memory")
         .queryName("daily_usage_t").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r.day: r.tokens_used for r in spark.sql(
        "SELECT day, max_by(tokens_used, requests) AS tokens_used FROM daily_usage_t GROUP BY day").collect()}
    want = {r.day: r.tokens_used for r in ledger.budget_status(domain.usage(spark, SF001), fill_days=False).collect()}
    assert got == want


def test_index_store_keeps_names_and_untouched_buckets(spark):
    d = tempfile.mkdtemp(prefix="tl-store-", dir="/tmp")
    rows = spark.createDataFrame([("007", f"k{i}", f"p{i}", "t", [1.0], 1) for i in range(50)], S.INDEX_SCHEMA)
    S.write_version(rows, d, 0, buckets=8)
    some = rows.where(S._bucket("doc_id", 8) == 3).withColumn("content", F.lit("new"))
    S.write_version(some, d, 1, buckets=8, touched=[3])
    got = S.read_version(spark, d, 1).collect()
    assert len(got) == 50 and {r.project for r in got} == {"007"} and sum(r.content == "new" for r in got) == some.count()
    assert sorted(os.listdir(os.path.join(d, "data", "v000000001")))[-1] == "bucket=3"


def test_admission_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="tl-adm-", dir="/tmp")
    usage = domain.usage(spark, SF001).drop("day")
    _stage_files(_split_by_time(usage, os.path.join(d, "split")), os.path.join(d, "in"))
    stream = spark.readStream.schema(S.USAGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(os.path.join(d, "in"))
    for scope, limit, exempt in (((), 1500, ()), (("project",), 120, ("click",))):
        out = os.path.join(d, f"out{len(scope)}")
        q = S.start_admission(stream, out, out + "-totals", out + "-ckpt", limit, scope, exempt, trigger_once=True)
        q.awaitTermination(300)
        got = {r.event_id: (r.used_before, r.admitted) for r in spark.read.parquet(out).collect()}
        want = {r.event_id: (r.used_before, r.admitted) for r in
                ledger.admission(domain.usage(spark, SF001), limit, scope, exempt_sources=exempt).collect()}
        assert got == want and len(got) == 1000


def test_late_rows_are_kept_and_merged(spark, tmp_path):
    """Usage in shuffled files, one a batch: closed days, open days and late rows together are the batch totals."""
    import random

    from pyspark.sql import functions as F
    from tokenloom.streaming import jobs

    rng = random.Random(3)
    rows = [(i, f"2024-01-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:00:00", rng.randint(-5, 90)) for i in range(400)]
    for k in range(4):
        part = spark.createDataFrame(rows[100 * k:100 * k + 100], "event_id long, ts string, tokens long").withColumn("ts", F.col("ts").cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, tokens long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    root = str(tmp_path / "out")
    jobs.start_daily_usage(stream, root, str(tmp_path / "check"), trigger_once=True).awaitTermination()
    got = {str(r.day): (r.tokens_used, r.requests) for r in jobs.daily_usage(spark, root, 4).collect()}
    want = {}
    for _, ts, tokens in rows:
        if tokens > 0:
            used, n = want.get(ts[:10], (0, 0))
            want[ts[:10]] = (used + tokens, n + 1)
    assert got == want
    assert jobs.daily_usage(spark, root, 4).agg(F.sum("late_tokens")).first()[0] > 0
    assert spark.read.parquet(f"{root}/open/v000000004").count() <= 3                 # a batch rewrites open days only
