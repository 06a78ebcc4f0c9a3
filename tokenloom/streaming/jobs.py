"""Structured Streaming forms of the index sync, daily usage and admission gate.

* ``start_index_sync``: change rows -> ``foreachBatch`` applying the batch sync job to the buckets that a
  micro-batch touches. A bucket's rows lie in an immutable folder per version, and a manifest of one row
  per bucket says which version counts; batch ``b`` reads manifest ``b`` and writes manifest ``b + 1`` last, so a
  replayed batch rewrites the same folders.
* ``daily_usage_stream``: tumbling UTC-day totals with a one-day watermark.
* ``start_daily_usage``: the same totals with nothing lost: rows for days that the watermark has closed go to a side table,
  and ``daily_usage`` merges closed days, open days and late rows. A batch rewrites the open days only.
* ``start_admission``: the order-aware gate as ``foreachBatch``: the batch job's prefix sums on top of a small
  table of totals per (scope, day), versioned like the index. No request is too late for a decision.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import changes as CH
from tokenloom.operators import ledger

CHANGE_SCHEMA = "path string, op string, content string, ts timestamp, seq bigint"
USAGE_SCHEMA = "event_id bigint, ts timestamp, tokens bigint, path string, source string, project string"
INDEX_SCHEMA = "project string, doc_id string, path string, content string, embedding array<float>, label int"
BUCKETS = 64


# ----------------------------------------------------------------------------- index store


def _bucket(doc_id, n: int):
    return F.pmod(F.xxhash64(doc_id), F.lit(n)).cast("int")


def _manifest(root: str, version: int) -> str:
    return f"{root}/manifest/v{version:09d}"


def write_version(df: DataFrame, root: str, version: int, buckets: int = BUCKETS, touched: list[int] | None = None) -> None:
    """Write the given buckets (default: all) of an index as ``version``; the others stay as they are."""
    spark = df.sparkSession
    own = list(range(buckets)) if touched is None else touched
    rows = df.withColumn("bucket", _bucket("doc_id", buckets)).repartition(max(1, len(own)), "bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/v{version:09d}")
    old = {} if touched is None else _versions(spark, root, version - 1)
    now = {**old, **{b: version for b in own}}
    spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(_manifest(root, version))


def _versions(spark: SparkSession, root: str, version: int) -> dict[int, int]:
    return {r["bucket"]: r["version"] for r in spark.read.parquet(_manifest(root, version)).collect()}    # one row a bucket


def read_version(spark: SparkSession, root: str, version: int, schema: str = INDEX_SCHEMA, buckets: list[int] | None = None) -> DataFrame:
    """The index (or some of its buckets) as of a version. The schema is given, so names like ``007`` stay text."""
    of = _versions(spark, root, version)
    want = {}
    for b, v in of.items():
        if buckets is None or b in buckets:
            want.setdefault(v, []).append(b)
    out = spark.createDataFrame([], schema)
    for v, own in sorted(want.items()):
        part = spark.read.schema(schema + ", bucket int").parquet(f"{root}/data/v{v:09d}")
        out = out.unionByName(part.where(F.col("bucket").isin(own)).drop("bucket"))      # only these folders are read
    return out


def start_index_sync(spark: SparkSession, changes_dir: str, index_root: str, checkpoint: str,
                     root_name: str = "workspace", trigger_once: bool = False, max_files: int | None = None,
                     schema: str = INDEX_SCHEMA, buckets: int = BUCKETS):
    """Keep the index at ``index_root`` in step with change files arriving in ``changes_dir``."""
    reader = spark.readStream.schema(CHANGE_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(changes_dir)

    def apply(batch: DataFrame, batch_id: int) -> None:
        own = batch.select(_bucket(F.sha2("path", 256), buckets).alias("b")).where("b is not null").distinct()
        touched = sorted(r["b"] for r in own.collect())       # at most one row a bucket
        cur = read_version(batch.sparkSession, index_root, batch_id, schema, touched)
        write_version(CH.sync_index(cur, batch, root_name=root_name), index_root, batch_id + 1, buckets, touched)

    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="1 second")
    return w.start()


# ----------------------------------------------------------------------------- daily usage


def daily_usage_stream(usage_stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Recorded tokens per UTC day as they arrive. Rows later than the watermark are dropped
    (a rule the stream adds: the batch ledger has no lateness limit)."""
    return (usage_stream.filter(F.col("tokens") > 0)
            .withWatermark("ts", watermark)
            .groupBy(F.window("ts", "1 day").alias("w"))
            .agg(F.sum("tokens").alias("tokens_used"), F.count(F.lit(1)).alias("requests"))
            .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "tokens_used", "requests"))


TOTALS = "day date, tokens_used bigint, requests bigint"


def start_daily_usage(usage_stream: DataFrame, root: str, checkpoint: str, delay_days: int = 1, trigger_once: bool = False):
    """Recorded tokens per UTC day below ``root``. Batch ``b`` reads the open days of version ``b`` and writes those of
    ``b + 1``; days that end ``delay_days`` or more before the latest moment seen are closed and written once (``closed/batch=b``). Rows
    for a day that an earlier batch closed are summed up in ``late/batch=b``. A replayed batch rewrites its own folders."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.where("tokens > 0 and ts is not null").select(F.to_date("ts").alias("day"), "tokens", "ts")
        old, mark = spark.createDataFrame([], TOTALS), None
        if batch_id:
            old = spark.read.schema(TOTALS).parquet(f"{root}/open/v{batch_id:09d}")
            mark = spark.read.schema("mark date").parquet(f"{root}/mark/v{batch_id:09d}").first()["mark"]
        end = F.date_add("day", 1 + delay_days)                         # the last day on which a row is in time
        late = (end <= F.lit(mark)) if mark is not None else F.lit(False)
        sums = rows.groupBy("day").agg(F.sum("tokens").alias("tokens_used"), F.count(F.lit(1)).alias("requests"), F.max("day").alias("seen"))
        sums = sums.withColumn("late", late).persist()                  # one row a day
        try:
            seen = [d for d in (mark, sums.agg(F.max("seen")).first()[0]) if d is not None]
            now = max(seen) if seen else None
            columns = [c.split()[0] for c in TOTALS.split(", ")]
            sums.where("late").select(*columns).write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
            days = old.unionByName(sums.where("not late").select(*columns)).groupBy("day").agg(
                F.sum("tokens_used").cast("bigint").alias("tokens_used"), F.sum("requests").cast("bigint").alias("requests"))
            shut = (end <= F.lit(now)) if now is not None else F.lit(False)
            days.where(shut).write.mode("overwrite").parquet(f"{root}/closed/batch={batch_id}")
            days.where(~shut).write.mode("overwrite").parquet(f"{root}/open/v{batch_id + 1:09d}")
            spark.createDataFrame([(now,)], "mark date").write.mode("overwrite").parquet(f"{root}/mark/v{batch_id + 1:09d}")
        finally:
            sums.unpersist()

    w = usage_stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="1 second")
    return w.start()


def daily_usage(spark: SparkSession, root: str, version: int) -> DataFrame:
    """(day, tokens_used, requests, late_tokens) after the first ``version`` batches."""
    def past(part: str) -> DataFrame:
        return spark.read.schema(TOTALS + ", batch int").parquet(f"{root}/{part}").where(F.col("batch") < version).drop("batch")

    on_time = past("closed").unionByName(spark.read.schema(TOTALS).parquet(f"{root}/open/v{version:09d}")).withColumn("late_tokens", F.lit(0))
    return on_time.unionByName(past("late").withColumn("late_tokens", F.col("tokens_used"))).groupBy("day").agg(
        *(F.sum(c).cast("bigint").alias(c) for c in ("tokens_used", "requests", "late_tokens")))


# ----------------------------------------------------------------------------- admission gate


def start_admission(usage_stream: DataFrame, out: str, totals: str, checkpoint: str, limit=ledger.DEFAULT_DAILY_LIMIT,
                    scope: Sequence[str] = (), exempt_sources: Sequence[str] = (), trigger_once: bool = False):
    """Online admission: within a micro-batch rows are taken in (ts, event_id) order, across
    micro-batches in arrival order. ``totals`` keeps requested tokens per (scope..., day); because that total
    never falls, "running total before < limit" is the same decision as "recorded total before < limit"
    (see ``operators.ledger.admission``). Decisions of batch ``b`` go to ``out/batch=b``."""
    scope = list(scope)
    keys = scope + ["day"]
    fields = ", ".join([*(f"{c} string" for c in scope), "day date", "used bigint"])

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = ledger.as_usage(batch)
        old = spark.read.schema(fields).parquet(f"{totals}/v{batch_id:09d}") if batch_id else spark.createDataFrame([], fields)
        ledger.admission(rows, limit, scope, exempt_sources=exempt_sources, carried=old).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        counted, _ = ledger._counted(exempt_sources)
        new = rows.groupBy(*keys).agg(F.sum(counted).alias("used"))
        old.unionByName(new).groupBy(*keys).agg(F.sum("used").cast("bigint").alias("used")) \
            .write.mode("overwrite").parquet(f"{totals}/v{batch_id + 1:09d}")

    w = usage_stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="1 second")
    return w.start()
