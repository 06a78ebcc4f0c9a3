"""Token ledger: daily totals, limits, order-aware admission and severity.

The ledger is an append-only table ``usage(event_id, ts, tokens, path, source, project)``
partitioned by ``day``. Every job here is a declarative DataFrame plan: hash aggregation
with partial (map-side) combine for the totals, and a two-level prefix sum for admission so
that one busy day or project never lands in a single window partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.session import stored

# ---------------------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------------------
DEFAULT_DAILY_LIMIT = 200_000
DEFAULT_SOURCE = "unknown"          # column default of the ledger's `source`
SEVERITY_YELLOW_ABOVE = 75          # percent
SEVERITY_RED_ABOVE = 90             # percent
BLOCKED_MESSAGE = "Daily token limit reached (%d / %d)."
# ---------------------------------------------------------------------------------------

USAGE_COLUMNS = ["event_id", "ts", "tokens", "path", "source", "project", "day"]


def as_usage(df: DataFrame) -> DataFrame:
    """Normalise a ledger frame: typed columns, UTC day, ``source`` default.

    A ledger written before ``source`` existed reads with the column NULL; it reads back as
    ``'unknown'`` like the additive column default.
    """
    cols = set(df.columns)
    ts = F.col("ts").cast("timestamp")
    return df.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        ts.alias("ts"),
        F.col("tokens").cast("bigint").alias("tokens"),
        (F.col("path") if "path" in cols else F.lit(None)).cast("string").alias("path"),
        F.coalesce(F.col("source") if "source" in cols else F.lit(None).cast("string"),
                   F.lit(DEFAULT_SOURCE)).alias("source"),
        (F.col("project") if "project" in cols else F.lit("global")).cast("string").alias("project"),
        F.to_date(ts).alias("day"),
    )


def recorded(usage: DataFrame) -> DataFrame:
    """Rows the ledger keeps: non-positive token counts are never recorded."""
    return usage.filter(F.col("tokens") > 0)


def _limit_frame(usage: DataFrame, limit, scope: Sequence[str]) -> tuple[DataFrame, Column]:
    """Attach ``daily_limit``: a constant, or a (scope..., daily_limit) frame joined on scope.

    A limits frame is joined by key; AQE turns the join into a broadcast only when the
    measured size of the limits side is under the broadcast threshold.
    """
    if isinstance(limit, DataFrame):
        if not scope:
            raise ValueError("a limits table needs a scope to join on; for limits of projects on one shared total use admission_shared")
        own = limit.groupBy(*scope).agg(F.min("daily_limit").cast("bigint").alias("daily_limit"))
        keyed = usage.join(own, list(scope), "left")
        return keyed, F.coalesce(F.col("daily_limit"), F.lit(DEFAULT_DAILY_LIMIT).cast("bigint"))
    return usage, F.lit(int(limit)).cast("bigint")


def percentage(used: Column, limit: Column) -> Column:
    """used / limit * 100, 0 when the limit is 0 (guarded for ANSI division)."""
    return F.when(limit != 0, (used / limit) * F.lit(100)).otherwise(F.lit(0.0))


def severity(used: Column, limit: Column) -> Column:
    """green / yellow above 75 % / red above 90 % (percentage 0 unless limit > 0)."""
    pct = F.when(limit > 0, (used / limit) * F.lit(100)).otherwise(F.lit(0.0))
    return (F.when(pct > SEVERITY_RED_ABOVE, "red")
            .when(pct > SEVERITY_YELLOW_ABOVE, "yellow")
            .otherwise("green"))


def day_spine(usage: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Every day between the first and last ledger day (per scope), so quiet days report 0."""
    bounds = usage.groupBy(*scope).agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    return bounds.select(*scope, F.explode(F.sequence("d0", "d1")).alias("day"))


def budget_status(usage: DataFrame, limit=DEFAULT_DAILY_LIMIT, scope: Sequence[str] = (),
                  fill_days: bool = True) -> DataFrame:
    """Budget status per (scope..., day): used, limit, remaining, percentage, blocked, message.

    ``scope=()`` is the reference's single global total; ``scope=("project",)`` gives every
    project its own total.
    """
    scope = list(scope)
    rec = recorded(usage)
    daily = rec.groupBy(*scope, "day").agg(F.sum("tokens").alias("tokens_used"))
    if fill_days:
        daily = day_spine(rec, scope).join(daily, scope + ["day"], "left")
    daily, lim = _limit_frame(daily, limit, scope)
    used = F.coalesce(F.col("tokens_used"), F.lit(0)).cast("bigint")
    return daily.select(
        *scope,
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        used.alias("tokens_used"),
        lim.alias("daily_limit"),
        F.greatest(F.lit(0).cast("bigint"), lim - used).alias("remaining"),
        percentage(used, lim).alias("percentage"),
        (used >= lim).alias("blocked"),
        F.when(used >= lim, F.format_string(BLOCKED_MESSAGE, used, lim)).alias("message"),
        severity(used, lim).alias("severity"),
    )


def status_as_of(usage: DataFrame, as_of: Column | None = None, limit=DEFAULT_DAILY_LIMIT,
                 scope: Sequence[str] = ()) -> DataFrame:
    """What is left on the UTC day of ``as_of`` (default: now): rows of that day up to that moment count. A
    scope of the ledger without such rows has 0 used; the global scope always has its row."""
    scope = list(scope)
    at = F.current_timestamp() if as_of is None else as_of.cast("timestamp")
    today = (F.col("day") == F.to_date(at)) & (F.col("ts") <= at)
    rec = usage.withColumn("_t", F.when(today & (F.col("tokens") > 0), F.col("tokens")))
    daily = rec.groupBy(*scope).agg(F.coalesce(F.sum("_t"), F.lit(0)).alias("tokens_used"))
    daily, lim = _limit_frame(daily, limit, scope)
    used = F.col("tokens_used").cast("bigint")
    return daily.select(
        *scope, F.date_format(at, "yyyy-MM-dd").alias("day"), used.alias("tokens_used"), lim.alias("daily_limit"),
        F.greatest(F.lit(0).cast("bigint"), lim - used).alias("remaining"), percentage(used, lim).alias("percentage"),
        (used >= lim).alias("blocked"), F.when(used >= lim, F.format_string(BLOCKED_MESSAGE, used, lim)).alias("message"),
        severity(used, lim).alias("severity"))


def _prefix_sums(rows: DataFrame, keys: list[str], amount: str, out: str, bucket_seconds: int) -> DataFrame:
    """``out``: sum of ``amount`` over the earlier rows of the same keys in (ts, event_id) order.

    Two levels, so that no single window partition holds a whole hot day: (1) totals per time bucket, a
    partial/final hash aggregation; (2) exclusive running offsets over the small bucket table; (3) a running
    sum inside each bucket, joined to its offset on the same keys (the join reuses the window's hash
    partitioning for the large side).
    """
    base = rows.withColumn("_bucket", F.floor(F.unix_micros("ts") / F.lit(bucket_seconds * 1_000_000)).cast("bigint"))
    buckets = base.groupBy(*keys, "_bucket").agg(F.sum(amount).alias("_bt"))
    w_b = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(*keys, "_bucket", F.coalesce(F.sum("_bt").over(w_b), F.lit(0)).cast("bigint").alias("_off"))
    w_in = (Window.partitionBy(*keys, "_bucket").orderBy("ts", "event_id")
            .rowsBetween(Window.unboundedPreceding, -1))
    inner = base.withColumn("_in", F.coalesce(F.sum(amount).over(w_in), F.lit(0)).cast("bigint"))
    return (inner.join(offsets, keys + ["_bucket"], "inner")
            .withColumn(out, (F.col("_off") + F.col("_in")).cast("bigint")).drop("_off", "_in", "_bucket"))


def _counted(exempt_sources: Sequence[str]) -> tuple[Column, Column]:
    """(tokens that count, the request is exempt): exempt sources are neither checked nor recorded."""
    exempt = F.coalesce(F.col("source").isin(list(exempt_sources)), F.lit(False)) if exempt_sources else F.lit(False)
    return F.when(exempt, F.lit(0)).otherwise(F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0))).cast("bigint"), exempt


def admission(requests: DataFrame, limit=5_000, scope: Sequence[str] = (),
              bucket_seconds: int = 60, exempt_sources: Sequence[str] = (), carried: DataFrame | None = None) -> DataFrame:
    """Order-aware admission of requests against a daily limit.

    A request is admitted iff the tokens already recorded in its (scope, UTC day) are below
    the limit; admitted requests may overshoot; blocked requests record nothing; requests
    with tokens <= 0 record nothing either. Because recorded totals never decrease, this is
    exactly ``exclusive prefix sum of greatest(tokens, 0) < limit`` in (ts, event_id) order.

    Sources in ``exempt_sources`` are neither checked nor recorded. ``carried`` (scope..., day, used) holds
    totals recorded before these requests, as a stream carries them.
    """
    scope = list(scope)
    keys = scope + ["day"]
    t, exempt = _counted(exempt_sources)
    joined = _prefix_sums(requests.withColumn("_t", t), keys, "_t", "_before", bucket_seconds)
    if carried is not None:
        joined = joined.join(carried.select(*keys, F.col("used").alias("_used")), keys, "left")
        joined = joined.withColumn("_before", F.col("_before") + F.coalesce("_used", F.lit(0)))
    joined, lim = _limit_frame(joined, limit, scope)
    return joined.select(
        "event_id", *scope,
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        "tokens",
        F.col("_before").cast("bigint").alias("used_before"),
        lim.alias("daily_limit"),
        (exempt | (F.col("_before") < lim)).alias("admitted"),
    )


def _mark_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a (day, bucket) from its (limit, sum, largest) rows in ascending order: the least total at its start, whether a limit of
    the bucket may be passed inside it (``limits`` names those), and the sum that surely counts where none is."""
    day, low, high = None, 0, 0
    bucket, classes = None, []

    def close() -> dict:
        nonlocal low, high
        open_ = [c for c in classes if c[0] > low]
        top = high
        if open_:      # whoever is admitted last stood below its limit
            top = min(high + sum(c[1] for c in open_), max(high, max(c[0] - 1 + c[2] for c in open_)))
        between = [c[0] for c in open_ if c[0] <= top]
        sure = sum(c[1] for c in open_ if c[0] > top)
        out = {"day": day, "bucket": bucket, "low": low, "limits": between, "sure": sure}
        least, rest = low + sure, sum(c[1] for c in open_)
        for limit, total, _ in open_:      # the total reaches the limit, or all requests of at least this limit count
            least = max(least, min(limit, low + rest))
            rest -= total
        low, high = least, top
        return out

    for b in batches:
        out = []
        for d, k, limit, total, largest in zip(*(b.column(c).to_pylist() for c in ("day", "bucket", "limit", "total", "largest"))):
            if (d, k) != (day, bucket):
                if bucket is not None:
                    out.append(close())
                if d != day:
                    low = high = 0
                day, bucket, classes = d, k, []
            classes.append((limit, total, largest))
        yield pa.RecordBatch.from_pylist(out, _MARKS_ARROW)
    if bucket is not None:
        yield pa.RecordBatch.from_pylist([close()], _MARKS_ARROW)


def _walk_day(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact total at the start of every bucket (a row without a limit), and the request that passes a limit inside a bucket."""
    day, used, pending = None, 0, []
    for b in batches:
        out = []
        for d, k, limits, sure, at, event, limit, t in zip(*(b.column(c).to_pylist() for c in
                                                             ("day", "bucket", "limits", "sure", "at", "event_id", "limit", "t"))):
            if limits is not None:
                used = used if d == day else 0
                day, pending = d, limits[::-1]
                while pending and pending[-1] <= used:
                    pending.pop()
                out.append({"day": d, "bucket": k, "limit": None, "at": None, "event_id": None, "used": used})
                # with limits in reach the requests follow one by one, those that surely count included
                used += 0 if limits else sure
            elif used < limit:
                used += t
                while pending and pending[-1] <= used:
                    out.append({"day": d, "bucket": k, "limit": pending.pop(), "at": at, "event_id": event, "used": used})
        yield pa.RecordBatch.from_pylist(out, _POINTS_ARROW)


_MARKS_ARROW = pa.schema([("day", pa.date32()), ("bucket", pa.int64()), ("low", pa.int64()), ("limits", pa.list_(pa.int64())), ("sure", pa.int64())])
_MARKS = "day date, bucket bigint, low bigint, limits array<bigint>, sure bigint"
_POINTS_ARROW = pa.schema([("day", pa.date32()), *((c, pa.int64()) for c in ("bucket", "limit", "at", "event_id", "used"))])
_POINTS = "day date, bucket bigint, limit bigint, at bigint, event_id bigint, used bigint"


def admission_shared(requests: DataFrame, limits: DataFrame, by: str = "project", default_limit: int = DEFAULT_DAILY_LIMIT,
                     bucket_seconds: int = 60, exempt_sources: Sequence[str] = ()) -> DataFrame:
    """Admission where every project has its own limit (``by``, daily_limit) on one shared daily total.

    A request that a small limit blocks must not count against a larger one, so one prefix sum does not do. The
    shared total never falls, and a day passes each limit once, so nearly all time buckets pass none: there the requests
    of the limits above the total count, and a sum a bucket says all. Three passes, whatever the number of limits:

    1. sums by (day, bucket, limit), walked in order with a lower and an upper bound of the total, tell the buckets inside
       which a limit may be passed;
    2. the other buckets' sums and those buckets' requests (without those of limits passed before), in order, give the exact total at
       each bucket's start and the request that passes a limit;
    3. every request is judged and its total before it summed inside its bucket.

    The first two walk a day in one task, in sorted batches: it holds a bucket's limits, and reads buckets times
    limits rows and the requests of the marked buckets. The third is dealt out by (day, bucket). ``event_id`` is unique; a request without a
    time has no day and is left out; null, zero and negative tokens count 0.
    """
    own = limits.groupBy(by).agg(F.min("daily_limit").cast("bigint").alias("_own"))
    t, exempt = _counted(exempt_sources)
    rows = (requests.where(F.col("day").isNotNull()).withColumns({"_t": t, "_exempt": exempt}).join(own, by, "left")
            .withColumn("_lim", F.coalesce("_own", F.lit(default_limit).cast("bigint"))).drop("_own")
            .withColumn("_bucket", F.floor(F.unix_micros("ts") / F.lit(bucket_seconds * 1_000_000)).cast("bigint")))
    # exempt requests stand under a limit of 0, which never counts, so that their buckets have a start too
    judged = rows.select("day", F.col("_bucket").alias("bucket"), F.when(F.col("_exempt"), F.lit(0)).otherwise(F.col("_lim")).cast("bigint").alias("limit"),
                         F.unix_micros("ts").alias("at"), "event_id", F.col("_t").alias("t"))
    sums = judged.groupBy("day", "bucket", "limit").agg(F.sum("t").alias("total"), F.max("t").alias("largest"))
    marks = stored(sums.repartition("day").sortWithinPartitions("day", "bucket", "limit").mapInArrow(_mark_buckets, _MARKS), "marks")

    near = marks.where(F.size("limits") > 0).select("day", "bucket", "low")
    close = judged.where("t > 0").join(near, ["day", "bucket"]).where("`limit` > low").drop("low")
    stops = marks.select("day", "bucket", "limits", "sure").unionByName(close, allowMissingColumns=True)
    points = stored(stops.repartition("day").sortWithinPartitions("day", "bucket", F.col("at").asc_nulls_first(), "event_id")
                    .select("day", "bucket", "limits", "sure", "at", "event_id", "limit", "t").mapInArrow(_walk_day, _POINTS), "points")

    starts = points.where("`limit` is null").select("day", F.col("bucket").alias("_bucket"), F.col("used").alias("_start"))
    passed = points.where("`limit` is not null").select("day", F.col("bucket").alias("_bucket"), F.col("limit").alias("_lim"),
                                                        F.struct("at", "event_id").alias("_end"))
    open_ = (F.col("_lim") > F.col("_start")) & F.coalesce(F.struct(F.unix_micros("ts").alias("at"), "event_id") <= F.col("_end"), F.lit(True))
    earlier = Window.partitionBy("day", "_bucket").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.sum(F.when(F.col("admitted"), F.col("_t")).otherwise(F.lit(0).cast("bigint"))).over(earlier)
    out = (rows.join(starts, ["day", "_bucket"]).join(passed, ["day", "_bucket", "_lim"], "left").withColumn("admitted", F.col("_exempt") | open_)
           .withColumn("used_before", (F.col("_start") + F.coalesce(inside, F.lit(0))).cast("bigint")))
    return out.select("event_id", by, F.date_format("day", "yyyy-MM-dd").alias("day"), "tokens", "used_before",
                      F.col("_lim").alias("daily_limit"), "admitted")


def admitted_ledger(requests: DataFrame, limit=5_000, scope: Sequence[str] = (), exempt_sources: Sequence[str] = ()) -> DataFrame:
    """Ledger rows written by admitted requests with positive tokens (exempt sources write none)."""
    if exempt_sources:
        requests = requests.where(~F.col("source").isin(list(exempt_sources)))
    adm = admission(requests, limit, scope).filter("admitted AND tokens > 0").select("event_id")
    return requests.join(adm, "event_id", "left_semi")


def usage_by_source(usage: DataFrame) -> DataFrame:
    """Recorded tokens by (day, source) with day subtotals and a grand total (ROLLUP)."""
    rec = recorded(usage).withColumn("day_s", F.date_format("day", "yyyy-MM-dd"))
    return (rec.rollup("day_s", "source")
            .agg(F.sum("tokens").cast("bigint").alias("tokens"),
                 F.count(F.lit(1)).alias("requests"),
                 F.grouping_id().cast("int").alias("level"))
            .withColumnRenamed("day_s", "day"))
