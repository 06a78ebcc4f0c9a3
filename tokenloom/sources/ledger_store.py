"""Ledger sink: append-only Parquet partitioned by UTC day; explicit schema on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import ledger

# Schema of the stored ledger. A ledger written before ``source`` existed reads with the
# column NULL, which ``ledger.as_usage`` turns into the column default 'unknown'.
LEDGER_SCHEMA = "event_id bigint, ts timestamp, tokens bigint, path string, source string, project string, day date"


def append(usage: DataFrame, root: str) -> None:
    """Record usage rows (non-positive tokens are never recorded)."""
    rows = ledger.recorded(ledger.as_usage(usage))
    rows.select(*ledger.USAGE_COLUMNS).write.mode("append").partitionBy("day").parquet(root)


def read(spark: SparkSession, root: str, day: str | None = None) -> DataFrame:
    """The ledger (optionally one UTC day: pruned to that partition folder)."""
    df = spark.read.schema(LEDGER_SCHEMA).parquet(root)
    if day is not None:
        df = df.filter(F.col("day") == F.to_date(F.lit(day)))
    return ledger.as_usage(df)
