"""Session construction, the shared checkpoint folder and the input spread."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC days (the ledger's day is a UTC day), AQE for runtime
# re-planning (broadcast conversion behind a measured size, skew-join splitting, partition
# coalescing) and Arrow for the few pandas steps.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
# Number of partitions to deal a text table into before heavy work on each row. Unset (the default)
# leaves the scan's own splits; a test or bench that reads one small file on many cores sets it.
INPUT_PARTITIONS = "spark.tokenloom.inputPartitions"
# Spark's setting that removes a query's shuffle files when the query has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Work on a stored table is cut into rounds of about this many bytes of it, so that the shuffle files of one round are on disk at a time.
ROUND_BYTES, MAX_ROUNDS = 32 << 20, 16


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tokenloom", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above.

    Master and memory are the submission's business: they are set here only where the caller names a
    master, as tests and the bench do.
    """
    b = SparkSession.builder.appName(app_name)
    conf = dict(BASE_CONF)
    if master:
        b = b.master(master)
        conf |= {"spark.driver.memory": "16g", "spark.driver.extraJavaOptions": "-Xss16m"}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf |= extra or {}
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, registered for ``checkpoint()``.

    A cluster has to name one; only a local master gets a scratch folder.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        d = tempfile.mkdtemp(prefix="tokenloom-ckpt-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


def spread(df: DataFrame, *keys: str, heavy: bool = False) -> DataFrame:
    """Deal rows into the number of partitions that the session asks for (see INPUT_PARTITIONS). ``heavy`` rows, on which each
    far more is done than read, are dealt out without the setting too: a table of few MB is a single split of the scan."""
    n = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    if not n and heavy:
        n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(int(n), *keys) if n else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside are removed when each of them has ended, not when the driver collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def write(df: DataFrame, path: str, mode: str = "errorifexists", by: str | None = None) -> None:
    """``df`` as Parquet (zstd) below ``path``, in folders of ``by``; what it shuffled is removed."""
    out = df.write.mode(mode).option("compression", "zstd")
    with shuffles_released(df.sparkSession):
        (out.partitionBy(by) if by else out).parquet(path)


def stored(df: DataFrame, name: str, under: str | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared folder (or a folder ``under`` it) and read back: computed once, with measured sizes and no lineage."""
    return stored_parts([df], name, under)


def stored_parts(parts: Sequence[DataFrame], name: str, under: str | None = None) -> DataFrame:
    """The rows of all parts (of one schema), written one after the other, as ``stored``."""
    path = f"{under}/{name}" if under else scratch(parts[0].sparkSession, name)
    for i, df in enumerate(parts):
        write(df, path, "append" if i else "errorifexists")
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(spark: SparkSession, path: str) -> bool:
    """Removes a folder that nothing reads any more."""
    fs, at = _folder(spark, path)
    return fs.delete(at, True)


def rounds(spark: SparkSession, *paths: str) -> int:
    """Number of rounds for work on the tables at ``paths``, by their bytes."""
    found = [_folder(spark, p) for p in paths]
    return min(MAX_ROUNDS, max(1, -(-sum(fs.getContentSummary(at).getLength() for fs, at in found) // ROUND_BYTES)))
