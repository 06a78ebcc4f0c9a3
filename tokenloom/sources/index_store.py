"""Versioned index sink (SRC-4, JOIN-4/5): every write of a batch is a new version of the index, kept by project and bucket.

* ``data/in_version=v/in_project=p/in_bucket=b``: the rows that version ``v`` wrote of one place, a (project, bucket) pair.
* ``manifest/v``: (in_project, in_bucket, in_version), one row a place: whose rows count in version ``v``. It is written last, so
  a version exists as a whole or not at all, and what a writer that died left behind is overwritten by the next try.

A write rewrites the places that its keys fall into; all others stay where they are. A published version never changes: readers of
version ``v`` see the same rows whatever is written later, until ``expire`` takes it. One writer at a time is assumed.
Manifests are tables, joined and never collected, so the number of projects has no bound. A place is written with a rebalance: a
project with a third of all rows is many files, and no task holds it.

Keys are (project, doc_id); a null project is a project of its own and differs from an empty one. A null doc_id is an error, and so are
repeated keys in a batch without an ``order_col`` (with one the last row counts, a null being the oldest).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.session import stored

BUCKETS = 16
PLACE = ["in_project", "in_bucket"]
MANIFEST = "in_project string, in_bucket int, in_version int"


def _place(buckets: int) -> dict[str, Column]:
    project = F.coalesce(F.concat(F.lit("p"), F.col("project")), F.lit("none"))      # a name that is no empty folder
    return {"in_project": project, "in_bucket": F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")}


def _manifest(root: str, version: int) -> str:
    return f"{root}/manifest/v{version:09d}"


def _folder(root: str, version: int) -> str:
    return f"{root}/data/in_version={version}"


def _numbers(spark: SparkSession, folder: str, prefix: str, done: bool) -> list[int]:
    """Numbers of the folders ``prefix``N in a folder (one a version), those with a finished write only if ``done``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    names = [n for n in names if n.startswith(prefix)]
    if done:
        names = [n for n in names if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix(prefix)) for n in names)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The published versions, oldest first."""
    return _numbers(spark, f"{root}/manifest", "v", done=True)


def _next(spark: SparkSession, root: str) -> tuple[int | None, int]:
    last = versions(spark, root)
    return (last[-1], last[-1] + 1) if last else (None, 0)


def _live(spark: SparkSession, root: str, version: int) -> DataFrame:
    if version not in versions(spark, root):
        raise ValueError(f"the index has no version {version}")
    return spark.read.schema(MANIFEST).parquet(_manifest(root, version)).where(F.col("in_version") <= version)


def _rows(spark: SparkSession, root: str, version: int, schema: str, places: DataFrame | None = None, project: str | None = None) -> DataFrame:
    """Rows of a version with their place, of some places only if given."""
    live = _live(spark, root, version)
    own = [r["in_version"] for r in live.select("in_version").distinct().collect()]       # at most one row a version
    if project is not None:
        live = live.where(F.col("in_project") == "p" + project)
    if places is not None:
        live = live.join(places, PLACE, "left_semi")
    data = spark.read.schema(f"{schema}, {MANIFEST}").option("basePath", f"{root}/data")
    data = data.parquet(*[_folder(root, v) for v in own]) if own else spark.createDataFrame([], f"{schema}, {MANIFEST}")
    if project is not None:
        data = data.where(F.col("in_project") == "p" + project)                           # prunes folders
    return data.join(live, [*PLACE, "in_version"], "left_semi").drop("in_version")


def _latest(batch: DataFrame, order_col: str | None, buckets: int) -> DataFrame:
    """One row a key, with its place."""
    rows = batch.withColumns(_place(buckets))
    cols = [c for c in rows.columns if c not in ("doc_id", *PLACE)]
    order = F.lit(0) if order_col is None else F.struct(F.col(order_col).isNotNull(), F.col(order_col))
    one = rows.groupBy("doc_id", *PLACE).agg(F.max_by(F.struct(*cols), order).alias("_r"), F.count(F.lit(1)).alias("_n"))
    wrong = F.when(F.col("doc_id").isNull(), F.lit("a row has no doc_id"))
    if order_col is None:
        wrong = wrong.when(F.col("_n") > 1, F.concat(F.lit("repeated key without order_col: "), F.col("doc_id")))
    checked = one.where(F.when(wrong.isNull(), True).otherwise(F.raise_error(wrong).cast("boolean")))
    return checked.select("doc_id", "_r.*", *PLACE).select(*batch.columns, *PLACE)


def _publish(rows: DataFrame, root: str, version: int, keep: DataFrame | None, places: DataFrame) -> int:
    """Write the rows of ``places`` as ``version``; the places of ``keep`` stay as they are."""
    spark = rows.sparkSession
    rows.hint("rebalance", *PLACE).write.mode("overwrite").partitionBy(*PLACE).parquet(_folder(root, version))
    own = places.select(*PLACE, F.lit(version).alias("in_version"))
    (own if keep is None else keep.unionByName(own)).write.mode("overwrite").parquet(_manifest(root, version))
    return version


def replace(index: DataFrame, root: str, order_col: str | None = None, buckets: int = BUCKETS) -> int:
    """A version that holds the rows of ``index`` only. Returns its number, 0 for the first one."""
    spark = index.sparkSession
    rows = stored(_latest(index, order_col, buckets), "index-rows")
    return _publish(rows, root, _next(spark, root)[1], None, rows.select(*PLACE).distinct())


def upsert(batch: DataFrame, root: str, schema: str, order_col: str | None = None, buckets: int = BUCKETS) -> int:
    """A version in which the rows of the batch replace those of their keys. ``buckets`` must be that of the versions before."""
    spark = batch.sparkSession
    last, version = _next(spark, root)
    if last is None:
        return replace(batch, root, order_col, buckets)
    rows = stored(_latest(batch, order_col, buckets), "index-batch")
    places = stored(rows.select(*PLACE).distinct(), "index-places")
    old = _rows(spark, root, last, schema, places).join(rows.select("doc_id", *PLACE), ["doc_id", *PLACE], "left_anti")
    return _publish(old.unionByName(rows.select(*old.columns)), root, version, _live(spark, root, last).join(places, PLACE, "left_anti"), places)


def delete(keys: DataFrame, root: str, schema: str, buckets: int = BUCKETS) -> int:
    """A version without the given keys (project, doc_id); keys that it does not hold are ignored."""
    spark = keys.sparkSession
    last, version = _next(spark, root)
    if last is None:
        raise ValueError("the index has no version")
    gone = stored(keys.select("project", "doc_id").withColumns(_place(buckets)).select("doc_id", *PLACE).distinct(), "index-keys")
    live = _live(spark, root, last)
    places = stored(live.select(*PLACE).join(gone, PLACE, "left_semi"), "index-places")
    left = _rows(spark, root, last, schema, places).join(gone, ["doc_id", *PLACE], "left_anti")
    return _publish(left, root, version, live.join(places, PLACE, "left_anti"), places)


def compact(spark: SparkSession, root: str, schema: str) -> int:
    """A version with the rows of the newest one, all written anew, so that nothing older is needed for it."""
    last, version = _next(spark, root)
    if last is None:
        raise ValueError("the index has no version")
    return _publish(_rows(spark, root, last, schema), root, version, None, _live(spark, root, last).select(*PLACE))


def read(spark: SparkSession, root: str, schema: str, version: int | None = None, project: str | None = None) -> DataFrame:
    """The index as of a version (default: the newest), or of one project of it: only that project's folders are read."""
    if version is None:
        version = _next(spark, root)[0]
        if version is None:
            raise ValueError("the index has no version")
    return _rows(spark, root, version, schema, project=project).drop(*PLACE)


def expire(spark: SparkSession, root: str, keep: Iterable[int]) -> DataFrame:
    """Removes what no kept version needs, and returns it as (kind, version): manifests older than the newest kept version, data
    folders of versions of which no place counts any more, and what unfinished writes left behind. The newest version is always kept."""
    known = versions(spark, root)
    kept = sorted({*known[-1:], *(v for v in keep if v in known)})
    used: set[int] = set()
    for v in kept:
        used |= {r["in_version"] for r in _live(spark, root, v).select("in_version").distinct().collect()}    # one row a version
    newest = kept[-1] if kept else -1
    gone = [("manifest", v, _manifest(root, v)) for v in _numbers(spark, f"{root}/manifest", "v", done=False) if v < newest and v not in kept]
    gone += [("data", v, _folder(root, v)) for v in _numbers(spark, f"{root}/data", "in_version=", done=False) if v < newest and v not in used]
    for _, _, name in gone:                                                               # manifests first: a reader sees no half version
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return spark.createDataFrame([(k, v) for k, v, _ in gone], "kind string, version int")
