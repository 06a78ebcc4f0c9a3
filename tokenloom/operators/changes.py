"""Change feeds: latest change per path and the batch form of index synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators import corpus as C


def latest_change(changes: DataFrame) -> DataFrame:
    """The last change of each path by (ts, seq): one aggregate with map-side combine.

    A change without a time is older than any with one; it still counts where its path has no other.
    Run it on change keys and attach texts afterwards to keep texts out of the shuffle.
    """
    cols = [c for c in changes.columns if c != "path"]
    last = changes.groupBy("path").agg(F.max_by(F.struct(*cols), F.struct("ts", "seq")).alias("_r"))
    return last.select("path", "_r.*").select(*changes.columns)


def sync_index(current: DataFrame, changes: DataFrame, root_name: str = "workspace",
               excludes=None, attach=None) -> DataFrame:
    """Apply a change feed to the index: created/modified -> upsert of the latest text,
    deleted -> delete. Paths failing the watcher predicate are ignored; a change whose text
    equals the indexed text is a no-op. Vectors of kept keys stay, new keys have none.
    ``attach`` adds ``content`` to change keys after the latest change is chosen.

    One full outer join of the index with the winning changes decides every row.
    """
    kw = {} if excludes is None else {"excludes": excludes}
    last = latest_change(changes.filter(C.watch_valid("path", root_name, **kw)))
    if attach is not None:          # texts joined only to the winning rows
        last = attach(last)
    new = last.select(F.sha2("path", 256).alias("doc_id"), F.col("path").alias("_path"), F.col("op").alias("_op"),
                      F.col("content").alias("_content"))
    j = current.join(new, "doc_id", "full_outer").filter("_op is null or _op <> 'deleted'")
    written = F.col("_op").isNotNull() & (F.col("content").isNull() | (F.sha2("content", 256) != F.sha2("_content", 256)))
    own = {"path": F.when(written, F.col("_path")).otherwise(F.col("path")),
           "content": F.when(written, F.col("_content")).otherwise(F.col("content")),
           "project": F.coalesce("project", F.regexp_extract("_path", r"^([^/]*)", 1))}
    return j.select(*[own[c].alias(c) if c in own else F.col(c) for c in current.columns])
