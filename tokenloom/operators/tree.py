"""Tree listing of a path table: directories first, case-insensitive names, depth-first.

Every step is a set operation on the node table — no recursion on the driver and no window
over a whole parent directory: the last child of each directory comes from a combinable
``max`` aggregate, prefixes from a join with the (depth-bounded) ancestor list, and line
numbers from a range-partitioned global sort, stored once, plus per-partition offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions import paths as P
from tokenloom.session import checkpoint_dir

# ---------------------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------------------
BRANCH = "├── "
LAST_BRANCH = "└── "
PIPE_INDENT = "│   "
BLANK_INDENT = "    "
DENIED = "[Permission Denied]"
BAD_ROOT = "# Error: %s is not a valid directory."
# ---------------------------------------------------------------------------------------


def nodes(paths: DataFrame, ignore: Sequence[str] = P.TREE_IGNORE_DIRS) -> DataFrame:
    """Directory and file nodes of a path table ``(path, is_dir)``.

    Every proper prefix of a path is a directory; a path is a directory itself when
    ``is_dir`` says so (or when another path lies below it). Directories named in ``ignore``
    are dropped with everything below them; files with such names stay.
    """
    parts = F.split("path", "/")
    exploded = paths.select(parts.alias("p"), F.size(parts).alias("n"), F.col("is_dir").alias("leaf_dir")) \
        .select("p", "n", "leaf_dir", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    node = exploded.select(
        F.array_join(F.slice("p", 1, F.col("k")), "/").alias("path"),
        F.slice("p", 1, F.col("k")).alias("parts"),
        F.col("k").cast("int").alias("depth"),
        ((F.col("k") < F.col("n")) | F.col("leaf_dir")).alias("is_dir"))
    node = node.groupBy("path").agg(F.first("parts").alias("parts"), F.first("depth").alias("depth"),
                                    F.max(F.col("is_dir").cast("int")).cast("boolean").alias("is_dir"))
    ign = F.array(*[F.lit(x) for x in ignore])
    dir_parts = F.when(F.col("is_dir"), F.col("parts")).otherwise(F.slice("parts", 1, F.col("depth") - 1))
    node = node.filter(~F.arrays_overlap(dir_parts, ign))
    key = F.struct((~F.col("is_dir")).alias("is_file"), F.lower(F.element_at("parts", -1)).alias("lname"),
                   F.element_at("parts", -1).alias("name"))
    return node.select("path", "parts", "depth", "is_dir",
                       F.element_at("parts", -1).alias("name"),
                       F.when(F.col("depth") > 1, F.array_join(F.slice("parts", 1, F.col("depth") - 1), "/"))
                        .otherwise(F.lit("")).alias("parent"),
                       key.alias("key"))


def with_last_flag(node: DataFrame) -> DataFrame:
    """``is_last``: the node is its parent's greatest child in listing order."""
    last = node.groupBy("parent").agg(F.max("key").alias("_maxkey"))
    return node.join(last, "parent").withColumn("is_last", F.col("key") == F.col("_maxkey")).drop("_maxkey")


def rendered(node: DataFrame) -> DataFrame:
    """Rendered line per node: ancestors' indents + connector + name, and the sort key."""
    flagged = with_last_flag(node)
    anc = flagged.select("path", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("k"), "parts") \
        .select("path", "k", F.array_join(F.slice("parts", 1, F.col("k")), "/").alias("anc"))
    info = flagged.select(F.col("path").alias("anc"), "is_last", "key")
    joined = anc.join(info, "anc")
    agg = joined.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", "is_last", "key"))).alias("_a"))
    depth = F.size("_a")
    indents = F.transform(F.slice("_a", 1, depth - 1),
                          lambda s: F.when(s["is_last"], F.lit(BLANK_INDENT)).otherwise(F.lit(PIPE_INDENT)))
    own = F.element_at("_a", -1)
    line = F.concat(F.array_join(indents, ""),
                    F.when(own["is_last"], F.lit(LAST_BRANCH)).otherwise(F.lit(BRANCH)),
                    own["key"]["name"])
    sort_key = F.transform("_a", lambda s: s["key"])
    return agg.select("path", depth.cast("int").alias("depth"), line.alias("line"), sort_key.alias("sort_key"))


def global_row_number(df: DataFrame, order_col: str, out: str = "line_no", partitions: int | None = None) -> DataFrame:
    """1-based position in a total order without a single-partition window.

    The rows are range-partitioned, sorted and written once to the checkpoint folder: range bounds are
    sampled, so a second computation could cut elsewhere. The stored partitions are then numbered, and
    the row counts of all earlier ones are added (a table with one row per partition).
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fixed = df.repartitionByRange(n, order_col).sortWithinPartitions(order_col).checkpoint(eager=True)
    pid = F.spark_partition_id()
    local = fixed.withColumn("_pid", pid).withColumn(
        "_local", F.monotonically_increasing_id() - F.shiftleft(pid.cast("bigint"), 33))
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select("_pid", F.sum("_cnt").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")   # one row per partition: bounded by n
            .withColumn(out, (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local") + 1).cast("bigint"))
            .drop("_pid", "_local", "_off"))


def listing(paths: DataFrame, root_name: str, ignore: Sequence[str] = P.TREE_IGNORE_DIRS) -> DataFrame:
    """The whole listing as rows ``(line_no, line)``; line 0 is ``root_name/``."""
    r = rendered(nodes(paths, ignore))
    numbered = global_row_number(r, "sort_key")
    root = paths.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("line_no"),
                                              F.lit(root_name + "/").alias("line"))
    return root.unionByName(numbered.select("line_no", "line"))


def listing_of(entries: DataFrame, root_name: str, ignore: Sequence[str] = P.TREE_IGNORE_DIRS) -> DataFrame:
    """The listing of a scan with its status rows (``sources.files.tree_entries``): a folder without permission has one
    row below it that says so, and a root that is no folder gives that error alone.

    The status travels as a child of the folder, so it is sorted, indented and numbered with the other rows.
    """
    marked = entries.where("status = 'denied'").select(F.concat_ws("/", F.when(F.col("path") != "", F.col("path")), F.lit(DENIED)).alias("path"),
                                                       F.lit(False).alias("is_dir"))
    paths = entries.where("status = 'ok'").select("path", "is_dir").unionByName(marked)
    if not entries.where("path = '' and status = 'missing'").isEmpty():
        return entries.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("line_no"), F.lit(BAD_ROOT % root_name).alias("line"))
    return listing(paths, root_name, ignore)
