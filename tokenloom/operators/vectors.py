"""Keyed vector index and exact k-nearest search.

The index is a plain table ``vectors(project, doc_id, path, content, metadata, embedding)``
keyed by ``doc_id = sha256(path)``. Upsert and delete are anti-joins (plus a union); search
is exact. Many-query search meets blocks of the index with blocks of the query table, and each pair
returns its own top-k before the final one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions import text as X

# ---------------------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------------------
MAX_K = 5                      # the search tool shows 5 (a label here: nothing is cut)
DEFAULT_K = 5
# ---------------------------------------------------------------------------------------

# Rows of the index and of the query table that one task holds.
INDEX_BLOCK, QUERY_BLOCK = 20_000, 2_000
METRICS = ("l2sq", "cosine", "ip")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def distance(a, b, metric: str = "l2sq") -> Column:
    """Vector distance as a Column: squared L2 (default), cosine, or inner-product distance."""
    if metric == "l2sq":
        return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double"))
                                      * (x.cast("double") - y.cast("double"))),
                           F.lit(0.0), lambda acc, v: acc + v)
    if metric == "ip":
        return F.lit(1.0) - dot(a, b)
    if metric == "cosine":
        return F.lit(1.0) - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    raise ValueError(f"unknown metric {metric!r}")


def dedupe_batch(batch: DataFrame, order_col: str | None = None) -> DataFrame:
    """One row per key: the last by ``order_col`` (a later write of a key wins). Without an order the keys
    have to be unique; a repeated one fails the job, so that no arbitrary version wins."""
    if order_col is None:
        n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
        return (batch.withColumn("_n", n)
                .filter(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(
                    F.concat(F.lit("repeated key without order_col: "), F.col("doc_id"))).cast("boolean"))).drop("_n"))
    cols = [c for c in batch.columns if c != "doc_id"]
    latest = batch.groupBy("doc_id").agg(F.max_by(F.struct(*cols), F.col(order_col)).alias("_r"))
    return latest.select("doc_id", "_r.*").select(*batch.columns)


def upsert(current: DataFrame, batch: DataFrame, order_col: str | None = None) -> DataFrame:
    """Keyed upsert: rows of ``current`` whose key is in the batch are replaced by it."""
    batch = dedupe_batch(batch, order_col)
    keys = batch.select("doc_id")
    return current.join(keys, "doc_id", "left_anti").unionByName(batch.select(*current.columns))


def delete(current: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed delete; keys that are not present are ignored."""
    return current.join(keys.select("doc_id"), "doc_id", "left_anti")


def searchable(index: DataFrame, dim: int | None = None) -> DataFrame:
    """Rows that have a vector (of the query's dimension): an index may hold keys without one."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return index.filter(ok if dim is None else ok & (F.size("embedding") == dim))


def knn_single(index: DataFrame, query: list[float], k: int = DEFAULT_K, metric: str = "l2sq",
               cols: tuple[str, ...] = ("doc_id", "path")) -> DataFrame:
    """k nearest rows to one query vector, ascending distance, ties by doc_id.

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: each task keeps its own top-k,
    so only k rows per task travel. An empty index gives an empty answer.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    d = distance("embedding", q, metric)
    return (searchable(index, len(query)).select(*cols, d.alias("_d"))
            .orderBy("_d", "doc_id").limit(k)
            .select(*cols, F.round("_d", 6).alias("distance")))


def _block_topk(k: int, metric: str):
    """Top-k of one block of the index for one block of queries (numpy inside a task)."""

    def run(rows, asked):
        import numpy as np
        import pandas as pd

        out = []
        asked = asked[np.array([e is not None and len(e) > 0 for e in asked["embedding"]], dtype=bool)]      # a block may have no queries
        dims = rows["embedding"].map(len).to_numpy(int) if len(rows) else np.zeros(0, int)
        for dim in sorted({len(e) for e in asked["embedding"]}):
            own = rows[dims == dim]
            q = asked[[len(e) == dim for e in asked["embedding"]]]
            if not len(own):
                continue
            X, Q = np.stack(own["embedding"].to_numpy()).astype(float), np.stack(q["embedding"].to_numpy()).astype(float)
            ids, pth = own["doc_id"].to_numpy(object), own["path"].to_numpy(object)
            G, xn, qn = X @ Q.T, (X * X).sum(1), (Q * Q).sum(1)
            for j, qid in enumerate(q["query_id"].to_numpy()):
                if metric == "l2sq":
                    col = xn - 2.0 * G[:, j] + qn[j]
                elif metric == "ip":
                    col = 1.0 - G[:, j]
                else:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        col = 1.0 - G[:, j] / (np.sqrt(xn) * np.sqrt(qn[j]))
                if len(col) > k:       # everything up to the k-th distance, with room for rounding: ties stay
                    kth = np.partition(np.where(np.isnan(col), np.inf, col), k - 1)[k - 1]
                    sel = np.flatnonzero(~(col > kth + 1e-9 * (1 + abs(kth) + qn[j])))
                else:
                    sel = np.arange(len(col))
                if metric == "l2sq":
                    d = ((X[sel] - Q[j]) ** 2).sum(1)
                else:
                    d = col[sel]
                d = np.round(d, 12)
                for i in np.lexsort((ids[sel].astype(str), d))[:k]:
                    out.append((qid, ids[sel[i]], pth[sel[i]], float(d[i])))
        return pd.DataFrame(out, columns=["query_id", "doc_id", "path", "_d"])

    return run


def knn_batch(index: DataFrame, queries: DataFrame, k: int = DEFAULT_K, metric: str = "l2sq") -> DataFrame:
    """k nearest rows for every query: ``(query_id, rank, doc_id, path, distance)``, ties by doc_id.

    Index and queries are cut into blocks by hash, and every pair of blocks meets in one task (a
    cogroup), which returns its own top-k; so a task holds two blocks whatever the size of either
    side, and nothing is collected. The index travels once per QUERY_BLOCK queries.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    index = searchable(index).select("doc_id", "path", "embedding")
    n_i = max(1, -(-index.count() // INDEX_BLOCK))
    n_q = max(1, -(-queries.count() // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = index.withColumn("_i", F.pmod(F.xxhash64("doc_id"), F.lit(n_i)).cast("int")).withColumn("_q", every(n_q))
    asked = (queries.select(F.col("query_id").cast("bigint"), "embedding")
             .withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int")).withColumn("_i", every(n_i)))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("doc_id", T.StringType()),
                           T.StructField("path", T.StringType()), T.StructField("_d", T.DoubleType())])
    cand = rows.groupBy("_i", "_q").cogroup(asked.groupBy("_i", "_q")).applyInPandas(_block_topk(k, metric), schema)
    w = Window.partitionBy("query_id").orderBy(F.col("_d").asc_nulls_last(), "doc_id")      # a distance that is no number comes last
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "doc_id", "path",
                    F.round("_d", 6).alias("distance")))


def retrieve(hits: DataFrame, index: DataFrame, views: DataFrame, limit: int | None = None) -> DataFrame:
    """The hits (query_id, rank, doc_id, path, ...) with text, stage, tokens, is_long, query_tokens and within_max.

    A hit with a path shows its file's view of today (``views``: path, text, stage, tokens; null text, stage ``missing`` and 0 tokens
    where the file is gone). A hit without a path shows the content stored with its key in the ``index``, whole or
    with a ``limit`` cut to it; such a text counts 0 tokens. ``is_long`` tells stored texts that the search tool would cut. A hit
    whose key is gone from the index has a null text. Texts are fetched for the hits only, each from one place.
    """
    found, bare = F.col("path").isNotNull(), hits.where("path is null").select("doc_id").distinct()
    stored = (index.join(bare, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("content").alias("_stored")))
    seen = views.join(hits.where(found).select("path").distinct(), "path", "left_semi").select(
        "path", F.col("text").alias("_view"), F.col("stage").alias("_stage"), F.col("tokens").alias("_tokens"))
    own = [F.col(c) for c in hits.columns]
    j = (hits.join(seen, "path", "left").join(stored.withColumnRenamed("doc_id", "_id"), ~found & (F.col("doc_id") == F.col("_id")), "left"))
    out = j.select(*own, F.when(found, F.col("_view")).otherwise(X.snippet("_stored", "path", limit)).alias("text"),
                   F.when(found, F.coalesce("_stage", F.lit("missing"))).otherwise(F.lit("snippet")).alias("stage"),
                   F.when(found, F.coalesce("_tokens", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("tokens"),
                   (~found & F.coalesce(F.length("_stored") > X.SNIPPET_MAX, F.lit(False))).alias("is_long"),
                   (F.col("rank") <= MAX_K).alias("within_max"))
    return out.withColumn("query_tokens", F.sum("tokens").over(Window.partitionBy("query_id")).cast("bigint"))


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """Mean vector per ``key`` — dimension-wise partial/final aggregation (no collect per group)."""
    exploded = vectors.select(key, F.posexplode("embedding").alias("i", "x"))
    per_dim = exploded.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return (per_dim.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_s"))
            .select(F.col(key), F.transform("_s", lambda s: s["m"]).alias("embedding")))
