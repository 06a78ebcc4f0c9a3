"""Exact nearest rows without reading the whole index: pivot cells with radius bounds.

``build`` stores the index by cells: every row lies in the cell of its nearest pivot, and a cell knows the least and the
greatest distance of its rows to the pivot. By the triangle inequality no row of a cell is nearer to a query than
``max(0, d - greatest, least - d)``, where ``d`` is the query's distance to the pivot. ``search`` reads the cells of least bound that hold
k rows first, and then only those whose bound is not beyond the k-th distance found there. The answer is that
of ``vectors.knn_batch`` with the metric ``l2sq``, ties included.

Pivots are chosen from a bounded sample (the ``SAMPLE`` rows of least key hash a pivot), each as far as can be from those before it, so that
groups of rows far apart get cells of their own; every row is indexed and the sample does not change the answer.
Rows that have no pivot of their dimension, or no finite distance to one, lie in the cell ``LOOSE``, which every search reads. Rows
and queries without a vector are in no answer. A cell of any size is read in blocks, by as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.operators import vectors as V
from tokenloom.session import stored

PIVOTS, SAMPLE = 256, 8
LOOSE = -1


def _distances(X: np.ndarray, P: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (X * X).sum(1)[:, None] - 2.0 * (X @ P.T) + (P * P).sum(1)[None, :]))


def _by_dimension(pivots: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Dimension -> (cells, their pivots)."""
    out = {}
    for dim in sorted({len(e) for _, e in pivots}):
        own = [(c, e) for c, e in pivots if len(e) == dim]
        out[dim] = np.array([c for c, _ in own]), np.array([e for _, e in own], dtype=float)
    return out


def _spread(sample: list[list[float]], n: int) -> list[list[float]]:
    """Up to ``n`` different vectors, taking in turn the one farthest from those taken before; dimensions share by their rows."""
    out: list[list[float]] = []
    for dim in sorted({len(e) for e in sample}):
        X = np.array([e for e in sample if len(e) == dim], dtype=float)
        share = max(1, n * len(X) // len(sample))
        far = np.full(len(X), np.inf)
        at = 0
        while share and far[at] > 0:
            out.append(X[at].tolist())
            far = np.minimum(far, _distances(X, X[at:at + 1])[:, 0])
            far[at] = 0.0
            at, share = int(np.argmax(far)), share - 1
    return out


def build(index: DataFrame, path: str, pivots: int = PIVOTS) -> None:
    """Store the rows of ``index`` (doc_id, path, embedding) by cells below ``path``: ``pivots``, ``columns``, ``rows`` and ``cells``."""
    spark = index.sparkSession
    rows = V.searchable(index).select("doc_id", "path", "embedding")
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE * pivots).select("embedding").collect()
    whole = [list(map(float, r[0])) for r in sample if all(x is not None and np.isfinite(x) for x in r[0])]
    chosen = list(enumerate(_spread(whole, pivots)))
    spark.createDataFrame(chosen, "cell int, embedding array<double>").write.mode("overwrite").parquet(f"{path}/pivots")
    table = _by_dimension(chosen)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, far = np.full(len(b), LOOSE), np.zeros(len(b))
            dims = b["embedding"].map(len).to_numpy(int) if len(b) else np.zeros(0, int)
            for dim, (ids, P) in table.items():
                at = np.flatnonzero(dims == dim)
                if len(at):
                    X = np.stack(b["embedding"].iloc[at].to_numpy()).astype(float)
                    best = np.argmin(_distances(X, P), axis=1)
                    exact = np.sqrt(((X - P[best]) ** 2).sum(1))
                    ok = np.isfinite(exact)
                    cell[at], far[at] = np.where(ok, ids[best], LOOSE), np.where(ok, exact, 0.0)
            yield b.assign(cell=cell.astype("int32"), to_pivot=far)

    kind = rows.schema["embedding"].dataType.simpleString()
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/columns")        # an index without rows has columns too
    placed = rows.mapInPandas(place, f"doc_id string, path string, embedding {kind}, cell int, to_pivot double")
    # a rebalance cuts a hot cell into several files
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    (spark.read.schema("doc_id string, to_pivot double, cell int").parquet(f"{path}/rows").groupBy("cell")
     .agg(F.count(F.lit(1)).alias("n"), F.min("to_pivot").alias("least"), F.max("to_pivot").alias("greatest"))
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/cells"))


def _bounds(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, cell, n, low, first): what every query's distance to every cell's rows is at least, and whether the cell is among
    those of least bound that hold k rows."""
    known = {r["cell"]: (r["n"], r["least"], r["greatest"]) for r in spark.read.parquet(f"{path}/cells").collect()}      # at most PIVOTS + 1
    table = _by_dimension([(r[0], r[1]) for r in spark.read.parquet(f"{path}/pivots").collect() if r[0] in known])
    loose = known.get(LOOSE, (0, 0.0, 0.0))[0]

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for qid, e in zip(b["query_id"], b["embedding"]):
                q = np.asarray(e, dtype=float)
                if len(q) in table:
                    ids, P = table[len(q)]
                    n, least, greatest = (np.array([known[c][x] for c in ids.tolist()], dtype=float) for x in range(3))
                    d = np.sqrt(((P - q) ** 2).sum(1))
                    low = np.nan_to_num(np.maximum.reduce([np.zeros(len(d)), d - greatest, least - d]), nan=0.0)
                    order = np.argsort(low, kind="stable")
                    before = np.cumsum(n[order]) - n[order]
                    first = np.zeros(len(d), bool)
                    first[order[before < k]] = True
                    out.append(pd.DataFrame({"query_id": qid, "cell": ids, "n": n.astype("int64"), "low": low, "first": first}))
                if loose:
                    out.append(pd.DataFrame({"query_id": [qid], "cell": [LOOSE], "n": [loose], "low": [0.0], "first": [True]}))
            yield pd.concat(out) if out else pd.DataFrame({"query_id": [], "cell": [], "n": [], "low": [], "first": []})

    return V.searchable(queries).select("query_id", "embedding").mapInPandas(bound, "query_id bigint, cell int, n bigint, low double, first boolean")


def _nearest(spark: SparkSession, path: str, queries: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of every (query, cell) pair's blocks. Only the folders of the pairs' cells are read."""
    kind = spark.read.parquet(f"{path}/columns").schema["embedding"].dataType.simpleString()
    rows = spark.read.schema(f"doc_id string, path string, embedding {kind}, cell int").parquet(f"{path}/rows")
    wanted = pairs.groupBy("cell").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("_asked")).select(
        "cell", F.ceil(F.col("n") / V.INDEX_BLOCK).cast("int").alias("_ni"), F.ceil(F.col("_asked") / V.QUERY_BLOCK).cast("int").alias("_nq"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    held = rows.join(wanted, "cell").withColumn("_i", F.pmod(F.xxhash64("doc_id"), F.col("_ni")).cast("int")).withColumn("_q", every("_nq"))
    asked = (pairs.select("query_id", "cell").join(queries, "query_id").join(wanted, "cell")
             .withColumn("_q", F.pmod(F.xxhash64("query_id"), F.col("_nq")).cast("int")).withColumn("_i", every("_ni")))
    keys = ["cell", "_i", "_q"]
    return (held.select(*keys, "doc_id", "path", "embedding").groupBy(*keys)
            .cogroup(asked.select(*keys, "query_id", "embedding").groupBy(*keys))
            .applyInPandas(V._block_topk(k, "l2sq"), "query_id bigint, doc_id string, path string, _d double"))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = V.DEFAULT_K) -> tuple[DataFrame, DataFrame]:
    """The k nearest rows of every query, as ``vectors.knn_batch`` returns them, and what was read for each: (query_id, cells, cells_read,
    rows, rows_read), of the cells of its dimension. ``query_id`` is unique."""
    queries = queries.select(F.col("query_id").cast("bigint"), "embedding")
    pairs = stored(_bounds(spark, path, queries, k), "cell-bounds")
    best = Window.partitionBy("query_id").orderBy(F.col("_d").asc_nulls_last(), "doc_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    head = stored(top(_nearest(spark, path, queries, pairs.where("first"), k)), "cell-head")
    # the k-th distance so far; with fewer rows than k nothing can be left out
    reach = head.groupBy("query_id").agg(F.when(F.count("_d") == k, F.max("_d")).alias("_reach"))
    near = pairs.join(reach, "query_id", "left").withColumn(
        "read", F.col("first") | F.col("_reach").isNull() | (F.col("low") * F.col("low") <= F.col("_reach") + 1e-9 * (1 + F.col("_reach"))))
    near = stored(near.drop("_reach"), "cell-reads")
    rest = _nearest(spark, path, queries, near.where("read and not first"), k)
    hits = top(head.drop("rank").unionByName(rest)).select("query_id", F.col("rank").cast("int"), "doc_id", "path", F.round("_d", 6).alias("distance"))
    report = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if("read").alias("cells_read"), F.sum("n").alias("rows"),
                                          F.sum(F.when(F.col("read"), F.col("n")).otherwise(0)).alias("rows_read"))
    return hits, report
