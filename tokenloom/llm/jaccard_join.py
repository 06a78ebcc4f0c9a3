"""Operator 8: n-gram Jaccard self-join with Bayesian candidate pruning.

Two texts are linked where the Jaccard similarity of their sets of five-word shingles is at least
``threshold``. Texts with equal shingle sets form one class and are compared once.

* Every class has HASHES MinHash values; BANDS groups of them are band keys. Two classes with similarity 0.8
  share no band with probability under 1e-7, so nearly equal texts meet in a bucket.
* Buckets with the same members are one bucket (compared by count and xor of member hashes, without
  collecting members). A bucket with more than CELL shingles is cut into blocks, and every pair of blocks is
  a cell of its own, so a group of any size is spread over tasks and no task holds more than two blocks.
* In a cell a pair is looked at only if the bucket's band is the first that the pair shares. MinHash values are compared
  STEP at a time, and a pair is dropped once the posterior probability that its similarity reaches the
  threshold (uniform prior) is below TOLERANCE. The rest is verified exactly on the shingle sets.
* A cell returns one row per class with its number of links and one edge of a spanning forest, never pairs, so
  its output is linear in its input. Components of the edges give the class id of near-duplicate groups.

Defined results: a null or blank text has no shingles, no links, and its own id as class id; a text of
fewer than five words has one shingle; n_links counts all other rows that the row is linked with, copies
included; rows that repeat an id are rows of their own; a class that holds only null ids has a null class
id. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import bloom
from tokenloom.llm.common import chunks, lean, materialize, mix, shingle_hashes, spans_of

THRESHOLD = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
CELL = 1 << 17                    # shingles of a block
_ELEMENTS = 1 << 18               # shingles whose MinHash values are computed together


def _least_matches(threshold: float, tolerance: float) -> list[int]:
    """For n = STEP, 2 STEP, ... compared values: the smallest number m of equal ones for which
    P(similarity >= threshold | m of n) = P(Binomial(n + 1, threshold) <= m) reaches the tolerance."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance and m < n:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows and the rows' offsets."""
    off = col.offsets.to_numpy().astype(np.int64)
    h = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64) if len(col) else np.zeros(0, np.uint64)
    return h, off - off[0]


def _bands(sig: np.ndarray) -> np.ndarray:
    """Band keys of MinHash values: one 64-bit number for every ROWS values."""
    out = np.zeros((len(sig), BANDS), np.uint64)
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + sig[:, k::ROWS].astype(np.uint64) + np.uint64(k + 1))
    return out


def signatures(texts: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, n, key, sig, bands) of every row of (doc_id, t1, t2, sh): size and 128-bit key
    of its shingle set, MinHash values and band keys; key is null without shingles."""
    schema = texts.select("doc_id", "t1", "t2", F.lit(0).alias("n"), F.lit(None).cast("binary").alias("key"),
                          F.lit(None).cast("binary").alias("sig"), F.lit(None).cast("array<bigint>").alias("bands")).schema
    rng = np.random.default_rng(8)
    mul = rng.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**64, HASHES, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            h, off = _hashes(b.column("sh"))
            n = np.zeros(b.num_rows, np.int64)
            sig = np.zeros((b.num_rows, HASHES), np.uint32)
            key = np.zeros((b.num_rows, 2), np.uint64)
            for i, j in chunks(off, _ELEMENTS):
                sets = [np.unique(h[off[r]:off[r + 1]]) for r in range(i, j)]
                n[i:j] = [len(x) for x in sets]
                rows = np.flatnonzero(n[i:j] > 0) + i
                if not len(rows):
                    continue
                x, at = np.concatenate(sets), np.concatenate(([0], np.cumsum(n[rows])[:-1]))
                key[rows, 0] = np.add.reduceat(mix(x), at)
                key[rows, 1] = np.add.reduceat(mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                for k in range(HASHES):
                    sig[rows, k] = np.minimum.reduceat(x * mul[k] + add[k], at) >> np.uint64(32)
            band = _bands(sig)
            empty = n == 0
            key_col = pa.array([None if e else k.tobytes() for e, k in zip(empty, key, strict=True)], pa.binary())
            sig_col = pa.array([None if e else s.tobytes() for e, s in zip(empty, sig, strict=True)], pa.binary())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * BANDS), pa.array(band.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t1"), b.column("t2"), pa.array(n.astype(np.int32)),
                                              key_col, sig_col, bands], names=schema.names)

    return texts.mapInArrow(run, schema)


def _compare(rows: list[dict], same_block: bool, least: list[int], threshold: float) -> list[tuple]:
    """Links inside one cell: (key, other texts, other rows, key of its tree's root)."""
    m = len(rows)
    band = rows[0]["band"]
    sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint32).reshape(m, HASHES)
    keys = _bands(sig)
    copies = np.array([r["copies"] for r in rows], np.int64)
    block = np.array([r["block"] for r in rows])
    size = np.array([len(r["set"]) for r in rows], np.int64)
    off = np.concatenate(([0], np.cumsum(size)))
    _, flat = np.unique(np.concatenate([r["set"] for r in rows]), return_inverse=True)
    mark = np.zeros(int(flat.max()) + 1, np.int64)
    texts, docs, parent = np.zeros(m, np.int64), np.zeros(m, np.int64), list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(m - 1):
        j = np.arange(i + 1, m)
        if not same_block:
            j = j[block[j] != block[i]]
        if band and len(j):
            j = j[~(keys[j, :band] == keys[i, :band]).any(axis=1)]        # met in an earlier band
        equal = np.zeros(len(j), np.int64)
        for s, need in enumerate(least):
            if not len(j):
                break
            equal += (sig[j, s * STEP:(s + 1) * STEP] == sig[i, s * STEP:(s + 1) * STEP]).sum(axis=1)
            stay = equal >= need
            j, equal = j[stay], equal[stay]
        if not len(j):
            continue
        j = j[np.minimum(size[j], size[i]) >= threshold * np.maximum(size[j], size[i]) - 1e-9]
        if not len(j):
            continue
        mark[flat[off[i]:off[i + 1]]] = 1
        at = np.concatenate(([0], np.cumsum(size[j])[:-1]))
        pos = np.repeat(off[j] - at, size[j]) + np.arange(size[j].sum())
        shared = np.add.reduceat(mark[flat[pos]], at)
        mark[flat[off[i]:off[i + 1]]] = 0
        j = j[shared >= threshold * (size[j] + size[i] - shared) - 1e-9]
        if len(j):
            texts[i] += len(j)
            texts[j] += 1
            docs[i] += copies[j].sum()
            docs[j] += copies[i]
            for k in j.tolist():
                a, z = root(i), root(k)
                if a != z:
                    parent[max(a, z)] = min(a, z)
    return [(rows[i]["key"], int(texts[i]), int(docs[i]), rows[root(i)]["key"]) for i in np.flatnonzero(texts).tolist()]


def _links(cells: DataFrame, threshold: float) -> DataFrame:
    """Runs every cell (rows with the same bucket, x, y stand together) and returns its rows."""
    least = _least_matches(threshold, TOLERANCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held, cell = [], None

        def out(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                got = _compare(rows, rows[0]["x"] == rows[0]["y"], least, threshold)
                if got:
                    k, t, d, r = zip(*got, strict=True)
                    yield pa.RecordBatch.from_pydict({"key": pa.array(k, pa.binary()), "texts": pa.array(t, pa.int64()),
                                                      "docs": pa.array(d, pa.int64()), "root": pa.array(r, pa.binary())})

        for b in batches:
            h, off = _hashes(b.column("sh"))
            data, cut = spans_of(b.column("sig"))
            names = ["band", "bucket", "x", "y", "block", "key", "copies"]
            cols = [b.column(c).to_pylist() for c in names]
            for i, vals in enumerate(zip(*cols, strict=True)):
                row = dict(zip(names, vals, strict=True))
                row["set"], row["sig"] = np.unique(h[off[i]:off[i + 1]]), data[cut[i]:cut[i + 1]].tobytes()
                this = (row["band"], row["bucket"], row["x"], row["y"])
                if this != cell:
                    yield from out(held)
                    held, cell = [], this
                held.append(row)
        yield from out(held)

    return cells.mapInArrow(run, "key binary, texts bigint, docs bigint, root binary")


def components(edges: DataFrame) -> DataFrame:
    """(u, label): the smallest node of every node's component, for edges (u, v).

    Smallest label of the neighbours, then one jump to the label's own label, until nothing changes.
    Every round is written to the shared folder.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = materialize(both.where("u <> v").distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = materialize(both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near")), "near")
        step = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("u").alias("mid"), F.col("label").alias("far"))
        new = materialize(step.join(jump, "mid").select("u", "old", F.least("mid", "far").alias("label")), "labels")
        if new.where("old <> label").isEmpty():
            return new.select("u", "label")
        labels = new.select("u", "label")


def join(docs: DataFrame, threshold: float = THRESHOLD, k: int = 5, text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, t1, t2 (hashes of its text), n_shingles, class_id (smallest
    id of its group of linked texts), n_copies (rows of its shingle set), n_links, n_text_links."""
    texts = docs.select("doc_id", F.coalesce(text_col, F.lit("")).alias("body"))
    texts = texts.select("doc_id", F.xxhash64("body").alias("t1"), F.xxhash64(F.lit(7), "body").alias("t2"), "body")
    rows = materialize(signatures(texts.select("doc_id", "t1", "t2", shingle_hashes(F.col("body"), k).alias("sh"))), "signatures")
    full = rows.where("n > 0")
    classes = materialize(full.groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("t1", "t2")).alias("t"),
        F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("key", "n", F.posexplode("bands").alias("band", "bucket"))
    buckets = banded.groupBy("band", "bucket").agg(
        F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("key")).alias("m1"),
        F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("m2"), F.sum("n").alias("weight")).where("members > 1")
    chosen = buckets.groupBy("members", "m1", "m2").agg(F.min(F.struct("band", "bucket")).alias("b"), F.first("weight").alias("weight"))
    chosen = materialize(chosen.select("b.band", "b.bucket", F.ceil(F.col("weight") / CELL).cast("int").alias("blocks")), "buckets")
    members = banded.select("key", "band", "bucket").join(chosen, ["band", "bucket"])
    members = materialize(members.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), "members")

    wanted = materialize(classes.join(members.select("key").distinct(), "key", "left_semi")
                         .select("key", "copies", "sig", "t.t1", "t.t2"), "wanted")
    bodies = texts.where(bloom.native(wanted, "t1")(F.col("t1")))                 # a filter of fixed size
    bodies = bodies.groupBy("t1", "t2").agg(F.first("body").alias("body"))
    sets = materialize(bodies.join(wanted, ["t1", "t2"]).select(
        "key", "copies", "sig", shingle_hashes(F.col("body"), k).alias("sh")), "sets")
    cells = members.select("key", "band", "bucket", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("key", "band", "bucket", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    cells = (cells.join(sets, "key").repartition("band", "bucket", "x", "y")
             .sortWithinPartitions("band", "bucket", "x", "y", "key"))
    found = materialize(_links(cells, threshold), "links")

    links = found.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    groups = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
    named = classes.select("key", "first_id", "copies").join(groups.withColumnRenamed("u", "key"), "key", "left") \
        .withColumn("label", F.coalesce("label", "key"))
    ids = named.groupBy("label").agg(F.min("first_id").alias("class_id"))
    per_class = materialize(named.join(ids, "label").join(links, "key", "left").select(
        "key", "label", "class_id", "copies", F.coalesce("texts", F.lit(0)).alias("texts"),
        F.coalesce("docs", F.lit(0)).alias("docs")), "groups")
    out = rows.select("doc_id", "t1", "t2", "n", "key").join(per_class, "key", "left")
    blank = F.col("n") == 0
    return out.select(
        "doc_id", "t1", "t2", F.col("n").cast("bigint").alias("n_shingles"), F.col("label").alias("group_key"),
        F.when(blank, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("n_copies"),
        F.coalesce(F.col("docs") + F.col("copies") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("bigint").alias("n_text_links"))


def dedup(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group of linked texts: the one with the smallest id (null ids last,
    ties by the hash of the text). Rows without shingles stay."""
    links = materialize(join(docs, threshold, text_col=text_col).where("group_key is not null")
                        .select("group_key", "doc_id", "t1", "t2"), "joined")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t1", "t2")
    first = materialize(links.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1"), "firsts")
    judged = links.join(first, "group_key").select("doc_id", "t1", "t2", (place == F.col("first")).alias("stays"))
    judged = materialize(judged.groupBy("doc_id", "t1", "t2").agg(F.max("stays").alias("stays")), "copies")
    body = F.coalesce(text_col, F.lit(""))
    keyed = docs.withColumns({"_t1": F.xxhash64(body), "_t2": F.xxhash64(F.lit(7), body)})
    hit = bloom.native(judged, "t1")(F.col("_t1"))
    d = judged.select(F.col("doc_id").alias("_id"), F.col("t1").alias("_j1"), F.col("t2").alias("_j2"), F.col("stays").alias("_stays"))
    near = keyed.where(hit)
    near = near.join(d, near["doc_id"].eqNullSafe(d["_id"]) & (near["_t1"] == d["_j1"]) & (near["_t2"] == d["_j2"]), "left")
    near = materialize(near.where("_stays is null or _stays"), "near")
    once = near.where("_stays").dropDuplicates(["doc_id", "_t1", "_t2"])         # repeated rows of the one that stays
    return keyed.where(~hit).select(*docs.columns).unionByName(near.where("_stays is null").select(*docs.columns)).unionByName(once.select(*docs.columns))
