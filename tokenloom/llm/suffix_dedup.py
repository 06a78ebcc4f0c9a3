"""Operator 1: exact substring dedup by content-defined anchors and fingerprint refinement.

Every byte that lies in a string of ``length`` bytes which also starts anywhere else (in any text,
the same one included) is removed; matches never cross texts, overlaps count, and all strings are
judged on the input.

This stands in place of prefix doubling, which ranks suffixes by prefixes of growing length and needs a rank for every byte, which
at 100 TB cannot be shuffled. Ranks here are fingerprints of content, kept for a sparse set of suffixes that is enough:

* Anchors. For every position p whose string lies in its text, m(p) is the position in
  [p, p + W) whose GRAM-byte hash is smallest (leftmost on ties). Equal strings choose equal places,
  so two equal strings meet at a pair of anchors. About one byte in W / 2 is an anchor.
* A block is a run of positions with one anchor, at most ``size`` of them. All its strings share
  length - size + 1 bytes; the fingerprint of these (of the first SHARED of them in the first round) is the block's
  first rank. The fingerprint of all bytes that its strings cover is its second.
* A round deals blocks out by rank. A block with a unique first rank is done: nothing of it occurs
  elsewhere. Blocks with equal second ranks cover all of their strings; one of them goes on for its class
  where a block with the same first rank is still open, and so does that one. The next round cuts
  them smaller, so that the ranked prefix grows (128, 385 and 400 bytes) until it passes ``length``.
* The first ranks also tell passages too short to be removed: ``longest_shared`` is the length of the text's longest run of
  neighbouring anchors (none further from the next than a window) whose SHARED bytes also start in another document,
  from the first anchor to the end of the last one's bytes. Every passage of window + SHARED + GRAM bytes that two documents share
  holds such an anchor in both; the figure is a lower bound of the passage's length where one document holds it all.

A rank is a fingerprint, so equal ranks need no renumbering between rounds; second ranks have 128 bits.
Ranks are counted with map-side aggregation, and the counts are materialised before they are joined
back, so that a rank that a third of all texts hold is split between tasks. Blocks with unique ranks, and texts
in which nothing matched, are held back by Bloom filters of fixed size before anything is shuffled.

Defined results: a null text is empty; nothing is removed from texts shorter than ``length``; rows
that repeat (also with the same id) are texts of their own and copies of each other; null ids are
kept. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm import bloom
from tokenloom.llm.common import Rolling, chunks, lean, materialize, mix, spans_of

LENGTH = 400
GRAM = 24
SHARED = 128                    # bytes at an anchor that the first round ranks
PIECE = 1 << 20                 # bytes looked at together
LOCAL = np.uint64((1 << 24) - 1)
SIZES = (16, 1)                 # block sizes after the first round


def window(length: int) -> int:
    """Positions from which an anchor is chosen; the gram stays inside every string."""
    return max(1, min(length * 12 // 25, length - GRAM + 1))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size, out = 1, x
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == w else np.minimum(out[:len(out) - (w - size)], out[w - size:])


def _pieces(off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, first byte, end of start positions): rows together, or parts of a long row."""
    for i, j in chunks(off, PIECE):
        if j == i + 1:
            for s in range(int(off[i]), int(off[j]), PIECE):
                yield i, j, s, min(s + PIECE, int(off[j]))
        else:
            yield i, j, int(off[i]), int(off[j])


def _anchors(data: np.ndarray, off: np.ndarray, length: int, one: Rolling, two: Rolling) -> Iterator[tuple]:
    """(row, lo, hi, anchor, first rank, two halves of the second rank) arrays; lo..hi are start positions."""
    w = window(length)
    core = min(length - w + 1, SHARED)
    for i, j, s, e in _pieces(off):
        end = min(e + length, int(off[j]))
        d = data[s:end]
        if len(d) < length:
            continue
        ok = np.zeros(len(d), bool)
        for r in range(i, j):
            a, b = max(int(off[r]), s) - s, min(int(off[r + 1]) - length + 1, e) - s
            if b > a:
                ok[a:b] = True
        p = np.flatnonzero(ok)
        if not len(p):
            continue
        one.load(d)
        two.load(d)
        n = len(d) - GRAM + 1
        g = (one.sum[GRAM:] - one.sum[:n]) * one.inv[:n]
        g = (g ^ (g >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        g = (g & ~LOCAL) | np.arange(n, dtype=np.uint64)
        m = (_sliding_min(g, w)[p] & LOCAL).astype(np.int64)
        cut = np.flatnonzero((m[1:] != m[:-1]) | (p[1:] != p[:-1] + 1)) + 1
        lo, hi = p[np.concatenate(([0], cut))], p[np.concatenate((cut - 1, [len(p) - 1]))]
        at = m[np.concatenate(([0], cut))]
        row = np.searchsorted(off[i:j + 1] - s, lo, side="right") - 1 + i
        shape = mix(((at - lo).astype(np.uint64) << np.uint64(32)) | (hi - lo).astype(np.uint64))
        yield (row, lo + s - off[row], hi + s - off[row], at + s - off[row], one.span(at, at + core),
               one.span(lo, hi + length) ^ shape, two.span(lo, hi + length) ^ shape)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _schema(texts: DataFrame) -> T.StructType:
    return T.StructType([texts.schema["doc_id"], texts.schema["th"]]
                        + [T.StructField(c, T.IntegerType()) for c in ("lo", "hi", "at")] + [T.StructField("need", T.BooleanType())]
                        + [T.StructField(c, T.LongType()) for c in ("c", "f1", "f2")])


def _batch(b: pa.RecordBatch, names: list[str], row: np.ndarray, ints: tuple, need: np.ndarray, ranks: tuple) -> pa.RecordBatch:
    idx = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [b.column("doc_id").take(idx), b.column("th").take(idx), *(pa.array(x.astype(np.int32)) for x in ints),
         pa.array(need), *(_signed(x) for x in ranks)], names=names)


def anchors(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """The first blocks of ``texts`` (doc_id, th, bytes): one for every anchor."""
    schema = _schema(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        one, two = Rolling(1, PIECE + length), Rolling(2, PIECE + length)
        for b in batches:
            data, off = spans_of(b.column("bytes"))
            for row, lo, hi, at, c, f1, f2 in _anchors(data, off, length, one, two):
                yield _batch(b, schema.names, row, (lo, hi, at), np.ones(len(row), bool), (c, f1, f2))

    return texts.mapInArrow(run, schema)


def blocks(texts: DataFrame, size: int, length: int = LENGTH) -> DataFrame:
    """The blocks of ``texts`` (doc_id, th, bytes, parts) cut to at most ``size`` positions."""
    schema = _schema(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        one, two = Rolling(1, PIECE), Rolling(2, PIECE)
        for b in batches:
            data, off = spans_of(b.column("bytes"))
            parts = b.column("parts")
            flat, begin = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
            begin = begin - begin[0]
            lo_all, hi_all, at_all, need_all = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            held, n = [], 0
            for r in range(b.num_rows):
                order = np.argsort(lo_all[begin[r]:begin[r + 1]], kind="stable") + begin[r]
                lo, hi, at = (x[order].astype(np.int64) for x in (lo_all, hi_all, at_all))
                need, k = need_all[order], 0
                while k < len(lo):                         # parts that lie near each other
                    z = max(k + 1, int(np.searchsorted(lo, lo[k] + PIECE // 2, side="left")))
                    base = int(lo[k])
                    d = data[off[r] + base:off[r] + int(hi[k:z].max()) + length]
                    one.load(d)
                    two.load(d)
                    near, far = (at[k:z] - hi[k:z]) // size, (at[k:z] - lo[k:z]) // size
                    count = far - near + 1
                    src = np.repeat(np.arange(k, z), count)
                    cell = np.repeat(near - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                    last = at[src] - cell * size                    # the block's positions, before they are clipped
                    a, e = np.maximum(lo[src], last - size + 1), np.minimum(hi[src], last)
                    shape = mix(((at[src] - a).astype(np.uint64) << np.uint64(32)) | (e - a).astype(np.uint64))
                    rank = one.span(last - base, last - size + 1 + length - base) ^ mix((at[src] - last).astype(np.uint64))
                    held.append((np.full(len(a), r), a, e, at[src], need[src], rank, one.span(a - base, e - base + length) ^ shape,
                                 two.span(a - base, e - base + length) ^ shape))
                    n += len(a)
                    k = z
                    if n > 100_000:
                        yield pack(b, held)
                        held, n = [], 0
            if held:
                yield pack(b, held)

    def pack(b: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        row, lo, hi, at, need, c, f1, f2 = (np.concatenate(x) for x in zip(*held, strict=True))
        return _batch(b, schema.names, row, (lo, hi, at), need, (c, f1, f2))

    return texts.mapInArrow(run, schema)


def _round(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks covered as a whole, blocks to cut further, all blocks that may have a repeated first rank) of one round's ranked blocks."""
    rows = materialize(rows, f"blocks{name}")
    held = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).where("n > 1 and need")
    held = materialize(held.select("c"), f"ranks{name}")
    left = materialize(rows.where(bloom.native(held, "c")(F.col("c"))).withColumn("tag", F.xxhash64("doc_id", "th", "lo")), f"left{name}")
    classes = materialize(left.groupBy("c", "f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.min("tag").alias("first"),
                                                            F.max("need").alias("need")), f"classes{name}")
    open_ = materialize(classes.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("need") & (F.col("n") == 1)).alias("open"))
                        .where("k > 1 and open").select("c", "open"), f"open{name}")
    classes = materialize(classes.join(open_, "c", "left").where("need and n > 1 or open").drop("need"), f"judged{name}")
    judged = materialize(left.join(classes, ["c", "f1", "f2"]).select(
        "doc_id", "th", "lo", "hi", "at", (F.col("need") & (F.col("n") > 1)).alias("copy"), (F.col("need") & (F.col("n") == 1)).alias("need"),
        (F.col("open").isNotNull() & ((F.col("n") == 1) | (F.col("tag") == F.col("first")))).alias("further")), f"round{name}")
    return judged.where("copy"), judged.where("further"), left


def _shared(left: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, longest_shared) of texts with an anchor whose first rank another document has too."""
    left = left.select("doc_id", "th", "at", "c", F.xxhash64("doc_id", "th").alias("doc"))
    many = materialize(left.groupBy("c").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x <> y").select("c"), "shared")
    places = left.join(many, "c").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("at")).alias("at"))
    start = F.struct(F.get("at", F.lit(0)).alias("first"), F.get("at", F.lit(0)).alias("last"), F.lit(0).alias("best"))

    def go_on(run: Column, at: Column) -> Column:
        first = F.when(at - run["last"] > window(length), at).otherwise(run["first"])
        return F.struct(first.alias("first"), at.alias("last"), F.greatest(run["best"], at - first).alias("best"))

    reach = min(length - window(length) + 1, SHARED)
    return places.select("doc_id", "th", (F.aggregate("at", start, go_on)["best"] + reach).cast("bigint").alias("longest_shared"))


def _touched(texts: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts that may have a row in ``keys``, the others): a filter of fixed size, no shuffle."""
    texts = texts.withColumn("_key", F.xxhash64("doc_id", "th"))
    hit = bloom.native(keys.select(F.xxhash64("doc_id", "th").alias("key")), "key")(F.col("_key"))
    return texts.where(hit).drop("_key"), texts.where(~hit).drop("_key")


def _same_text(texts: DataFrame, per_text: DataFrame, how: str) -> DataFrame:
    other = per_text.withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    return texts.join(other, texts["doc_id"].eqNullSafe(other["_id"]) & (texts["th"] == other["_th"]), how).drop("_id", "_th")


def repeated(texts: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, lo, end): byte ranges (not merged) covered by strings that occur twice; and (doc_id, th, longest_shared)."""
    covered, further, first = _round(anchors(texts, length), "0")
    for k, size in enumerate(SIZES, 1):
        parts = materialize(further.groupBy("doc_id", "th").agg(
            F.collect_list(F.struct("lo", "hi", "at", "need")).alias("parts")), f"parts{k}")
        touched, _ = _touched(texts, parts)
        more, further, _ = _round(blocks(_same_text(touched, parts, "inner"), size, length), str(k))
        covered = covered.unionByName(more)
    return covered.select("doc_id", "th", "lo", (F.col("hi") + length).alias("end")), _shared(first, length)


def dedup(docs: DataFrame, length: int = LENGTH, text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end; merged) and longest_shared of every row;
    ``with_kept`` adds the bytes that stay."""
    texts = docs.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"))
    texts = texts.withColumn("th", F.xxhash64("bytes"))
    ranges, shared = repeated(texts, length)
    per_text = ranges.select("doc_id", "th", F.struct("lo", "end").alias("part"), F.lit(0).cast("bigint").alias("longest_shared")).unionByName(
        shared.withColumn("part", F.lit(None).cast("struct<lo:int,end:int>")))
    spans = materialize(per_text.groupBy("doc_id", "th").agg(F.collect_list("part").alias("parts"), F.max("longest_shared").alias("longest_shared")), "spans")
    hit, clean = _touched(texts, spans)
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([texts.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
                           T.StructField("spans", span_type), T.StructField("longest_shared", T.LongType())]
                          + ([T.StructField("kept", T.BinaryType())] if with_kept else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            if not b.num_rows:
                continue
            data, off = spans_of(b.column("bytes"))
            parts = b.column("parts")
            flat, at = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
            at = at - at[0]
            lo_all, end_all = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            cols: dict[str, list] = {c: [] for c in schema.names[1:]}
            for r in range(b.num_rows):
                d, s, e = data[off[r]:off[r + 1]], lo_all[at[r]:at[r + 1]], end_all[at[r]:at[r + 1]]
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order]) if len(e) else e
                new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1]))) if len(s) else np.zeros(0, np.int64)
                s, e = s[new], e[np.concatenate((new[1:] - 1, [len(e) - 1]))] if len(new) else e
                edges = np.concatenate(([0], np.stack((s, e), 1).ravel(), [len(d)])).astype(np.int64)
                kept = b"".join(d[edges[i]:edges[i + 1]].tobytes() for i in range(0, len(edges), 2))
                cols["n_bytes"].append(len(d))
                cols["n_removed"].append(len(d) - len(kept))
                cols["n_spans"].append(len(s))
                cols["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                cols["longest_shared"].append(b.column("longest_shared")[r].as_py())
                cols["spans"].append([{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)])
                if with_kept:
                    cols["kept"].append(kept)
            types = {"spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), "kept": pa.binary(),
                     "kept_sha256": pa.string()}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, types.get(c, pa.int64())) for c, v in cols.items())],
                                             names=schema.names)

    marked = _same_text(hit, spans, "left").withColumns({
        "parts": F.coalesce("parts", F.array().cast("array<struct<lo:int,end:int>>")), "longest_shared": F.coalesce("longest_shared", F.lit(0).cast("bigint"))})
    done = marked.select("doc_id", "bytes", "parts", "longest_shared").mapInArrow(run, schema)
    zero = F.lit(0).cast("bigint")
    rest = clean.select("doc_id", F.octet_length("bytes").cast("bigint").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
                        F.sha2("bytes", 256).alias("kept_sha256"), F.array().cast(span_type).alias("spans"), zero.alias("longest_shared"),
                        *([F.col("bytes").alias("kept")] if with_kept else []))
    return done.unionByName(rest)
