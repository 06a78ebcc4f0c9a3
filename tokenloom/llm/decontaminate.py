"""Operator 10: benchmark decontamination with an FM-index per training shard.

Test phrases are windows of ``window`` consecutive words of a benchmark item (an item of fewer words,
but not none, is one window). Words are maximal runs of characters other than ASCII ones outside
0-9 and a-z, after A-Z is lower-cased. Texts are searched in shards of about SHARD bytes, each inside one
Spark task: words that no phrase has separate the shard's word sequence, an FM-index is built over
what is left, all phrases are searched backward through wavelet ranks, and occurrences are located by
sampled positions and merged into removal spans per text. It is a map over texts without a shuffle.

The benchmark is handed to tasks in blocks of about BLOCK_BYTES of item text, one pass over the texts for
each block, so what a task holds does not grow with the benchmark.

Defined results: a null text has no words; an item without words has no windows; a null item id is
listed as the empty string; items that repeat an id share it; repeated rows are judged each by
themselves; long texts are one shard of their own and are searched whole; an empty benchmark or table
gives no hits. Columns named as results replace input columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import Rolling, chunks, lean, parts, spans_of
from tokenloom.llm.fm_index import FMIndex

WINDOW = 10
SHARD = 4 << 20
PIECE = 1 << 20
BLOCK_BYTES = 16 << 20
RANGES = "array<struct<first:int,last:int,start:int,end:int>>"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def word_spans(data: np.ndarray, off: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word of the texts that ``off`` cuts ``data`` into, in order."""
    starts, ends, hashes = [], [], []
    s, stop, cuts = int(off[0]), int(off[-1]), off
    while s < stop:
        e = min(s + PIECE, stop)
        if e < stop:                                   # do not cut a word: go on to its end
            while e < stop and _WORD[_FOLD[data[e]]] and e not in cuts[np.searchsorted(cuts, e):][:1]:
                e += 1
        d = _FOLD[data[s:e]]
        w = _WORD[d]
        edge = np.zeros(len(d) + 1, bool)              # texts begin at cuts
        inner = cuts[np.searchsorted(cuts, s):np.searchsorted(cuts, e, side="right")] - s
        edge[inner] = True
        first = w & (edge[:-1] | ~np.concatenate(([False], w[:-1])))
        last = w & (edge[1:] | ~np.concatenate((w[1:], [False])))
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        rolling.load(d)
        starts.append(a + s)
        ends.append(b + s)
        hashes.append(rolling.span(a, b))
        s = e
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


@dataclass
class Phrases:
    vocabulary: np.ndarray         # sorted word hashes; a word's number is its place + 1
    windows: np.ndarray            # word numbers, right-aligned
    lengths: np.ndarray
    items: list[list[str]]         # item ids of every window


def phrases(items: list[tuple[str, str]], window: int) -> Phrases:
    rolling, texts = Rolling(5, PIECE), [(t or "").encode("utf-8", "replace") for _, t in items]
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    start, _, h = word_spans(data, off, rolling)
    vocab, number = np.unique(h, return_inverse=True)
    at = np.searchsorted(start, off)
    found: dict[tuple[int, ...], set[str]] = {}
    for k, (item, _) in enumerate(items):
        w = (number[at[k]:at[k + 1]] + 1).tolist()
        for i in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[i:i + window]), set()).add(item)
    keys = sorted(found)
    mat = np.zeros((len(keys), window), np.int64)
    for r, k in enumerate(keys):
        mat[r, window - len(k):] = k
    return Phrases(vocab, mat, np.array([len(k) for k in keys], np.int64), [sorted(found[k]) for k in keys])


def occurrences(number: np.ndarray, text_of: np.ndarray, ph: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of every occurrence in a shard's words (numbers, 0 for unknown words)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(number) or not len(ph.lengths):
        return none
    # runs of known words of one text; runs shorter than every phrase hold none
    brk = np.concatenate(([True], (text_of[1:] != text_of[:-1]) | (number[1:] == 0) | (number[:-1] == 0)))
    begin = np.flatnonzero(brk)
    size = np.diff(np.concatenate((begin, [len(number)])))
    good = (number[begin] > 0) & (size >= ph.lengths.min())
    begin, size = begin[good], size[good]
    if not len(begin):
        return none
    goes = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    seq = np.zeros(int((size + 1).sum()), np.int64)
    src = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    dst = np.repeat(goes - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    seq[dst] = number[src]
    word = np.full(len(seq), -1, np.int64)
    word[dst] = src
    index = FMIndex(seq, len(ph.vocabulary) + 1)
    lo, hi = index.search(ph.windows, ph.lengths)
    count = hi - lo
    rows = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    return word[index.locate(rows)], np.repeat(np.arange(len(count)), count)


def _merge(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open word ranges."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate(([True], a[1:] > b[:-1]))
    return a[new], b[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(b) - 1]))]


def _pass(docs: DataFrame, ph: Phrases, text_col: str) -> DataFrame:
    """Adds the hits of one block of phrases to the columns n_words, ranges and items."""
    shared = docs.sparkSession.sparkContext.broadcast(ph)       # at most a block of the benchmark
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        ph, rolling = shared.value, Rolling(5, PIECE)
        for b in parts(batches, text_col):
            col = b.column(text_col).cast(pa.binary())
            data, off = spans_of(col)
            n_words = np.zeros(b.num_rows, np.int64)
            old_r, old_i = b.column("ranges").to_pylist(), b.column("items").to_pylist()
            for i, j in chunks(off, SHARD):
                start, end, h = word_spans(data, off[i:j + 1], rolling)
                at = np.searchsorted(start, off[i:j + 1])
                n_words[i:j] = np.diff(at)
                pos = np.searchsorted(ph.vocabulary, h)
                known = np.zeros(len(h), np.int64)
                if len(ph.vocabulary):
                    same = ph.vocabulary[np.minimum(pos, len(ph.vocabulary) - 1)] == h
                    known = np.where(same, pos + 1, 0)
                first, which = occurrences(known, np.repeat(np.arange(j - i), np.diff(at)), ph)
                if not len(first):
                    continue
                text = np.searchsorted(at, first, side="right") - 1
                order = np.argsort(text, kind="stable")
                cut = np.flatnonzero(np.diff(text[order])) + 1
                for g in np.split(order, cut):
                    t = int(text[g[0]])
                    a, z = _merge(first[g], first[g] + ph.lengths[which[g]])
                    base = int(off[i + t])
                    new = [(int(x - at[t]), int(y - at[t]), int(start[x] - base), int(end[y - 1] - base)) for x, y in zip(a, z, strict=True)]
                    for r in old_r[i + t]:
                        new.append((r["first"], r["last"], r["start"], r["end"]))
                    merged: list[tuple[int, int, int, int]] = []
                    for r in sorted(new):
                        if merged and r[0] <= merged[-1][1]:
                            m = merged[-1]
                            merged[-1] = (m[0], max(m[1], r[1]), m[2], max(m[3], r[3]))
                        else:
                            merged.append(r)
                    old_r[i + t] = [dict(zip(("first", "last", "start", "end"), r, strict=True)) for r in merged]
                    old_i[i + t] = sorted({*old_i[i + t], *(x for w in set(which[g].tolist()) for x in ph.items[w])})
            rt = pa.list_(pa.struct([(c, pa.int32()) for c in ("first", "last", "start", "end")]))
            new_cols = {"n_words": pa.array(n_words), "ranges": pa.array(old_r, rt), "items": pa.array(old_i, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new_cols.get(c, b.column(c)) for c in names], names=names)

    return docs.mapInArrow(run, docs.schema)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, ranges (merged word ranges with their byte spans) and items (ids)."""
    docs = docs.drop("n_words", "ranges", "items").withColumns({
        "n_words": F.lit(0).cast("bigint"), "ranges": F.array().cast(RANGES), "items": F.array().cast("array<string>")})
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").alias("body")).where(
        "body is not null")
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k).collect()
        docs = _pass(docs, phrases([(r["item"], r["body"]) for r in part], window), text_col)
    return docs


def without_spans(text: str, ranges: str) -> Column:
    """The text without the byte spans of ``ranges``."""
    raw, r = F.col(text), F.col(ranges)
    n = F.size(r)
    b = raw.cast("binary")
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(
        b, F.when(i == 0, F.lit(0)).otherwise(r[F.greatest(i - 1, F.lit(0))]["end"]) + 1,
        F.when(i == n, F.octet_length(b)).otherwise(r[F.least(i, n - 1)]["start"])
        - F.when(i == 0, F.lit(0)).otherwise(r[F.greatest(i - 1, F.lit(0))]["end"])))
    return F.when(n > 0, F.aggregate(pieces, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).cast("string")).otherwise(raw)
