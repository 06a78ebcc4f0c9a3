"""Operator 13: ranked lexical search over K2-treaps.

Terms are maximal runs of digits, letters and non-ASCII characters; only A-Z is lower-cased. Statistics over all documents come
first: N documents with a term, L terms in all, and the document frequencies of the query terms. Then each task indexes
shards of its documents: a term-document grid whose points are impacts (a term's share of a document's score before
the term's weight). The grid is a K2-treap: every cell of the quadtree that holds points is a node, keeps the largest
of them and gives the rest to its quadrants, so there is one node a posting, and a node bounds all below it. Nodes
lie in level order with a four-bit mask of their quadrants; the place of a child follows from counting mask bits.

A query descends in every shard along the rows of its terms at once: a state is a range of documents with one
cell a term; its bound is the best partial score found in it plus the weighted maxima of the cells. The states of
highest bound are split first, a wave at a time, and states below the k-th best score so far are dropped, equal ones
not. So the shard's answer is exact; the answers of all shards are merged in a window with a group limit.

Queries are handed to tasks in blocks of about BLOCK_TERMS terms, one pass over the index a block, each removed
when its pass is written. A task holds one shard.

Defined results: a null text has no terms and is never found; an item without terms, or whose terms no document
has, returns nothing; repeated document rows are documents each, with equal scores in no order among themselves if
their ids are equal too; null document ids come first among equal scores; items that repeat an id with another text
are answered each, equal rows of items once; a text of any length is indexed whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from tokenloom.llm.common import Rolling, chunks, lean, materialize, parts, spans_of
from tokenloom.llm.decontaminate import PIECE, word_spans

SHARD = 12 << 20             # bytes of text under one treap
BLOCK_TERMS = 1_000_000      # (item, term) rows handed to tasks at a time
WAVE = 256                   # states split together
_SEED = 13
_DOCUMENTS, _LENGTH = -1, -2         # places of N and L among the counted terms


def _terms(data: np.ndarray, off: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every term; the hashes stay clear of the two reserved values."""
    start, _, h = word_spans(data, off, rolling)
    n = np.diff(np.searchsorted(start, off))
    return np.repeat(np.arange(len(n)), n), np.minimum(h, np.uint64(2**64 - 3))


def _counted(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, occurrences), sorted by hash and text."""
    order = np.argsort(h, kind="stable")
    text, h = text[order], h[order]
    if not len(h):
        return text, h, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1]))))
    return text[new], h[new], np.diff(np.concatenate((new, [len(h)])))


# ---- the index of one shard -----------------------------------------------------------------------

def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of x at the even places."""
    x = x.astype(np.uint64)
    for s, m in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(s))) & np.uint64(m)
    return x


def _gather(x: np.ndarray) -> np.ndarray:
    """The bits at the even places of x."""
    x = x & np.uint64(0x5555555555555555)
    for s, m in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> np.uint64(s))) & np.uint64(m)
    return x.astype(np.int64)


def _width(bits: int) -> str:
    return "<u2" if bits <= 16 else "<u4" if bits <= 32 else "<u8"


_ONES = np.array([bin(i).count("1") for i in range(16)], np.int64)


@dataclass
class Treap:
    """Level-ordered nodes: mask of quadrants (2 * row half + column half), impact, and place of the extracted point in its cell."""

    height: int
    sizes: np.ndarray        # nodes of each level
    masks: np.ndarray
    impacts: np.ndarray
    places: bytes            # level by level, as wide as the level's cells need

    @classmethod
    def build(cls, row: np.ndarray, col: np.ndarray, impact: np.ndarray) -> Treap:
        height = int(max(row.max(initial=0), col.max(initial=0))).bit_length()
        code = (_spread(row) << np.uint64(1)) | _spread(col)
        order = np.argsort(code, kind="stable")
        code, value = code[order], impact[order].astype(np.uint64)
        prefixes, masks, impacts, places = [], [], [], []
        for level in range(height + 1):
            if not len(code):
                break
            bits = 2 * (height - level)
            cell = code >> np.uint64(bits)
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            at = np.arange(len(code), dtype=np.uint64)
            top = np.maximum.reduceat(value << np.uint64(32) | (np.uint64(0xFFFFFFFF) - at), first)
            top = (np.uint64(0xFFFFFFFF) - (top & np.uint64(0xFFFFFFFF))).astype(np.int64)
            prefixes.append(cell[first])
            impacts.append(value[top].astype("<i4"))
            places.append((code[top] & np.uint64((1 << bits) - 1)).astype(_width(bits)).tobytes())
            stay = np.ones(len(code), bool)
            stay[top] = False
            code, value = code[stay], value[stay]
        for up, down in zip(prefixes, [*prefixes[1:], np.zeros(0, np.uint64)], strict=True):
            at = np.searchsorted(up, down >> np.uint64(2))
            masks.append(np.bincount(at, 1 << (down & np.uint64(3)).astype(np.int64), len(up)).astype(np.uint8))
        return cls(height, np.array([len(p) for p in prefixes], np.int64), np.concatenate(masks), np.concatenate(impacts), b"".join(places))

    def open(self) -> None:
        """Places of children, and row and column of every node's point."""
        ones = _ONES[self.masks]
        self.child = 1 + np.cumsum(ones) - ones
        self.row, self.col = np.zeros(len(self.masks), np.int64), np.zeros(len(self.masks), np.int64)
        cell, read, node = np.zeros(1, np.uint64), 0, 0
        for level, n in enumerate(self.sizes.tolist()):
            bits = 2 * (self.height - level)
            kind = np.dtype(_width(bits))
            place = np.frombuffer(self.places, kind, n, read).astype(np.uint64)
            read += n * kind.itemsize
            code = cell << np.uint64(bits) | place
            self.row[node:node + n], self.col[node:node + n] = _gather(code >> np.uint64(1)), _gather(code)
            here = self.masks[node:node + n]
            quadrant = np.flatnonzero(np.unpackbits(here.astype(np.uint8)[:, None], axis=1, count=4, bitorder="little").ravel())
            cell = cell[quadrant >> 2] << np.uint64(2) | (quadrant & 3).astype(np.uint64)
            node += n

    def top(self, rows: np.ndarray, weights: np.ndarray, n_docs: int, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(column, score) of all documents whose weighted sum over rows is among the k best (ties with the k-th too) and
        at least ``least``, in no order.

        States are ranges of documents (level, part of the level); (of, term, node) are the cells of their terms,
        state by state, without cells in which nothing is left.
        """
        score = np.zeros(n_docs + 1, np.int64)           # the last place closes ranges
        masks, impacts, child, row, col, height = self.masks, self.impacts, self.child, self.row, self.col, self.height
        none = np.zeros(0, np.int64)

        def kth() -> int:
            return max(least, int(np.partition(score, -k)[-k])) if n_docs > k else least

        def visit(of: np.ndarray, term: np.ndarray, node: np.ndarray, level: np.ndarray, part: np.ndarray):
            """Scores the points of the terms' own rows; the states and cells in which something is left, and bounds."""
            v = impacts[node] * weights[term]
            own = np.flatnonzero(row[node] == rows[term])
            np.add.at(score, col[node[own]], v[own])
            left = np.flatnonzero(masks[node])
            of, term, node, v = of[left], term[left], node[left], v[left]
            if not len(of):
                return of, term, node, none, none, none
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            level, part = level[of[first]], part[of[first]]
            lo = part << (height - level)
            hi = np.minimum((part + 1) << (height - level), n_docs)
            bound = np.add.reduceat(v, first) + np.maximum.reduceat(score, np.column_stack((lo, hi)).ravel())[::2]
            return np.repeat(np.arange(len(first)), np.diff(np.append(first, len(of)))), term, node, level, part, bound

        if len(rows) and len(masks):
            of, term, node, level, part, bound = visit(np.zeros(len(rows), np.int64), np.arange(len(rows)), np.zeros(len(rows), np.int64),
                                                       np.zeros(1, np.int64), np.zeros(1, np.int64))
        else:
            bound = none
        while len(bound):
            state = np.flatnonzero(bound >= kth())
            if not len(state):
                break
            turn = np.zeros(len(bound), np.int8)         # 0 dropped, 1 waits, 2 is split
            turn[state] = 1
            turn[state if len(state) <= WAVE else state[np.argpartition(-bound[state], WAVE)[:WAVE]]] = 2
            what = turn[of]
            go, rest = np.flatnonzero(what == 2), np.flatnonzero(what == 1)
            s, t, n = of[go], term[go], node[go]
            mask = masks[n]
            low = 2 * ((rows[t] >> (height - 1 - level[s])) & 1)          # the quadrants left and right of the row's half
            first = child[n] + _ONES[mask & ((1 << low) - 1)]
            l, r = np.flatnonzero(mask >> low & 1), np.flatnonzero(mask >> (low + 1) & 1)
            down = np.concatenate((first[l], first[r] + (mask[r] >> low[r] & 1)))
            new = visit(np.concatenate((s[l], s[r] + len(bound))), np.concatenate((t[l], t[r])), down,
                        np.concatenate((level, level)) + 1, np.concatenate((2 * part, 2 * part + 1)))
            wait = np.flatnonzero(turn == 1)
            number = np.cumsum(turn == 1) - 1
            of, term, node = (np.concatenate(x) for x in ((number[of[rest]], new[0] + len(wait)), (term[rest], new[1]), (node[rest], new[2])))
            level, part, bound = (np.concatenate((x[wait], y)) for x, y in zip((level, part, bound), new[3:], strict=True))
        at = np.flatnonzero(score[:n_docs] >= kth())
        return at, score[at]


# ---- jobs -------------------------------------------------------------------------------------------

def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, item, term, n): the terms of every distinct item row with their repeats."""
    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("body")).where("body is not null").distinct()
    rows = rows.withColumn("key", F.sha2(F.concat_ws(":", F.coalesce(F.col("item").cast("string"), F.lit("?")), "body"), 256))
    schema = rows.select("key", "item").withColumn("term", F.lit(0).cast("bigint")).withColumn("n", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        rolling = Rolling(_SEED, PIECE)
        for b in parts(batches, "body"):
            data, off = spans_of(b.column("body").cast(pa.binary()))
            text, h, n = _counted(*_terms(data, off, rolling))
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(text)), b.column("item").take(pa.array(text)), pa.array(h.view(np.int64)),
                                              pa.array(n, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def statistics(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): document frequencies of the given terms, and N and L under the terms -1 and -2. One pass; only
    distinct terms of a shard leave a task, and only wanted ones are shuffled."""
    wanted = terms.select("term").distinct().union(docs.sparkSession.createDataFrame([(_DOCUMENTS,), (_LENGTH,)], "term bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        rolling, whole, long = Rolling(_SEED, PIECE), 0, 0
        for b in parts(batches, text_col):
            data, off = spans_of(b.column(0).cast(pa.binary()))
            for i, j in chunks(off, SHARD):
                text, h = _terms(data, off[i:j + 1], rolling)
                whole, long = whole + len(np.unique(text)), long + len(h)
                _, h, _ = _counted(text, h)
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["term", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([_DOCUMENTS, _LENGTH], pa.int64()), pa.array([whole, long], pa.int64())], names=["term", "n"])

    found = docs.select(text_col).mapInArrow(run, "term bigint, n bigint")
    return found.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))


def index(docs: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a shard: ids of its documents, its terms with their rows, and the K2-treap of impacts."""
    docs = docs.select(id_col, text_col)
    fields = [("terms", BinaryType()), ("rows", BinaryType()), ("height", IntegerType()), ("sizes", BinaryType()), ("masks", BinaryType()),
              ("impacts", BinaryType()), ("places", BinaryType())]
    schema = StructType([StructField("ids", ArrayType(docs.schema[0].dataType)), *(StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        rolling = Rolling(_SEED, PIECE)
        for b in parts(batches, text_col, SHARD):
            data, off = spans_of(b.column(1).cast(pa.binary()))
            for i, j in chunks(off, SHARD):
                text, h = _terms(data, off[i:j + 1], rolling)
                n = np.bincount(text, minlength=j - i)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                order = some[np.argsort(n[some], kind="stable")]         # documents of like length are neighbours
                column = np.zeros(j - i, np.int64)
                column[order] = np.arange(len(order))
                text, h, tf = _counted(text, h)
                m = 100 - 25 + (25 * n[text] * n_docs) // n_terms
                impact = (1_000_000_000 * tf) // (1_000 * tf + 12 * m)
                term, of, df = np.unique(h, return_inverse=True, return_counts=True)
                row = np.zeros(len(term), np.int64)
                row[np.argsort(-df, kind="stable")] = np.arange(len(term))   # and terms of like frequency
                t = Treap.build(row[of], column[text], impact)
                ids = b.column(0).take(pa.array(order + i))
                values = [term.tobytes(), row.astype("<i4").tobytes(), t.height, t.sizes.astype("<i8").tobytes(), t.masks.tobytes(),
                          t.impacts.tobytes(), t.places]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                     *(pa.array([v], pa.int32() if isinstance(v, int) else pa.binary()) for v in values)], names=schema.names)

    return docs.mapInArrow(run, schema)


def _pass(shards: DataFrame, block: pa.Table, k: int, schema: StructType) -> DataFrame:
    """Answers of every shard to the queries of a block (rows key, item, term, weight, sorted by key)."""
    shared = shards.sparkSession.sparkContext.broadcast(block)      # at most about BLOCK_TERMS rows and one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        block = shared.value.combine_chunks()
        keys = block.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        end = np.concatenate((begin[1:], [len(keys)]))
        want = block.column("term").to_numpy().view(np.uint64)
        weight = block.column("weight").to_numpy()
        best = np.zeros((len(begin), k), np.int64)       # of the shards that this task has seen
        for b in batches:
            for x in range(b.num_rows):
                raw = {c: b.column(c)[x].as_buffer() for c in ("terms", "rows", "sizes", "masks", "impacts", "places")}
                term, row = np.frombuffer(raw["terms"], np.uint64), np.frombuffer(raw["rows"], "<i4").astype(np.int64)
                ids = b.column("ids")[x].values
                treap = Treap(b.column("height")[x].as_py(), np.frombuffer(raw["sizes"], "<i8"), np.frombuffer(raw["masks"], np.uint8).astype(np.int64),
                              np.frombuffer(raw["impacts"], "<i4").astype(np.int64), raw["places"])
                treap.open()
                at = np.minimum(np.searchsorted(term, want), len(term) - 1)
                known = (term[at] == want) & (weight > 0)
                which, docs, scores = [], [], []
                for q, (s, e) in enumerate(zip(begin, end, strict=True)):
                    use = s + np.flatnonzero(known[s:e])
                    d, v = treap.top(row[at[use]], weight[use], len(ids), k, max(1, int(best[q, 0])))
                    best[q] = np.partition(np.concatenate((best[q], v)), len(v))[len(v):]
                    best[q].sort()
                    which.append(np.full(len(d), s))
                    docs.append(d)
                    scores.append(v)
                w = pa.array(np.concatenate(which))
                yield pa.RecordBatch.from_arrays([block.column("key").combine_chunks().take(w), block.column("item").combine_chunks().take(w),
                                                  ids.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores), pa.int64())],
                                                 names=schema.names)

    return shards.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
           block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item id, rank, document id, score): each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    terms = materialize(item_terms(items, item_col, text_col), "item-terms")
    stats = materialize(statistics(docs, terms, text_col), "term-statistics")
    total = {r["term"]: r["n"] for r in stats.where(F.col("term").isin(_DOCUMENTS, _LENGTH)).collect()}
    n, length = total.get(_DOCUMENTS, 0), total.get(_LENGTH, 0)
    w = F.floor(1000 * F.log((F.lit(2.0) * n + 2) / (2.0 * F.col("df") + 1))).cast("bigint")
    weighted = materialize(terms.join(stats.withColumnRenamed("n", "df"), "term").select("key", "item", "term", (w * F.col("n")).alias("weight")),
                           "term-weights")
    shards = materialize(index(docs, n, length, id_col, text_col), "treaps")
    schema = StructType([StructField("key", weighted.schema["key"].dataType), StructField("item", weighted.schema["item"].dataType),
                         StructField("doc", docs.schema[id_col].dataType), StructField("score", weighted.schema["weight"].dataType)])
    blocks = -(-weighted.count() // block_terms)
    found = []
    for i in range(blocks):
        block = weighted.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i).toArrow().sort_by("key")
        answers = _pass(shards, block, k, schema) if block.num_rows else spark.createDataFrame([], schema)
        found.append(materialize(answers, "answers") if blocks > 1 else answers)
    answers = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("doc").asc())
    best = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
