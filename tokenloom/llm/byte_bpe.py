"""Operator 12: byte-level BPE encoding and decoding in padded numpy matrices.

A text is cut by a pattern into pieces. Pieces that are no token themselves are put into buckets by length; a
bucket is a matrix with one padded row a piece. In each round every row merges its leftmost pair of
minimum rank: the pair's rank comes from an open-addressing hash table, the merged column is taken out, so all rows of a
bucket get one column shorter, and rows without a pair that merges leave the matrix. A piece longer than the widest
bucket is a row of its own that merges, in one round, all the occurrences that a left-to-right sequence of single
merges would (up to the first one that makes a pair of lower rank), so its rounds grow with ranks, not with bytes.

Encoding and decoding are maps over rows without a shuffle. A task holds the vocabulary, a chunk of text and at
most CACHE pieces that it has met. ``ids`` are little-endian unsigned 32-bit integers, packed.

Defined results: a null text is the empty text and has no ids; a text of any length is encoded whole; repeated
rows and repeated ids are encoded each by themselves; an empty table gives no rows. Input columns named as
results are replaced. Bytes that no token covers raise an error, as does an id outside the vocabulary.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from tokenloom.llm.common import lean, parts, slices, spans_of

CHUNK = 4 << 20          # bytes of text cut into pieces at a time
CACHE = 300_000          # pieces a task remembers
GROUP = 500_000          # pieces of one very long text taken at a time
WIDEST = 128             # longer pieces are rows of their own
NONE = np.int64(1) << 40
_ODD = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Ranks of pairs of token ids by open addressing; a lookup is a few gathers whatever the number of pairs."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int64)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        ranks = np.array(list(pairs.values()), np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == -1)
            s, first = np.unique(slot[free], return_index=True)
            self.keys[s], self.ranks[s] = keys[free[first]], ranks[free[first]]
            left = np.ones(len(keys), bool)
            left[free[first]] = False
            keys, ranks, slot = keys[left], ranks[left], (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of every pair, NONE where it does not merge or one side is padding (-1)."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        key = np.where((a < 0) | (b < 0), -2, a << 32 | (b & 0xFFFFFFFF))
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NONE)
        todo = np.flatnonzero((found != key) & (found != -1) & (key != -2))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


class Vocabulary:
    """Ranks of tokens, their pair table, and their bytes for decoding."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs = PairTable(pairs)
        self.token_len = np.full(max(ranks.values(), default=-1) + 1, -1, np.int64)
        by_id = sorted((r, t) for t, r in ranks.items())
        for r, t in by_id:
            self.token_len[r] = len(t)
        self.token_off = np.concatenate(([0], np.cumsum(np.maximum(self.token_len, 0))))
        self.token_bytes = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)

    # ---- encoding of pieces ---------------------------------------------------------------------

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token counts, all token ids in order) of pieces."""
        size = np.array([len(p) for p in pieces], np.int64)
        off = np.concatenate(([0], np.cumsum(size)))
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        if (ids < 0).any():
            raise ValueError("the vocabulary has no token for a byte of the text")
        count = size.copy()                              # the tokens of piece k end up in ids[off[k]:off[k] + count[k]]
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                ids[off[k]], count[k] = whole, 1
        todo = np.flatnonzero(count > 1)
        width = 2
        while len(todo) and width <= WIDEST:
            at = todo[(size[todo] <= width) & (size[todo] > width // 2)]
            for part in np.array_split(at, max(1, len(at) * width >> 22)):
                if len(part):
                    self._bucket(ids, off[part], size[part], count, part)
            width *= 2
        for k in todo[size[todo] > WIDEST]:
            t = self._long(ids[off[k]:off[k + 1]])
            ids[off[k]:off[k] + len(t)], count[k] = t, len(t)
        src = np.repeat(off[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        return count, ids[src]

    def _bucket(self, ids: np.ndarray, off: np.ndarray, size: np.ndarray, count: np.ndarray, where: np.ndarray) -> None:
        w = int(size.max())
        place = off[:, None] + np.arange(w)
        inside = np.arange(w) < size[:, None]
        m = np.where(inside, ids[np.where(inside, place, 0)], -1)
        r = np.full(m.shape, NONE, np.int64)
        r[:, :-1] = self.pairs(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(m), w - 1)
        n = size.copy()
        while len(m):
            j = r.argmin(axis=1)                         # the leftmost pair of minimum rank
            rows = np.arange(len(m))
            best = r[rows, j]
            done = best == NONE
            if done.any():
                for k in np.unique(n[done]):
                    sel = np.flatnonzero(done & (n == k))
                    ids[off[sel][:, None] + np.arange(k)] = m[sel, :k]
                    count[where[sel]] = k
                keep = ~done
                m, r, n, off, where, j, best = m[keep], r[keep], n[keep], off[keep], where[keep], j[keep], best[keep]
                rows = np.arange(len(m))
                if not len(m):
                    return
            m[rows, j] = best
            stay = np.ones(m.shape, bool)                # compaction: each row gives up one column
            stay[rows, j + 1] = False
            w = m.shape[1] - 1
            m, r, n = m[stay].reshape(len(m), w), r[stay].reshape(len(m), w), n - 1
            right = np.where(j + 1 < w, m[rows, np.minimum(j + 1, w - 1)], -1)
            left = np.where(j > 0, m[rows, np.maximum(j - 1, 0)], -1)
            r[rows, j] = self.pairs(best, right)
            new = self.pairs(left, best)
            has = j > 0
            r[rows[has], j[has] - 1] = new[has]

    def _long(self, t: np.ndarray) -> np.ndarray:
        r = np.concatenate((self.pairs(t[:-1], t[1:]), [NONE]))
        while True:
            best = r.min()
            if best == NONE:
                return t
            at = np.flatnonzero(r == best)
            run = np.cumsum(np.concatenate(([True], np.diff(at) > 1)))      # overlapping pairs: every other one
            first = np.searchsorted(run, run)
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            # single merges from left to right see these pairs; one of lower rank has to be merged first
            merged = np.full(len(at), best)
            before = np.where(at > 0, t[np.maximum(at - 1, 0)], -1)
            before = np.where(np.concatenate(([False], at[1:] - at[:-1] == 2)), best, before)
            after = np.where(at + 2 < len(t), t[np.minimum(at + 2, len(t) - 1)], -1)
            lower = np.flatnonzero(np.minimum(self.pairs(before, merged), self.pairs(merged, after)) < best)
            if len(lower):
                at = at[:lower[0] + 1]
            t[at] = best
            stay = np.ones(len(t), bool)
            stay[at + 1] = False
            t, r = t[stay], r[stay]
            at = at - np.arange(len(at))
            pad = np.concatenate((t, [-1]))
            r[at] = self.pairs(t[at], pad[at + 1])
            has = at[at > 0]
            r[has - 1] = self.pairs(t[has - 1], t[has])

    # ---- decoding ---------------------------------------------------------------------------------

    def text(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets of the tokens in them) of a sequence of ids."""
        if len(ids) and (ids.max() >= len(self.token_len) or (self.token_len[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        n = self.token_len[ids]
        off = np.concatenate(([0], np.cumsum(n)))
        src = np.repeat(self.token_off[ids] - off[:-1], n) + np.arange(off[-1])
        return self.token_bytes[src], off


class _Numbers(dict):
    """Numbers pieces in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        return n


def newer_letters() -> str:
    """Code points that the regex library counts as letters or numbers and the tiktoken library, by an older
    edition of Unicode, does not. Both libraries are asked; takes about a second."""
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    one_byte = {bytes([i]): i for i in range(256)}
    out: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        older = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks=one_byte, special_tokens={})
        out |= {*regex.findall(kind, every)} - {*older.decode(older.encode_ordinary(every))}
    return "".join(sorted(out))


class Encoder:
    """Encodes texts with a bounded memory of the pieces met before. The code points of ``other`` are cut as if they
    were neither letters nor numbers."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, other: str = ""):
        import regex

        self.vocabulary, self.cut = vocabulary, regex.compile(pattern)
        self.other = np.zeros(0x110000, bool)
        self.other[[ord(c) for c in other]] = True
        self.forget()

    def shadow(self, text: str) -> str:
        """The text with a private-use letter, of no class that patterns name, in place of the code points of ``other``."""
        if not text.isascii():
            codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
            odd = self.other[codes]
            if odd.any():
                return np.where(odd, 0xE000, codes).astype("<u4").tobytes().decode("utf-32-le")
        return text

    def pieces(self, text: str) -> Iterator[str]:
        return (text[m.start():m.end()] for m in self.cut.finditer(self.shadow(text)))

    def all_pieces(self, text: str) -> list[str]:
        shadow = self.shadow(text)
        return self.cut.findall(text) if shadow is text else list(self.pieces(text))

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.count, self.off, self.ids = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def tokens(self, pieces: Iterable[list[str]]) -> list[np.ndarray]:
        """Ids of each list of pieces."""
        number = [np.fromiter(map(self.numbers.__getitem__, p), np.int64, len(p)) for p in pieces]
        new = list(islice(self.numbers, len(self.count), None))
        if new:
            count, ids = self.vocabulary.merge([p.encode() for p in new])
            self.count = np.concatenate((self.count, count))
            self.off = np.concatenate((self.off, self.off[-1] + np.cumsum(count)))
            self.ids = np.concatenate((self.ids, ids.astype(np.uint32)))
        out = []
        for k in number:
            n = self.count[k]
            total = np.cumsum(n)
            src = np.repeat(self.off[k] - (total - n), n) + np.arange(total[-1] if len(n) else 0)
            out.append(self.ids[src])
        if len(self.numbers) > CACHE:
            self.forget()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        if sum(len(t or "") for t in texts) <= 2 * CHUNK:
            return [t.astype("<u4").tobytes() for t in self.tokens([self.all_pieces(t or "") for t in texts])]
        for t in texts:
            found, got = self.pieces(t or ""), []
            while group := list(islice(found, GROUP)):
                got.append(self.tokens([group])[0].astype("<u4").tobytes())
            out.append(b"".join(got))
        return out


def _with(batch: pa.RecordBatch, names: list[str], column: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([values if c == column else batch.column(c) for c in names], names=names)


def _schema(docs: DataFrame, column: str) -> StructType:
    return StructType([f for f in docs.schema.fields if f.name != column] + [StructField(column, BinaryType())])


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the packed ids of their texts. Tasks read the rank file themselves, so that every executor needs it.
    Letters and numbers are those of the tiktoken library."""
    schema, other = _schema(docs, ids_col), newer_letters()
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        encoder = Encoder(Vocabulary(read_ranks(ranks_path)), pattern, other)
        for b in parts(batches, text_col, CHUNK):
            for i, texts in slices(b, text_col, CHUNK):
                yield _with(b.slice(i, len(texts)), names, ids_col, pa.array(encoder.encode(texts), pa.binary()))

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that packed ids stand for; null ids are none."""
    schema = _schema(docs, bytes_col)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        vocabulary = Vocabulary(read_ranks(ranks_path))
        for b in parts(batches, ids_col, CHUNK):
            data, off = spans_of(b.column(ids_col))
            ids = np.frombuffer(data[off[0]:off[-1]].tobytes(), "<u4")
            raw, at = vocabulary.text(ids)
            cut = at[(off - off[0]) // 4]
            raw = raw.tobytes()
            yield _with(b, names, bytes_col, pa.array([raw[s:e] for s, e in zip(cut[:-1], cut[1:], strict=True)], pa.binary()))

    return docs.mapInArrow(run, schema)
