"""Operator 7: quality classifier (linear-chain conditional random field over lines).

Each line of a text is good or bad. A line's potential is linear in the features of the line and of
the lines before and after it; neighbouring labels are tied by a transition matrix. The marginals of
forward-backward, weighted by line length, aggregate into the quality of the text.

The field is fitted on at most MAX_DOCS labelled rows (those with the smallest hash of their id), of
those only texts of at most MAX_LINES lines; every line of a training text carries the text's label.
Their line features, at most MAX_DOCS * MAX_LINES short rows, are fitted on the driver. Scoring is one
map over whole texts without a shuffle.

Defined results: a null or empty text is one empty line and is scored like any other; label rows with
a null id or label, or without a document, are not used, and of several for one id the smallest label
counts; without usable labels of both kinds every score is 0.5. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import lean, parts, slices

MAX_DOCS = 6_000
MAX_LINES = 400
STEPS = 250
CHUNK = 1 << 18            # bytes of text whose features are computed together

N_BASE = 16                # features of one line (see _line_features)
UPPER, LOWER, DIGIT, SPACE, STOP, OTHER = range(6)


def _class_table() -> np.ndarray:
    t = np.full(1 << 16, OTHER, np.uint8)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        t[c] = (UPPER if ch.isupper() else LOWER if ch.isalpha() else DIGIT if ch.isdigit() else
                SPACE if ch.isspace() else STOP if ch in ".,;:!?'\"()-" else OTHER)
    return t


def _line_features(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, lines per text, characters per line)."""
    joined = "\n".join(t or "" for t in texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = table[np.minimum(cp, 0xFFFF)]
    ends = np.flatnonzero(cp == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = (ends - starts).astype(np.float64)
    lines = np.array([(t or "").count("\n") + 1 for t in texts])
    line_of = np.repeat(np.arange(len(ends)), ends - starts + 1)
    count = np.stack([np.bincount(line_of[cls == k], minlength=len(ends)) for k in range(6)]).astype(np.float64)
    count[SPACE] -= 1                                            # the line's own end
    # words: runs of non-space characters, as hashes
    solid = cls != SPACE
    first = solid & ~np.concatenate(([False], solid[:-1]))
    last = solid & ~np.concatenate((solid[1:], [False]))
    ws, we = np.flatnonzero(first), np.flatnonzero(last) + 1
    code = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    place = (np.arange(len(cp)) - np.maximum.accumulate(np.where(first, np.arange(len(cp)), 0))).astype(np.uint64)
    code = (code ^ (code >> np.uint64(29))) * (place * np.uint64(2) + np.uint64(0xBF58476D1CE4E5B9))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(code, dtype=np.uint64)))
    wh, wl = sums[we] - sums[ws], line_of[ws]
    nw = np.bincount(wl, minlength=len(ends)).astype(np.float64)
    same = (wh[1:] == wh[:-1]) & (wl[1:] == wl[:-1]) if len(wh) else np.zeros(0, bool)
    twice = np.bincount(wl[1:][same], minlength=len(ends)) if len(wh) else np.zeros(len(ends))
    order = np.lexsort((wh, wl))
    oh, ol = wh[order], wl[order]
    fresh = np.concatenate(([True], (oh[1:] != oh[:-1]) | (ol[1:] != ol[:-1]))) if len(oh) else np.zeros(0, bool)
    distinct = np.bincount(ol[fresh], minlength=len(ends))
    lone = (we - ws == 1) & ~np.isin(cls[ws], (UPPER, LOWER)) if len(ws) else np.zeros(0, bool)
    odd_end = np.isin(cls[we - 1], (OTHER, DIGIT)) if len(we) else np.zeros(0, bool)
    stop_end = cls[we - 1] == STOP if len(we) else np.zeros(0, bool)
    n1, w1 = np.maximum(n, 1), np.maximum(nw, 1)
    f = np.stack([
        np.ones(len(ends)), np.log1p(n) / 6, np.log1p(nw) / 5, np.minimum(n / w1, 40) / 10,
        count[UPPER] / n1, count[LOWER] / n1, count[DIGIT] / n1, np.maximum(count[SPACE], 0) / n1, count[STOP] / n1, count[OTHER] / n1,
        twice / w1, distinct / w1, np.bincount(wl[lone], minlength=len(ends)) / w1,
        np.bincount(wl[odd_end], minlength=len(ends)) / w1, np.bincount(wl[stop_end], minlength=len(ends)) / w1,
        (nw == 0).astype(float)], axis=1)
    return f, lines, n


def _with_neighbours(f: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Features of a line, of the one before and of the one after (zeros beyond the text)."""
    ends = np.cumsum(lines)
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    before[ends - lines] = 0
    after[ends - 1] = 0
    return np.concatenate((f, before, after), axis=1)


@dataclass
class Field:
    weight: np.ndarray         # of the features, for the label good (bad has 0)
    start: np.ndarray          # log potential of the first label
    step: np.ndarray           # log potential of (label, next label)
    scale: tuple[float, float] # logistic link from the aggregated marginal to the score

    def marginals(self, x: np.ndarray, lines: np.ndarray, pairs: bool = False):
        """P(good) of every line; with ``pairs`` also the expected (label, next label) counts and
        the first labels' distribution, both weighted by 1 / lines."""
        pot = np.exp(np.clip(x @ self.weight, -30, 30))
        order = np.argsort(-lines, kind="stable")
        size = lines[order]
        at = (np.cumsum(lines) - lines)[order]
        m = np.exp(self.step)
        a, b = np.empty((len(x), 2)), np.ones((len(x), 2))
        live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for t, k in enumerate(live):
            i = at[:k] + t
            v = np.exp(self.start)[None, :].repeat(k, 0) if t == 0 else a[i - 1] @ m
            v = v * np.stack((np.ones(k), pot[i]), axis=1)
            a[i] = v / v.sum(1, keepdims=True)
        for t in range(len(live) - 2, -1, -1):
            i = at[:live[t + 1]] + t
            v = (np.stack((np.ones(len(i)), pot[i + 1]), axis=1) * b[i + 1]) @ m.T
            b[i] = v / v.sum(1, keepdims=True)
        p = a * b
        p /= p.sum(1, keepdims=True)
        if not pairs:
            return p[:, 1]
        w = np.repeat(1 / lines, lines)
        inner = np.ones(len(x), bool)
        inner[np.cumsum(lines) - 1] = False
        i = np.flatnonzero(inner)
        q = a[i][:, :, None] * m[None] * (np.stack((np.ones(len(i)), pot[i + 1]), axis=1) * b[i + 1])[:, None, :]
        q /= q.sum((1, 2), keepdims=True)
        first = np.cumsum(lines) - lines
        return p[:, 1], (q * w[i][:, None, None]).sum(0), (p[first] / lines[:, None]).sum(0)

    def quality(self, texts: list[str | None], table: np.ndarray) -> np.ndarray:
        f, lines, n = _line_features(texts, table)
        return self.link(self.aggregate(f, lines, n))

    def aggregate(self, f: np.ndarray, lines: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = self.marginals(_with_neighbours(f, lines), lines)
        first = np.cumsum(lines) - lines
        return np.add.reduceat(p * (n + 1), first) / np.add.reduceat(n + 1, first)

    def link(self, mean: np.ndarray) -> np.ndarray:
        z = np.clip(mean, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.scale[0] * np.log(z / (1 - z)) + self.scale[1])))


def _fit(f: np.ndarray, lines: np.ndarray, n: np.ndarray, label: np.ndarray) -> Field:
    x, docs = _with_neighbours(f, lines), len(lines)
    y = np.repeat(label, lines).astype(float)
    w = np.repeat(1 / lines, lines)
    counts = np.zeros((2, 2))
    for k in (0, 1):
        counts[k, k] = ((lines - 1) / lines)[label == k].sum()
    heads = np.array([(1 / lines)[label == k].sum() for k in (0, 1)])
    par = np.zeros(x.shape[1] + 6)
    m1, m2 = np.zeros_like(par), np.zeros_like(par)
    for t in range(1, STEPS + 1):                    # Adam on the mean log likelihood, small L2 term
        fld = Field(par[:-6], par[-6:-4], par[-4:].reshape(2, 2), (1.0, 0.0))
        p, q, first = fld.marginals(x, lines, pairs=True)
        g = np.concatenate((x.T @ (w * (y - p)), heads - first, (counts - q).ravel())) / docs - 1e-4 * par
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        par = par + 0.08 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    fld = Field(par[:-6], par[-6:-4], par[-4:].reshape(2, 2), (1.0, 0.0))
    z = np.clip(fld.aggregate(f, lines, n), 1e-6, 1 - 1e-6)
    z = np.log(z / (1 - z))
    s, c = 0.3, 0.0
    for _ in range(400):                             # logistic link by Newton steps
        e = 1 / (1 + np.exp(-(s * z + c)))
        r, h = label - e, e * (1 - e) + 1e-9
        g = np.array([(r * z).sum() - 1e-2 * s, r.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        d = np.linalg.solve(hess, g)
        s, c = s + np.clip(d[0], -0.5, 0.5), c + np.clip(d[1], -0.5, 0.5)
    fld.scale = (float(max(s, 1e-3)), float(c))
    return fld


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality",
        max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> Field | None:
    """The fitted field, or None where the labels do not hold both kinds."""
    sample = (labels.select("doc_id", F.col(label_col).cast("int").alias("_label"))
              .where("doc_id is not null and _label in (0, 1)").groupBy("doc_id").agg(F.min("_label").alias("_label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))
    src = docs.select("doc_id", F.coalesce(text_col, F.lit("")).alias("_text"))
    src = src.where(F.size(F.split("_text", "\n")) <= max_lines)
    src = src.join(F.broadcast(sample), "doc_id").select("_label", "_text")      # at most max_docs small rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        table = _class_table()
        for b in batches:
            for i, texts in slices(b, "_text", CHUNK):
                f, lines, n = _line_features(texts, table)
                cut = np.cumsum(lines)[:-1]
                yield pa.RecordBatch.from_pydict({
                    "label": b.column("_label").slice(i, len(texts)), "f": [v.ravel() for v in np.split(f, cut)], "n": np.split(n, cut)})

    got = src.mapInArrow(features, "label int, f array<double>, n array<double>").toArrow()
    label = np.array(got.column("label").to_pylist(), int)
    if len(set(label.tolist())) < 2:
        return None
    n = [np.array(v) for v in got.column("n").to_pylist()]
    f = np.concatenate([np.array(v).reshape(-1, N_BASE) for v in got.column("f").to_pylist()])
    return _fit(f, np.array([len(v) for v in n]), np.concatenate(n), label)


def score(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score`` (0 to 1, higher: better)."""
    docs = docs.drop("score")
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        table = _class_table()
        for b in parts(batches, text_col):
            out = [field.quality(texts, table) if field else np.full(len(texts), 0.5) for _, texts in slices(b, text_col, CHUNK)]
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)
