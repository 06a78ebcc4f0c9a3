"""Operator 5: language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (fixed by a seed). A letter n-gram is bound by
multiplying its letters' vectors, each rotated by its place in the n-gram. A text is the bundle (sum)
of its n-gram vectors, a language the bundle of its training texts; a text gets the language whose
prototype has the largest cosine with it.

Bundling is linear, so training sends only one sum of vectors per language and Arrow batch to Spark's
aggregate, and the driver receives one vector per language. Prediction looks each distinct n-gram of
a batch up once. All whole texts count; memory is bounded by the Arrow batch.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text where
nothing could be learned. Rows with a null language are not learned from. Ties between languages go
to the smaller name. Score is the cosine, negative ones as 0. Repeated rows count as often as they
occur; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import lean, parts, slices

DIMS = 1024
GRAM = 3
SLOTS = 128            # letter vectors; a-z have one each, other letters share the rest by code point
SEED = 20_011
CHUNK = 1 << 20         # bytes of text that are decoded together
KNOWN = 1 << 14        # n-gram vectors that a task keeps ready


def _letter_vectors() -> np.ndarray:
    v = np.random.default_rng(SEED).integers(0, 2, (SLOTS, DIMS), dtype=np.int8) * 2 - 1
    return v.astype(np.float32)


def _slot_table() -> np.ndarray:
    """Slot of every code point of the basic plane: 0 for what is no letter."""
    t = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            t[c] = c - 96 if 97 <= c <= 122 else 28 + c % (SLOTS - 28)
    return t


def _slots(text: str, table: np.ndarray) -> np.ndarray:
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return np.zeros(0, np.uint8)
    out = table[np.minimum(cp, 0xFFFF)]
    for c in np.unique(cp[cp > 0xFFFF]):                 # letters beyond the basic plane
        out[cp == c] = 28 + int(c) % (SLOTS - 28) if chr(c).isalpha() else 0
    return out


def _grams(text: str, table: np.ndarray) -> np.ndarray:
    """Codes of the n-grams of a text, words bounded by slot 0; only those around a letter count."""
    s = _slots(text, table).astype(np.int32)
    if not s.any():
        return np.zeros(0, np.int32)
    s = np.concatenate(([0], s, [0]))
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]       # runs of non-letters become one
    if len(s) < GRAM:
        return np.zeros(0, np.int32)
    code = np.zeros(len(s) - GRAM + 1, np.int32)
    for i in range(GRAM):
        code = code * SLOTS + s[i:len(s) - GRAM + 1 + i]
    return code


def _gram_vectors(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    out = np.ones((len(codes), DIMS), np.float32)
    for i in range(GRAM):
        place = GRAM - 1 - i
        slot = (codes // SLOTS**place) % SLOTS
        out *= np.roll(letters, place, axis=1)[slot]
    return out


def _bundle(counts: np.ndarray, codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    v = np.zeros(DIMS, np.float64)
    for i in range(0, len(codes), 4096):
        v += counts[i:i + 4096].astype(np.float32) @ _gram_vectors(codes[i:i + 4096], letters)
    return v


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of every language of the (distributed) training rows."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        letters, table = _letter_vectors(), _slot_table()
        for b in batches:
            langs, codes = b.column("lang").to_pylist(), {}
            for i, texts in slices(b, "text", CHUNK):
                for lang, text in zip(langs[i:i + len(texts)], texts, strict=True):
                    codes.setdefault(lang, []).append(np.unique(_grams(text, table), return_counts=True))
            out = []
            for lang, got in codes.items():
                u, inv = np.unique(np.concatenate([g for g, _ in got]), return_inverse=True)
                n = np.bincount(inv, np.concatenate([c for _, c in got]), len(u))
                v = _bundle(n, u, letters)
                out += [(lang, d, float(x)) for d, x in enumerate(v)]
            if out:
                yield pa.RecordBatch.from_pydict({"lang": [o[0] for o in out], "dim": pa.array([o[1] for o in out], pa.int32()),
                                                  "value": [o[2] for o in out]})

    src = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "text is not null and lang is not null")
    sums = (src.mapInArrow(partial, "lang string, dim int, value double")
            .groupBy("lang", "dim").agg(F.sum("value").alias("value"))).toPandas()     # DIMS rows a language
    out = {lang: g.sort_values("dim")["value"].to_numpy() for lang, g in sums.groupby("lang")}
    return {lang: v for lang, v in out.items() if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text",
            keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score of every row."""
    names = sorted(k for k, v in prototypes.items() if np.linalg.norm(v) > 0)
    mat = np.array([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]).reshape(len(names), DIMS)
    shared = docs.sparkSession.sparkContext.broadcast(mat.astype(np.float32))    # one vector a language
    src = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = src.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        letters, table, proto = _letter_vectors(), _slot_table(), shared.value
        at = np.full(SLOTS**GRAM, -1, np.int32)                 # row of an n-gram among the vectors made so far
        vecs, made = np.empty((KNOWN, DIMS), np.float32), 0
        for b in parts(batches, "_text"):
            lang, sc = [], []
            for text in (t for _, texts in slices(b, "_text", CHUNK) for t in texts):
                codes = _grams(text, table) if text and len(proto) else np.zeros(0, np.int32)
                if not len(codes):
                    lang.append("und")
                    sc.append(0.0)
                    continue
                u, n = np.unique(codes, return_counts=True)
                new = u[at[u] < 0]
                if made + len(new) > KNOWN:                      # start again; the space is bounded
                    at.fill(-1)
                    made, new = 0, u
                if len(new) <= KNOWN:
                    vecs[made:made + len(new)] = _gram_vectors(new, letters)
                    at[new] = np.arange(made, made + len(new))
                    made += len(new)
                    v = n.astype(np.float32) @ vecs[at[u]]
                else:
                    v = _bundle(n, u, letters)
                norm = float(np.linalg.norm(v))
                cos = proto @ (v / norm) if norm else np.zeros(len(proto))
                k = int(np.argmax(cos))
                lang.append(names[k])
                sc.append(min(1.0, max(0.0, float(cos[k]))))
            arrays = [b.column(c) for c in keep] + [pa.array(lang, pa.string()), pa.array(sc, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "lang_pred", "score"])

    return src.mapInArrow(score, schema)
