import random
import re

import numpy as np
import pytest

from small import corpus, frame
from tokenloom.llm import decontaminate as D
from tokenloom.llm.common import Rolling
from tokenloom.llm.fm_index import FMIndex, WaveletMatrix, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return [(m[0], m.start(), m.end()) for m in WORD.finditer("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))]


def brute(rows, items, window):
    win = {}
    for k, t in items:
        w = [x for x, _, _ in words(t)]
        for i in range(max(1, len(w) - window + 1) if w else 0):
            win.setdefault(tuple(w[i:i + window]), set()).add("" if k is None else str(k))
    out = []
    for k, t in rows:
        w, hit, ids = words(t), set(), set()
        for size in {len(x) for x in win}:
            for i in range(len(w) - size + 1):
                if got := win.get(tuple(x for x, _, _ in w[i:i + size])):
                    hit.update(range(i, i + size))
                    ids |= got
        keep = t
        for run in sorted(hit, reverse=True):             # the words go, and what lies between two that go
            end = w[run + 1][1] if run + 1 in hit else w[run][2]
            keep = keep[:w[run][1]] + keep[end:]
        out.append((k, len(w), len(hit), tuple(sorted(ids)), keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 200])
def test_equals_brute_force(spark, block_bytes):
    rows, rng = corpus(13), random.Random(1)
    long = [t for _, t in rows if t and len(t.split()) > 60]
    items = [(i, " ".join(rng.choice(long).split()[i:i + 14])) for i in range(12)]
    items += [(50, "ab AB ab"), (51, None), (52, ""), (53, "..."), (None, "one, TWO"), (54, "x"), (50, items[0][1].upper()), (55, "never seen words here at all")]
    rows = rows + [(2000 + i, "before. " + t.replace(" ", " , ") + " after") for i, (_, t) in enumerate(items) if t] + [(3000, "é" + items[1][1] + "\nX x")]
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, n_words int")
    found = D.find(frame(spark, rows), bench, block_bytes=block_bytes)
    got = [(r["doc_id"], r["n_words"], sum(x["last"] - x["first"] for x in r["ranges"]), tuple(sorted(r["items"])), r["clean"])
           for r in found.withColumn("clean", D.without_spans("text", "ranges")).collect()]
    assert sorted(got, key=str) == brute(rows, items, D.WINDOW)


def test_words_across_pieces(monkeypatch):
    text = ("ÄB cd-" * 200 + "wörter" * 50).encode()
    data = np.frombuffer(text * 2, np.uint8)
    off = np.array([0, len(text), 2 * len(text)])
    whole = D.word_spans(data, off, Rolling(5, 10_000))
    monkeypatch.setattr(D, "PIECE", 37)
    cut = D.word_spans(data, off, Rolling(5, 10_000))
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))
    assert len(whole[0]) == 2 * len(WORD.findall(text.decode().lower()))


def test_index_against_naive_search():
    rng = np.random.default_rng(6)
    for sigma, n in ((2, 40), (5, 300), (60, 500)):
        seq = rng.integers(0, sigma, n)
        seq[-1] = 0
        sa = suffix_array(seq)
        assert sorted(sa.tolist()) == list(range(n))
        tree = WaveletMatrix(seq, sigma)
        sym, upto = rng.integers(0, sigma, 50), rng.integers(0, n + 1, 50)
        assert np.array_equal(tree.rank(sym, upto), [(seq[:u] == s).sum() for s, u in zip(sym, upto, strict=True)])
        index = FMIndex(seq, sigma)
        for size in (1, 2, 4):
            pats = rng.integers(1, sigma, (20, size)) if sigma > 2 else np.ones((1, size), np.int64)
            mat = np.concatenate((np.zeros((len(pats), 4 - size), np.int64), pats), axis=1)
            lo, hi = index.search(mat, np.full(len(pats), size))
            for p, a, z in zip(pats, lo, hi, strict=True):
                want = [i for i in range(n - size + 1) if np.array_equal(seq[i:i + size], p)]
                assert sorted(index.locate(np.arange(a, z)).tolist()) == want


def test_empty_benchmark_and_table(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r["n"] for r in D.find(frame(spark, corpus()), bench).selectExpr("size(ranges) as n").collect()} == {0}
    assert D.find(frame(spark, corpus()).limit(0), bench).count() == 0
