import hashlib
import random
from collections import Counter

import pytest

from small import corpus, frame
from tokenloom.llm import suffix_dedup


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[p:p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for (k, _), b in zip(rows, raw, strict=True):
        hit = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                hit[p:p + length] = [True] * length
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        spans = sum(h and (i == 0 or not hit[i - 1]) for i, h in enumerate(hit))
        out.append((k, len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("length", [60, 400])
def test_equals_brute_force(spark, length):
    rows = corpus()
    got = suffix_dedup.dedup(frame(spark, rows), length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = brute(rows, length)
    assert Counter(tuple(r) for r in got) == want
    assert sum(r[2] for r in want.elements()) > 0


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)      # texts span several pieces (tasks unpickle the module's own value)
    import numpy as np

    from tokenloom.llm.common import Rolling
    data = np.random.default_rng(1).integers(97, 101, 6000, dtype=np.uint8)
    off = np.array([0, 6000])
    one, two = Rolling(1, 1000), Rolling(2, 1000)
    covered = np.zeros(6000 - 100 + 1, int)
    for _, lo, hi, at, *_ in suffix_dedup._anchors(data, off, 100, one, two):
        for a, z, m in zip(lo, hi, at, strict=True):
            covered[a:z + 1] += 1
            assert z <= m < a + suffix_dedup.window(100)
    assert (covered == 1).all()                           # every start position lies in exactly one block


def test_empty_table(spark):
    assert suffix_dedup.dedup(frame(spark, corpus()).limit(0)).count() == 0


def test_kept_bytes(spark):
    rows = [(1, "a" * 10 + "é" * 300), (2, "b" + "é" * 300)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.dedup(frame(spark, rows), 400, with_kept=True).collect()}
    assert got == {1: b"a" * 10, 2: b"b"}


def test_shared_passages_too_short_to_be_removed(spark):
    """Passages of 360 bytes in two documents, anywhere in them, show in both; repeats inside one document and short ones do not."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    rows, want = [], {}
    for k in range(30):
        passage = text(360)
        for side in (0, 1):
            rows.append((10 * k + side, text(rng.randint(0, 900)) + passage + text(rng.randint(0, 900))))
            want[10 * k + side] = 360
        own = text(600)
        rows.append((10 * k + 2, text(500) + own + text(300) + own))
        want[10 * k + 2] = 0
    short = text(100)
    rows += [(1000, text(700) + short), (1001, short + text(800))]
    got = {r["doc_id"]: r for r in suffix_dedup.dedup(frame(spark, rows)).collect()}
    for k, n in want.items():
        assert (128 <= got[k]["longest_shared"] <= n) if n else got[k]["longest_shared"] == 0
        assert (got[k]["n_removed"] > 0) == (n == 0)
    assert got[1000]["longest_shared"] == got[1001]["longest_shared"] == 0
