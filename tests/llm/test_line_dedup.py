import random
from collections import Counter

import pytest

from small import corpus, frame
from tokenloom.llm import line_dedup


def kept(rows, min_lines, min_words):
    """What stays of every (id, text); rows that repeat both are one text, texts are ordered by id, nulls first."""
    texts = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    gone, out = maximal(texts, min_lines, min_words), {}
    for r in texts:
        lines = (r[1] or "").split("\n")
        solid = [n for n, x in enumerate(lines) if x.split()]
        drop = {solid[i] for i in gone[r]}
        for i in gone[r]:
            if i + 1 in gone[r]:
                drop.update(range(solid[i], solid[i + 1]))           # blank lines inside a run
        out[r] = r[1] if not drop else "\n".join(x for n, x in enumerate(lines) if n not in drop)
    return out


def maximal(rows, min_lines, min_words):
    """{(doc_id, text): numbers of the solid lines that go}: runs that some earlier place holds too, as long as they
    go on alike, by comparing every place with every earlier one that starts with the same line."""
    texts = [[x for x in (t or "").split("\n") if x.split()] for _, t in rows]
    gone, earlier = {r: set() for r in rows}, {}
    for t, s in enumerate(texts):
        for i in range(len(s)):
            for u, j in earlier.setdefault(s[i], []):
                k = 0
                while i + k < len(s) and j + k < len(texts[u]) and s[i + k] == texts[u][j + k]:
                    k += 1
                if k >= min_lines or sum(len(x.split()) for x in s[i:i + k]) >= min_words:
                    gone[rows[t]].update(range(i, i + k))
            earlier[s[i]].append((t, i))
    return gone


@pytest.mark.parametrize("min_lines,min_words", [(3, 50), (1, 10**6), (2, 10**6), (5, 40)])
def test_equals_brute_force(spark, min_lines, min_words):
    rows = [r for r in corpus(8) if r[0] != 1010] + [(1013, corpus(8)[4][1]), (1013, corpus(8)[4][1])]
    rows = [r for r in rows if r[0] is not None or r[1] is None]
    got = line_dedup.dedup(frame(spark, rows), min_lines, min_words).collect()
    want = kept(rows, min_lines, min_words)
    assert Counter((r["doc_id"], r["text"], r["kept"]) for r in got) == Counter((k, t, want[(k, t)]) for k, t in rows)


def test_end_of_a_repeated_run_goes(spark):
    run = "\n".join(" ".join([w] * k) for w, k in (("a", 60), ("b", 10), ("c", 10)))
    got = {r["doc_id"]: r["kept"] for r in line_dedup.dedup(frame(spark, [(1, f"head\n{run}"), (2, f"{run}\ntail"), (3, run)])).collect()}
    assert got == {1: f"head\n{run}", 2: "tail", 3: ""}


def test_ties_null_ids_and_clashing_columns(spark):
    rows = corpus(8)
    out = line_dedup.dedup(frame(spark, rows))
    assert out.count() == len(rows)
    copies = [r["kept"] for r in out.collect() if r["text"] == rows[4][1] and r["doc_id"] in (None, 28, 1001, 1002)]
    assert sum(k == rows[4][1] for k in copies) == 1      # one copy of the repeated text stays whole


def test_repeats_inside_one_text(spark):
    block = "\n".join(f"l{i} a b c" for i in range(4))
    got = line_dedup.dedup(frame(spark, [(1, f"{block}\nmiddle\n\n{block}")])).first()
    assert got["kept"] == f"{block}\nmiddle\n"
    assert [tuple(r) for r in got["removed_runs"]] == [(6, 9)]


def test_empty_table(spark):
    assert line_dedup.dedup(frame(spark, corpus()).limit(0)).count() == 0


@pytest.mark.parametrize("min_lines,min_words", [(3, 50), (1, 10**6), (2, 10), (5, 40)])
def test_removed_lines_are_maximal_repeated_runs(spark, min_lines, min_words):
    line = lambda k, n: " ".join([f"w{n}"] * k)
    rng = random.Random(6)
    pool = [line(k, n) for n, k in enumerate([60, 10, 10, 45, 6, 51, 2, 30, 25, 9])]
    rows = [(1, "\n".join(pool[:3])), (2, "\n".join(["x", *pool[:3]])), (3, "\n".join([*pool[:3], "y"]))]
    rows += [(10 + i, "\n".join([f"head {i}", *pool[(a := rng.randint(0, 8)):a + rng.randint(1, 6)], "",
                                 *[rng.choice(pool) for _ in range(rng.randint(0, 5))]])) for i in range(40)]
    rows += [(k, t) for k, t in corpus(8) if k is not None and 1000 <= k != 1010 and k != 1012]
    got = line_dedup.dedup(frame(spark, rows), min_lines, min_words).collect()
    want = maximal(rows, min_lines, min_words)
    for r in got:
        solid = [n for n, x in enumerate((r["text"] or "").split("\n")) if x.split()]
        lost = {i for i, n in enumerate(solid) if any(a <= n <= b for a, b in r["removed_runs"])}
        assert lost == want[(r["doc_id"], r["text"])]
    assert len(got) == len(rows)
