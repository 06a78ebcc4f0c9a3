import random
from collections import Counter

import numpy as np

from small import corpus, frame
from tokenloom.llm import jaccard_join as J


def sets(rows):
    out = []
    for _, t in rows:
        w = (t or "").lower().split()
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows, threshold=0.8):
    s, n = sets(rows), len(rows)
    link = [[j for j in range(n) if j != i and s[i] and s[j] and len(s[i] & s[j]) >= threshold * len(s[i] | s[j]) - 1e-9] for i in range(n)]
    group = list(range(n))
    for i in range(n):
        todo, seen = [i], {i}
        while todo:
            for k in link[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        group[i] = min(ids) if ids else None
    return Counter((rows[i][0], rows[i][1], rows[i][0] if not s[i] else group[i], len(link[i])) for i in range(n))


def near_group(seed, n, words, edits):
    rng = random.Random(seed)
    base = [f"b{seed}_{rng.randint(0, 9999)}" for _ in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"e{k}"
        out.append(" ".join(w))
    return out


def result(spark, rows):
    from pyspark.sql import functions as F
    df = frame(spark, rows)
    j = J.join(df)
    t = df.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("t1"), "text").distinct()
    return Counter((r["doc_id"], r["text"], r["class_id"], r["n_links"]) for r in
                   j.join(t, "t1").collect())


def test_links_and_classes_equal_brute_force(spark):
    rows = corpus(11)
    rows = [(k, t) for k, t in rows if t is not None]     # null and empty texts have the same hash; see below
    for g in range(4):
        rows += [(5000 + 100 * g + i, t) for i, t in enumerate(near_group(g, 25, 80 + 60 * g, 4))]
    assert result(spark, rows) == brute(rows)


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(J, "CELL", 1500)                  # several blocks a bucket
    rows = list(enumerate(near_group(7, 120, 90, 3)))
    assert result(spark, rows) == brute(rows)


def test_null_and_blank_texts_have_no_links(spark):
    got = J.join(frame(spark, [(1, None), (2, None), (3, ""), (4, " \n ")])).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == [(i, i, 0) for i in (1, 2, 3, 4)]


def test_pruning_bounds():
    least = J._least_matches(0.8, 1e-6)
    assert least == sorted(least) and 0 <= least[0] < 16 * 0.8 and least[-1] < J.HASHES * 0.8


def test_dedup_keeps_one_of_each_group(spark):
    rows = corpus(11) + [(6000 + i, t) for i, t in enumerate(near_group(9, 12, 200, 2))]
    kept = Counter((r["doc_id"], r["text"]) for r in J.dedup(frame(spark, rows)).collect())
    want, s = brute(rows), sets(rows)
    groups = {}
    for (k, t), c, g in zip(rows, s, [x for x in range(len(rows))], strict=True):
        del g
        if not c:
            groups.setdefault(("blank", k, t), []).append((k, t))
    for (k, t, cls, _), n in want.items():
        if (t or "").split():
            groups.setdefault(cls, []).extend([(k, t)] * n)
    expected = Counter()
    for name, members in groups.items():
        if isinstance(name, tuple):
            expected.update(members)
        else:
            expected[min(members, key=lambda m: (m[0] is None, m[0] or 0))] += 1
    assert sum(kept.values()) == sum(expected.values())
    assert {k for k, _ in kept} == {k for k, _ in expected}


def test_components_of_a_long_chain(spark):
    names = [int(i).to_bytes(4, "big") for i in np.random.default_rng(2).permutation(200)]
    edges = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in zip(names, names[1:], strict=False)], "u binary, v binary")
    assert {bytes(r["label"]) for r in J.components(edges).collect()} == {min(names)}


def test_empty_table(spark):
    assert J.join(frame(spark, corpus()).limit(0)).count() == 0
    assert J.dedup(frame(spark, corpus()).limit(0)).count() == 0
