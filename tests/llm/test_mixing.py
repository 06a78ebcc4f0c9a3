import math

import numpy as np
from pyspark.sql import functions as F

from small import corpus, frame, tables
from tokenloom.llm import mixing, queries


def gradient(n, p, goal, steps):
    rate, gram, before = np.ones(len(n)), (p * n[:, None]).T @ p, None
    for _ in range(steps):
        total = (rate[:, None] * n[:, None] * p).sum(0)
        off = total - goal
        if min(np.abs(off).max(), n.sum() if before is None else np.abs(total - before).max()) <= mixing.TOLERANCE * n.sum():
            break
        before = total
        rate = np.maximum(0, rate - p @ np.linalg.solve(gram, off))
    return rate


def test_rates_equal_plain_projected_gradient(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], 500)
    n = rng.integers(1, 400, 500)
    df = spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(n, p, strict=True))],
                               "i int, n_tokens long, p array<double>")
    targets = [0.7, 0.25, 0.05]
    out, steps = mixing.rates(df, targets)
    got = np.array([r["rate"] for r in out.orderBy("i").collect()])
    want = gradient(n.astype(float), p, np.array(targets) * n.sum(), mixing.ITERATIONS)
    assert np.allclose(got, want, atol=1e-7) and (got >= 0).all() and (got == 0).any()
    totals = (got[:, None] * n[:, None] * p).sum(0) / n.sum()
    assert np.allclose(totals, targets, atol=2e-2) and len(steps) > 1


def test_posteriors_equal_plain_naive_bayes(spark):
    rng = np.random.default_rng(5)
    docs, labels = [], []
    for k in range(900):
        domain = ("a", "b")[k % 3 == 0]
        w = [f"w{x}" for x in rng.integers(0, 30, 20)] + ([f"{domain}{x}" for x in rng.integers(0, 4, 3)] if k % 5 else [])
        docs.append((k, " ".join(w)))
        if k % 2 == 0:
            labels.append((k, domain))
    lab = spark.createDataFrame(labels, "doc_id long, domain string")
    model = mixing.learn(frame(spark, docs), lab, ["a", "b"])
    weight = {r["word"]: r["w"] for r in model.words.collect()}
    assert weight and all(w.startswith(("a", "b")) for w in weight)      # none of the words that both domains have
    held = {r["doc_id"] for r in lab.where(F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(4)) == 0).collect()}
    fit, text = [(k, d) for k, d in labels if k not in held], dict(docs)
    size = {k: sum(d == k for _, d in fit) for k in "ab"}
    own = {w: [sum(d == x and w in text[k].split() for k, d in fit) for x in "ab"] for w in weight}
    share = {w: [(c + 0.5) / (size[d] + 1) for c, d in zip(own[w], "ab", strict=True)] for w in weight}
    assert all(np.allclose(weight[w], np.log(share[w])) for w in weight)

    def cell(t):
        z = [math.log((size[d] + 1) / (len(fit) + 2)) + sum(math.log(q[i]) for w, q in share.items() if w in set(t.split())) for i, d in enumerate("ab")]
        top = int(np.argmax(z))
        return top, min(int((z[top] - z[1 - top]) // mixing.MARGIN), mixing.STEPS - 1)

    base = [(size[d] + 1) / (len(fit) + 2) for d in "ab"]
    cells = [(cell(text[k]), d) for k, d in labels if k in held]
    got = {r["doc_id"]: r["p"] for r in mixing.posteriors(frame(spark, docs), model).collect()}
    for k, t in docs:
        c = cell(t)
        mine = [sum(x[0] == c[0] and d == e for x, d in cells) for e in "ab"]
        first = [(m + mixing.SMOOTH * q) / (sum(mine) + mixing.SMOOTH) for m, q in zip(mine, base, strict=True)]
        here = [sum(x == c and d == e for x, d in cells) for e in "ab"]
        assert np.allclose(got[k], [(h + mixing.SMOOTH * q) / (sum(here) + mixing.SMOOTH) for h, q in zip(here, first, strict=True)])
    right = sum((got[k][1] > 0.5) == (k % 3 == 0) for k, _ in docs if k % 5)
    assert right > 700


def test_awkward_rows(spark, tmp_path):
    rows = corpus()
    lab = spark.createDataFrame([(k, i % 4 != 0, None if i == 5 else i % 2) for i, (k, _) in enumerate(rows)],
                                "doc_id long, q boolean, toxic int").select("doc_id", F.col("q").cast("int").alias("quality"), "toxic")
    sf = tables(spark, tmp_path, documents=frame(spark, rows), labels=lab)
    got = queries.op4_mixing(spark, sf).collect()
    assert len(got) == len(rows) and all(r["rate"] >= 0 and abs(r["p_good"] + r["p_low"] + r["p_toxic"] - 1) < 1e-9 for r in got)
    assert sum(r["n_tokens"] == 0 for r in got) == sum(not (t or "").split() for _, t in rows)


def test_without_labels_or_documents(spark):
    lab = spark.createDataFrame([], "doc_id long, domain string")
    out = mixing.mix(frame(spark, corpus()), lab, {"a": 1.0, "b": 1.0})
    assert {round(r["p"][0], 6) for r in out.collect()} == {0.5}     # also without a label that the targets name
    assert mixing.mix(frame(spark, corpus()).limit(0), lab, {"a": 1.0, "b": 1.0}).count() == 0
