"""Operator 4: mixing sources to target weights (DataFrame functions only).

A classifier learned from a labelled table gives every document a posterior over domains. Documents then get
nonnegative rates (expected copies) so that the expected tokens T_k of each domain, the sum over documents of
rate * tokens * posterior, match target totals t_k in the least-squares sense: projected gradient descent,
started at rate 1, on (T - t)' A^-1 (T - t), where A_kl is the sum of tokens * p_k * p_l.

* Classifier: naive Bayes on the words that a text has among those that tell domains apart best, at most
  FEATURES of them, each with a likelihood ratio (against the same share in all domains) of at least GAIN nats
  and RATIO times as frequent in one domain's documents as in the others'. It learns from at most
  MAX_LABELLED labelled rows (smallest hash of their id); a quarter of them is held back to calibrate it: the
  posterior of a text is the smoothed share of each domain among held-back texts with the same likeliest
  domain and the same margin (in steps of MARGIN nats, STEPS of them).
* In the metric that weighs a document by its tokens the step is rate_d - p_d' A^-1 (T - t), and the step
  length 1 is safe whatever the data (the matrix of the quadratic form is a projection, with eigenvalues 0 and 1).
  An iteration is one aggregate of K sums; the driver holds K numbers. Rates are a fold over the last
  iterations' K numbers and are written to the shared folder every CHAIN iterations.

Defined results: a null or blank text has no tokens, prior posteriors, and a rate like any other; rows with a
null label or id are not learned from, and of several labels for an id the smallest counts; without
labelled documents all posteriors are equal; a target of a domain without expected tokens cannot be met and
is left out; all-zero targets or an empty table give no iterations and rate 1 or no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import let, materialize, words

FEATURES = 1_000
GAIN = 12.0
RATIO = 4.0
MARGIN, STEPS, SMOOTH = 2.0, 8, 2.0
MAX_LABELLED = 20_000
MIN_DOCS = 5
ITERATIONS = 60
CHAIN = 8
TOLERANCE = 1e-4            # of all tokens


def features(tokens: Column) -> Column:
    """Distinct words of a text, and three words for the tenths of its words that are distinct, that repeat
    the word before, and that end in a sign other than a letter, digit or stop."""
    n = F.greatest(F.size(tokens), F.lit(1))
    same = F.size(F.filter(F.zip_with(F.slice(tokens, 1, n - 1), F.slice(tokens, 2, n), lambda a, b: a == b), lambda x: x))
    odd = F.size(F.filter(tokens, lambda w: w.rlike(r"[^\p{L}\p{N}.,;:?]$")))

    def tenth(name: str, k: Column) -> Column:
        return F.concat(F.lit("\n" + name), F.floor(F.lit(10) * k / n).cast("string"))

    return let(F.array_distinct(tokens), lambda d: F.concat(d, F.array(tenth("distinct", F.size(d)), tenth("same", same), tenth("odd", odd))))


@dataclass
class Model:
    domains: list[str]
    words: DataFrame               # word, w: log share of each domain's documents that have it
    prior: list[float]             # log priors
    table: list[list[float]]       # posterior by likeliest domain and margin step (len(domains) * STEPS rows)


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], text_col: str = "text",
          max_labelled: int = MAX_LABELLED, n_features: int = FEATURES) -> Model:
    """A model from ``labelled`` (doc_id, domain)."""
    K = len(domains)
    sample = materialize(labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
                         .groupBy("doc_id").agg(F.min("domain").alias("domain"))
                         .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
                         .withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(4)) == 0), "labelled")
    rows = docs.select("doc_id", F.coalesce(text_col, F.lit("")).alias("_t")).join(F.broadcast(sample), "doc_id")   # bounded rows
    fit = rows.where("not held")
    own = fit.select("domain", F.explode(let(words(F.col("_t")), features)).alias("word"))
    each = [F.sum((F.col("domain") == k).cast("int")).alias(f"c{i}") for i, k in enumerate(domains)]
    counts = own.groupBy("word").agg(F.count(F.lit(1)).alias("c"), *each).where(F.col("c") >= MIN_DOCS)
    size = {r["domain"]: r["n"] for r in fit.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}   # one row a domain
    n, total = [size.get(k, 0) for k in domains], sum(size.values())
    gain = F.lit(0.0)
    for i, k in enumerate(n):
        if k:
            gain = gain + F.when(F.col(f"c{i}") > 0, F.col(f"c{i}") * F.ln(F.col(f"c{i}") * (total / k) / F.col("c"))).otherwise(0.0)
    share = [(F.col(f"c{i}") + 0.5) / (k + 1.0) for i, k in enumerate(n)]
    ratio = [(F.col(f"c{i}") / max(k, 1)) / ((F.col("c") - F.col(f"c{i}") + 0.5) / (total - k + 1.0)) for i, k in enumerate(n)]
    best = counts.withColumn("gain", gain).where((F.col("gain") >= GAIN) & (F.greatest(*ratio, F.lit(0.0)) >= RATIO))
    best = best.orderBy(F.desc("gain"), "word").limit(n_features)
    model = Model(domains, materialize(best.select("word", F.array(*[F.ln(q) for q in share]).alias("w")), "features"),
                  [log((k + 1) / (total + K)) for k in n], [])
    held = evidence(rows.where("held").select("doc_id", F.col("_t").alias("text"), "domain"), model, "text", ("domain",))
    seen = {(r["cell"], r["domain"]): r["n"] for r in
            held.groupBy(_cell(F.col("z")).alias("cell"), "domain").agg(F.count(F.lit(1)).alias("n")).collect()}   # K * K * STEPS rows at most
    base = [(k + 1) / (total + K) for k in n]
    for i in range(K):
        mine = [sum(seen.get((i * STEPS + s, d), 0) for s in range(STEPS)) for d in domains]
        share_i = [(m + SMOOTH * b) / (sum(mine) + SMOOTH) for m, b in zip(mine, base, strict=True)]
        for s in range(STEPS):
            here = [seen.get((i * STEPS + s, d), 0) for d in domains]
            model.table.append([(h + SMOOTH * b) / (sum(here) + SMOOTH) for h, b in zip(here, share_i, strict=True)])
    return model


def _cell(z: Column) -> Column:
    """Number of the likeliest domain and of the margin step to the next one."""
    def of(s: Column) -> Column:
        margin = F.when(F.size(s) > 1, s[0] - F.get(s, F.lit(1))).otherwise(0.0)
        return ((F.array_position(z, s[0]) - 1) * STEPS + F.least(F.floor(margin / MARGIN), F.lit(STEPS - 1))).cast("int")
    return let(F.sort_array(z, asc=False), of)


def evidence(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, th, n_tokens, z, ``keep``) of every row; z is the log joint weight of every domain."""
    src = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *keep, F.coalesce(text_col, F.lit("")).alias("_t"))
    src = src.select("row", "doc_id", *keep, F.xxhash64("_t").alias("th"), words(F.col("_t")).alias("ws"))
    src = src.select("row", "doc_id", *keep, "th", F.size("ws").cast("bigint").alias("n_tokens"), F.explode(features(F.col("ws"))).alias("word"))
    hits = src.join(F.broadcast(model.words), "word", "left")                 # at most FEATURES rows
    sums = hits.groupBy("row", "doc_id", *keep, "th", "n_tokens").agg(*[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(model.prior))])
    z = F.array(*[F.coalesce(f"s{k}", F.lit(0.0)) + F.lit(p) for k, p in enumerate(model.prior)])
    return sums.select("doc_id", "th", "n_tokens", z.alias("z"), *keep)


def posteriors(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(doc_id, th, n_tokens, p) of every row; p is an array with one probability a domain."""
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in model.table])
    return evidence(docs, model, text_col).select("doc_id", "th", "n_tokens", table[_cell(F.col("z"))].alias("p"))


def rates(rows: DataFrame, targets: list[float], iterations: int = ITERATIONS) -> tuple[DataFrame, list[dict]]:
    """``rows`` (n_tokens, p, ...) with ``rate``, and the totals of every iteration.

    ``targets`` are weights of the domains; they are scaled to the tokens of all rows.
    """
    K, base, pending, log_ = len(targets), materialize(rows.withColumn("rate", F.lit(1.0)), "rates"), [], []
    n = F.col("n_tokens")
    first = base.agg(F.sum(n).alias("all"), *[F.sum(n * F.col("p")[k] * F.col("p")[j]).alias(f"a{k}_{j}")
                                              for k in range(K) for j in range(k, K)]).first()
    everything = float(first["all"] or 0)
    gram = np.array([[float(first[f"a{min(k, j)}_{max(k, j)}"] or 0) for j in range(K)] for k in range(K)])
    live = [k for k in range(K) if gram[k, k] > 0]
    scale = sum(targets[k] for k in live)
    if not everything or scale <= 0:
        return base, log_
    goal = {k: targets[k] / scale * everything for k in live}
    inverse = np.linalg.pinv(gram[np.ix_(live, live)], hermitian=True)          # K by K numbers

    def current() -> Column:
        r = F.col("rate")
        for v in pending:
            r = F.greatest(F.lit(0.0), r - sum(F.col("p")[k] * F.lit(x) for k, x in v.items()))
        return r

    for _ in range(iterations):
        got = base.agg(*[F.sum(current() * n * F.col("p")[k]).alias(f"t{k}") for k in live]).first()
        off = {k: float(got[f"t{k}"]) - goal[k] for k in live}
        log_.append({k: float(got[f"t{k}"]) for k in live})
        moved = max(abs(log_[-1][k] - log_[-2][k]) for k in live) if len(log_) > 1 else everything
        if min(max(abs(x) for x in off.values()), moved) <= TOLERANCE * everything:      # met, or as near as it gets
            break
        pending.append(dict(zip(live, (inverse @ [off[k] for k in live]).tolist(), strict=True)))
        if len(pending) == CHAIN:
            base, pending = materialize(base.withColumn("rate", current()), "rates"), []
    return base.withColumn("rate", current()), log_


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], text_col: str = "text") -> DataFrame:
    """doc_id, th, n_tokens, domain (likeliest), p and rate of every row of ``docs``."""
    domains = sorted(targets)
    rows = posteriors(docs, learn(docs, labelled, domains, text_col), text_col)
    out, _ = rates(rows, [targets[k] for k in domains])
    names = F.array(*[F.lit(k) for k in domains])
    return out.withColumn("domain", names[(F.array_position("p", F.array_max("p")) - 1).cast("int")])
