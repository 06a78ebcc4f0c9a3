"""Operator 3: line dedup (DataFrame functions only).

A text is a sequence of line ids (128-bit fingerprints of its lines that are not blank). Suffixes of
these sequences are ranked by prefix doubling: the rank of 2h lines is the pair of the ranks of h lines at
an offset of h, suffixes whose rank is unique are dropped after every round, and doubling stops once the
threshold is passed. Suffixes with the same rank share a common prefix of at least that many lines (an LCP
interval). A run counts as a repeat from ``min_lines`` lines, or fewer with ``min_words`` words together; such
runs that start at consecutive lines join into maximal ones: each line is judged as the start of every length that counts,
up to ``min_lines``, and a longer run is the union of those, so a maximal repeated run goes up to its end. Of every
repeat the first copy by (doc_id, text hash, line) stays and the later ones are deleted, those inside the same text too.

Defined results: a null text is empty and stays as it is; blank lines have no id, and go only where they
lie inside a deleted run; rows that repeat id and text are one text (each gets the same result, none is
a copy of another); a null id comes before all others; columns beyond the named ones are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm import bloom
from tokenloom.llm.common import let, materialize

MIN_LINES, MIN_WORDS = 3, 50
_RUNS = "array<struct<first:int,last:int>>"


def _positions(texts: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(doc_id, th, i, line_no, need, a, b): lines that are not blank, with the lengths of the runs from
    there that count (none: the text ends before)."""
    lines = F.transform(F.split("body", "\n"), lambda x, i: F.struct(
        i.alias("line_no"), F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")).alias("w"),
        F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    lines = F.filter(lines, lambda s: s["w"] > 0)

    def needs(arr: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            total, out = s["w"], [F.when(s["w"] >= (min_words if min_lines > 1 else 0), 1)]
            for m in range(2, min_lines + 1):
                total = total + F.get(arr, i + (m - 1))["w"]          # null past the end of the text
                out.append(F.when(total >= (min_words if m < min_lines else 0), m))
            need = F.filter(F.array(*out), lambda m: m.isNotNull())
            return F.struct(s["line_no"].alias("line_no"), need.alias("need"),
                            s["a"].alias("a"), s["b"].alias("b"))
        return F.transform(arr, one)

    return texts.select("doc_id", "th", F.posexplode(let(lines, needs)).alias("i", "s")).select("doc_id", "th", "i", "s.*")


def _not_unique(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose rank (a, b) occurs more than once."""
    many = materialize(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b"), name)
    return rows.join(many, ["a", "b"])


def repeated_runs(texts: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, runs): maximal runs of lines (line numbers, both ends included) to delete."""
    text = ["doc_id", "th"]
    order = Window.partitionBy(*text).orderBy("i")
    pos = materialize(_positions(texts, min_lines, min_words), "lines")
    cur = _not_unique(pos, "ranks1").groupBy(*text, "i").agg(
        *[F.first(c).alias(c) for c in ("line_no", "need", "a", "b")])       # repeated rows are one text
    cur, h, final = materialize(cur, "survivors1"), 1, []
    while True:
        for m in range(h, min(2 * h - 1, min_lines) + 1):       # runs of m lines: two ranks of h lines that overlap
            if m == h:
                win = cur.where(F.array_contains("need", m)).select(*text, "i", F.lit(m).alias("need"), "a", "b")
            else:
                win = cur.select(*text, "i", "need", *[F.xxhash64(F.lit(x), "a", "b", F.lead("a", m - h).over(order), F.lead("b", m - h).over(order)).alias(c)
                                                       for c, x in (("a", 2), ("b", 3))], F.lead("i", m - h).over(order).alias("j"))
                win = win.where(F.array_contains("need", m) & (F.col("j") == F.col("i") + (m - h))).drop("j").withColumn("need", F.lit(m))
            final.append(win)
        if 2 * h > min_lines:
            break
        nxt = cur.select(*text, "i", "line_no", "need", F.lead("i", h).over(order).alias("j"),
                         *[F.xxhash64(F.lit(x), "a", "b", F.lead("a", h).over(order), F.lead("b", h).over(order)).alias(c)
                           for c, x in (("a", 0), ("b", 1))]).where(F.col("j") == F.col("i") + h).drop("j")
        cur = materialize(_not_unique(nxt, f"ranks{2 * h}"), f"survivors{2 * h}")
        h *= 2
    windows = materialize(reduce(DataFrame.unionByName, final), "windows")
    at = F.struct("doc_id", "th", "i")
    firsts = materialize(windows.groupBy("need", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"))
                         .where("n > 1").drop("n"), "firsts")
    later = windows.join(firsts, ["need", "a", "b"]).where(at > F.col("first"))
    gone = later.select(*text, F.explode(F.sequence(F.col("i"), F.col("i") + F.col("need") - 1)).alias("i")).distinct()
    # islands of consecutive lines
    runs = gone.withColumn("g", F.col("i") - F.row_number().over(order)).groupBy(*text, "g").agg(
        F.min("i").alias("lo"), F.max("i").alias("hi"))
    return runs.groupBy(*text).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, text_col: str = "text") -> DataFrame:
    """``docs`` with n_lines, removed_runs (line numbers), n_removed and the text that stays in ``kept``."""
    own = [c for c in docs.columns if c not in ("n_lines", "removed_runs", "n_removed", "kept")]
    docs = docs.select(*own)
    keyed = docs.withColumns({"_body": F.coalesce(text_col, F.lit(""))}).withColumn("_th", F.xxhash64("_body"))
    texts = keyed.select("doc_id", F.col("_th").alias("th"), F.col("_body").alias("body"))
    runs = materialize(repeated_runs(texts, min_lines, min_words).select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th2"), F.col("runs").alias("_runs")), "runs")
    # texts without a repeat are held back by a filter of fixed size; only the others are shuffled
    may_hold = bloom.native(runs.select(F.xxhash64("_id", "_th2").alias("key")), "key")
    hit = may_hold(F.xxhash64("doc_id", "_th"))
    some = keyed.where(hit)
    out = some.join(runs, some["doc_id"].eqNullSafe(runs["_id"]) & (some["_th"] == runs["_th2"]), "left")
    clean = keyed.where(~hit).withColumn("_runs", F.lit(None).cast(runs.schema["_runs"].dataType))
    out = out.drop("_id", "_th2").unionByName(clean)
    lines = F.split("_body", "\n")

    def numbers(arr: Column) -> Column:
        """Runs as line numbers: lines that are not blank are counted off."""
        solid = F.filter(F.transform(arr, lambda x, i: F.when(F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")) > 0, i)),
                         lambda i: i.isNotNull())
        return let(solid, lambda s: F.transform("_runs", lambda r: F.struct(
            s[r["lo"]].cast("int").alias("first"), s[r["hi"]].cast("int").alias("last"))))

    out = out.select(*own, "_body", "_runs", F.size(lines).alias("n_lines"),
                     F.when(F.col("_runs").isNotNull(), let(lines, numbers)).otherwise(F.array().cast(_RUNS)).alias("removed_runs"))

    def stays(arr: Column) -> Column:
        r, n = F.col("removed_runs"), F.size("removed_runs")

        def piece(k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(r[F.greatest(k - 1, F.lit(0))]["last"] + 1)
            end = F.when(k == n, F.size(arr)).otherwise(r[F.least(k, n - 1)]["first"])
            return F.slice(arr, start + 1, end - start)
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), piece)), "\n")

    removed = F.aggregate("removed_runs", F.lit(0), lambda acc, r: acc + (r["last"] - r["first"] + 1))
    return out.select(*own, "n_lines", "removed_runs", removed.alias("n_removed"),
                      F.when(F.size("removed_runs") == 0, F.col(text_col)).otherwise(let(lines, stays)).alias("kept"))
