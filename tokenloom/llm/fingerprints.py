"""Operator 2: document fingerprints (one-permutation MinHash, DataFrame functions only).

Every five-word shingle of a text is hashed once. The hash's top bits name one of BINS bins, and each
bin keeps its smallest hash. Empty bins are filled by optimal densification: a bin borrows from bins
that a fixed random sequence of its own names, the first that is filled. Of every bin the low BITS
bits are kept and packed into 64-bit words. Likeness is the share of equal bins, corrected for the
2**-BITS chance that different minima agree in their kept bits.

Defined results: a null text is an empty text; a text without words has an empty fingerprint, which
is like another empty one to 1.0 and like any other to 0.0; a text of fewer than five words has one
shingle; equal texts have equal fingerprints. Nothing is shared between rows, so repeated rows, long
texts and further columns need no care.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import let, materialize, shingle_hashes

LOG2_BINS, BITS = 8, 4
BINS = 1 << LOG2_BINS
PER_WORD = 64 // BITS
WORDS = BINS // PER_WORD
SHIFT = 63 - LOG2_BINS                      # hashes are used as 63-bit non-negative numbers
LOW = (1 << SHIFT) - 1
TRIES = 8                                   # borrowing attempts before the exhaustive one


def _minima(shingles: Column) -> Column:
    """Smallest hash of every bin, in bin order; ``LOW`` in the low bits marks an empty bin."""
    hashes = F.transform(shingles, lambda x: F.shiftrightunsigned(x, 1))
    marks = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint")),
                        lambda b: F.shiftleft(b, SHIFT).bitwiseOR(F.lit(LOW)))
    return let(F.sort_array(F.concat(hashes, marks)), lambda a: F.filter(
        a, lambda x, i: F.when(i == 0, True).otherwise(
            F.shiftright(x, SHIFT) != F.shiftright(a[F.greatest(i - 1, F.lit(0))], SHIFT))))


def _borrow(v: Column) -> Column:
    """Fill null bins: TRIES draws from the bin's own sequence, then the filled bin that the bin
    ranks first among all (so that it always ends)."""
    def filled(f: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            draws = [v[F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)).cast("int")] for t in range(TRIES)]
            rest = F.array_min(F.transform(f, lambda b: F.xxhash64(F.lit("rank"), j, b)
                                           .bitwiseAND(F.lit(-(1 << BITS))).bitwiseOR(v[b])))
            return F.coalesce(x, *draws, rest.bitwiseAND(F.lit((1 << BITS) - 1)))
        return F.transform(v, one)
    return let(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: v[b].isNotNull()), filled)


def fingerprint(text: Column, k: int = 5) -> Column:
    """The packed fingerprint (WORDS 64-bit numbers) of a text; empty for a text without words."""
    def pack(nib: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda q: F.aggregate(
            F.slice(nib, q * PER_WORD + 1, PER_WORD), F.lit(0).cast("bigint"),
            lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x)))

    def of(sh: Column) -> Column:
        low = F.transform(_minima(sh), lambda x: F.when(x.bitwiseAND(F.lit(LOW)) != LOW,
                                                        x.bitwiseAND(F.lit((1 << BITS) - 1))))
        return F.when(F.size(sh) == 0, F.array().cast("array<bigint>")).otherwise(let(let(low, _borrow), pack))

    return let(shingle_hashes(text, k), of)


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts from their fingerprints, 0 to 1."""
    ones = int("".join("1" if i % BITS == BITS - 1 else "0" for i in range(64)), 2)

    def differing(q: int) -> Column:
        x = F.get(a, F.lit(q)).bitwiseXOR(F.get(b, F.lit(q)))
        y = x
        for s in range(1, BITS):
            y = y.bitwiseOR(F.shiftrightunsigned(x, s))
        return F.bit_count(y.bitwiseAND(F.lit(ones)))

    same = F.lit(BINS) - sum((differing(q) for q in range(1, WORDS)), differing(0))
    chance = 2.0 ** -BITS
    est = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1 - chance))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
            .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(est))


def with_next(docs: DataFrame, cols: list[str], derived: dict[str, Column], id_col: str = "doc_id",
              per_range: int = 20_000) -> DataFrame:
    """Every row with the ``derived`` columns and with ``next`` = struct of ``cols`` and these of the row
    that follows by descending id (nulls last, ties by the hash of ``cols``); the first row follows the last.

    Ids are cut into ranges of about ``per_range`` rows by quantiles and by width inside a quantile,
    and each range is ordered by itself. The first row of every following range joins the range in
    front of it as an extra last row, so no task sees more than one range.
    """
    spark = docs.sparkSession
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("lo"), F.max(id_col).alias("hi"),
                     F.percentile_approx(id_col, [i / 64 for i in range(65)], 10_000).alias("q")).first()
    n, q = stats["n"], sorted(set(stats["q"] or []))
    lo = stats["lo"] if stats["lo"] is not None else 0
    key = F.coalesce(F.col(id_col), F.lit(lo - 1))       # nulls come after every id
    cell = F.lit(0).cast("bigint")
    parts = max(1, -(-n // (per_range * max(1, len(q) - 1))))
    for i in range(len(q) - 1):
        width = max(1, -(-(q[i + 1] - q[i]) // parts))
        cell = F.when(key >= F.lit(q[i]), F.least(F.lit(parts - 1).cast("bigint"), F.floor((key - F.lit(q[i])) / width))
                      + F.lit(1 + i * parts)).otherwise(cell)
    if n <= per_range:
        cell = F.lit(0).cast("bigint")
    keyed = docs.select("*", key.alias("_key"), cell.alias("_cell"), F.xxhash64(*cols).alias("_tie"))
    # one small row a range: the top key of the following range (the first range follows the last)
    tops = docs.select(key.alias("_key"), cell.alias("_cell")).groupBy("_cell").agg(F.max("_key").alias("top"))
    order = Window.orderBy(F.col("_cell").desc())
    tops = tops.select("_cell", F.coalesce(F.lead("top").over(order), F.first("top").over(order)).alias("_key"))
    tops = materialize(tops.withColumnRenamed("_cell", "_to"), "tops")
    extra = (keyed.join(tops, "_key").withColumn("_cell", F.col("_to")).drop("_to")
             .withColumn("_extra", F.lit(True)))
    rows = keyed.withColumn("_extra", F.lit(False)).unionByName(extra).withColumns(derived)
    w = Window.partitionBy("_cell").orderBy("_extra", F.col("_key").desc(), "_tie")
    return (rows.withColumn("next", F.lead(F.struct(*cols, *derived)).over(w)).where(~F.col("_extra"))
            .drop("_key", "_cell", "_tie", "_extra"))


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last third of code points replaced by as many first ones of ``other``."""
    n = F.length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(other, F.lit(1), cut))
