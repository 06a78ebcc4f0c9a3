"""Blocked Bloom filter: built by a distributed aggregate, probed in Arrow batches.

All bits of a key lie in one block of 512 bits (eight 64-bit words), so a probe touches one cache
line. The number of blocks is a parameter, so the filter that tasks receive has a fixed size
(64 bytes a block) however many keys are listed; a longer list only raises the share of false
hits, which the exact join behind the filter removes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROBES = 6


def build(keys: DataFrame, col: str, log2_blocks: int = 14) -> np.ndarray:
    """Bits of all values of the bigint column ``col`` as a (blocks, 8) array of words."""
    n = 1 << log2_blocks
    h = F.col(col)
    bits = F.array(*[F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(511)) for i in range(PROBES)])
    word = [F.bit_or(F.when(F.shiftright("bit", 6) == k, F.expr("shiftleft(1L, cast(bit & 63 as int))")).otherwise(0)).alias(f"w{k}")
            for k in range(8)]
    rows = (keys.where(h.isNotNull())
            .select(F.xxhash64(F.lit("block"), h).bitwiseAND(F.lit(n - 1)).alias("block"), F.explode(bits).alias("bit"))
            .groupBy("block").agg(*word))
    out = np.zeros((n, 8), np.uint64)
    got = rows.toArrow()         # at most one row a block: bounded by the parameter
    block = got.column("block").to_numpy()
    for k in range(8):
        out[block, k] = got.column(f"w{k}").to_numpy().view(np.uint64)
    return out


def block_of(col: str, log2_blocks: int):
    """The block of a key as a column (to be passed to ``probe`` with the key itself)."""
    return F.xxhash64(F.lit("block"), F.col(col)).bitwiseAND(F.lit((1 << log2_blocks) - 1))


def probe(bits: np.ndarray, block: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys may be listed (no false negatives)."""
    k = key.astype(np.int64).view(np.uint64)
    hit = np.ones(len(k), bool)
    for i in range(PROBES):
        b = (k >> np.uint64(9 * i)) & np.uint64(511)
        hit &= (bits[block, (b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1
    return hit


def native(keys: DataFrame, col: str, log2_bits: int = 24, probes: int = 3):
    """A condition on a bigint column in DataFrame functions only: true for values of ``col`` in
    ``keys`` and for few others. The bits are one array of fixed size that a scalar subquery hands
    to the tasks."""
    from tokenloom.llm.common import materialize

    spark, n = keys.sparkSession, 1 << (log2_bits - 6)

    def places(h):
        return [F.xxhash64(F.lit(i), h).bitwiseAND(F.lit((1 << log2_bits) - 1)) for i in range(probes)]

    bit = F.explode(F.array(*places(F.col(col)))).alias("bit")
    set_ = keys.where(F.col(col).isNotNull()).select(bit).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    dense = set_.union(spark.range(n).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))).groupBy("word").agg(
        F.bit_or("bits").alias("bits"))
    row = materialize(dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda s: s["bits"]).alias("bits")), "filter")

    def may_hold(value):
        bits, out = row.select("bits").scalar(), F.lit(True)
        for p in places(value):
            out = out & (F.call_function("shiftrightunsigned", F.get(bits, F.shiftright(p, 6).cast("int")),
                                         p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out

    return may_hold
