"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without it; a scratch folder is then set for the session.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        d = "file://" + tempfile.mkdtemp(prefix="tokenloom-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts lineage, survives a lost executor, and gives later joins measured sizes, so that
    adaptive execution can broadcast a small side or split a hot key of a large one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tokenloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body`` (also inside its lambdas)."""
    return F.transform(F.array(value), body)[0]


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id is the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def words(text: Column) -> Column:
    """Words of a text: maximal runs of characters that are not ASCII white space, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def shingle_hashes(text: Column, k: int = 5) -> Column:
    """64-bit hashes of all k-word shingles in order (repeats kept). A text of fewer than k words,
    but not none, has one shingle of all its words; a text without words has none."""
    def of(h: Column) -> Column:
        n = F.size(h)
        return (F.when(n == 0, F.array().cast("array<bigint>"))
                .when(n < k, F.array(F.aggregate(h, F.lit(42).cast("bigint"), lambda a, x: F.xxhash64(a, x))))
                .otherwise(F.transform(F.slice(h, 1, F.greatest(n - (k - 1), F.lit(1))),
                                       lambda x, i: F.xxhash64(x, *[h[i + j] for j in range(1, k)]))))
    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def lean() -> None:
    """Called first in a task: Arrow's memory goes back to the system when it is freed, since Spark keeps
    its Python workers for later stages."""
    pa.set_memory_pool(pa.system_memory_pool())


def parts(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of ``column``: what a task returns
    with its texts then travels in small pieces."""
    for b in batches:
        off = spans_of(b.column(column))[1] if b.num_rows else np.zeros(1, np.int64)
        for i, j in chunks(off, limit):
            yield b.slice(i, j - i)


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of parts of a batch that hold about ``limit`` bytes each."""
    col = batch.column(column)
    off = spans_of(col)[1] if batch.num_rows else np.zeros(1, np.int64)
    for i, j in chunks(off, limit):
        yield i, col.slice(i, j - i).to_pylist()


# ---- bytes of a batch of texts, as numpy sees them ------------------------------------------

def spans_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string Arrow column; a null row is an empty span."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off.astype(np.int64)


def chunks(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold about ``limit`` bytes (always at least one row)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_ODD = np.uint64(0x9E3779B97F4A7C15)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def byte_codes(seed: int) -> np.ndarray:
    """A random odd 64-bit code for every byte value (fixed by the seed)."""
    return np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)


class Rolling:
    """Hashes of arbitrary spans of a byte string by one pass of prefix sums (mod 2**64)."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        self.codes = byte_codes(seed + 1)
        self.base = int(rng.integers(2**61, 2**63, dtype=np.uint64)) * 2 + 1 & (2**64 - 1)
        self.inverse = pow(self.base, -1, 2**64)
        self.grow(size)

    def grow(self, size: int) -> None:
        self.pow = powers(self.base, size + 1)
        self.inv = powers(self.inverse, size + 1)

    def load(self, data: np.ndarray) -> None:
        n = len(data)
        if n >= len(self.pow):
            self.grow(n + n // 4)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(self.codes[data] * self.pow[:n], out=self.sum[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.inv[start])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD
    return x ^ (x >> np.uint64(29))
