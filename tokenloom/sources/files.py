"""File-tree sources: list a tree inside tasks, then read only the files that pass the path filters.

Folders are listed level by level: the folders of a level are dealt out to tasks, each lists its own, and
what they find is the next level. Files are opened by their exact names (nothing is taken for a pattern, names that
begin with ``.`` or ``_`` included), through ``pyarrow.fs``, so any file system that it reaches by
URI will do. The driver sees no path, only whether a level was empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import text as T
from tokenloom.session import checkpoint_dir

READ_ROWS, READ_BYTES = 1_000, 32 << 20      # files, and bytes after which no file is added, of one output batch
BLOCK = 1 << 20                              # bytes read at once
MAX_BYTES = 256 << 20                        # of a file that is one row; larger ones are read as chunks
CHUNK_BYTES = 16 << 20


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return pafs.FileSystem.from_uri(root if "://" in root else "file://" + root[len("file:"):])
    return pafs.LocalFileSystem(), root


def entries(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    """What lies directly in a folder."""
    return fs.get_file_info(pafs.FileSelector(folder))


def list_tree(spark: SparkSession, root: str, enter: Callable[[Column], Column] | None = None,
              entries: Callable[[pafs.FileSystem, str], list[pafs.FileInfo]] = entries) -> DataFrame:
    """(path, length) of every regular file below ``root``, paths relative to it. Folders for which
    ``enter(path)`` is false are not listed; a folder that cannot be listed has no files (see ``tree_entries``)."""
    return tree_entries(spark, root, enter, entries).where("not is_dir and status = 'ok'").select("path", "length")


def tree_entries(spark: SparkSession, root: str, enter: Callable[[Column], Column] | None = None,
                 entries: Callable[[pafs.FileSystem, str], list[pafs.FileInfo]] = entries) -> DataFrame:
    """(path, is_dir, length, status) of every file and folder below ``root``, and of folders that could not be listed.

    The scan goes on past such a folder: it has a second row with the status ``denied`` (no permission), ``missing`` (gone since
    its parent was listed, or not a folder) or ``unreadable``; the root's own row has an empty path.
    """
    root = root.rstrip("/")
    checkpoint_dir(spark)
    schema = "path string, is_dir boolean, length bigint, status string"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        for b in batches:
            for folder in b.column("path").to_pylist():
                at = f"{base}/{folder}" if folder else base
                try:
                    found, failed = entries(fs, at), None
                except PermissionError:
                    found, failed = [], "denied"
                except (FileNotFoundError, NotADirectoryError):
                    found, failed = [], "missing"
                except OSError:
                    found, failed = [], "unreadable"
                if failed:
                    yield pa.RecordBatch.from_pydict({"path": pa.array([folder]), "is_dir": pa.array([True]), "length": pa.array([0], pa.int64()),
                                                      "status": pa.array([failed])})
                for i in range(0, len(found), 10_000):
                    part = found[i:i + 10_000]
                    yield pa.RecordBatch.from_pydict({
                        "path": pa.array([f"{folder}/{f.base_name}" if folder else f.base_name for f in part], pa.string()),
                        "is_dir": pa.array([f.type == pafs.FileType.Directory for f in part], pa.bool_()),
                        "length": pa.array([f.size or 0 for f in part], pa.int64()),
                        "status": pa.array(["ok"] * len(part), pa.string())})

    level, out = spark.range(1).select(F.lit("").alias("path")), None
    n = spark.sparkContext.defaultParallelism
    while True:
        found = level.repartition(n, "path").mapInArrow(look, schema).checkpoint()
        out = found if out is None else out.unionByName(found)
        level = found.filter("is_dir and status = 'ok'").select("path")
        if enter is not None:
            level = level.filter(enter(F.col("path")))
        if level.isEmpty():
            return out


def _stream(fh, limit: int) -> tuple[bytes | None, int, str]:
    """(bytes, or null above the limit; length; sha256) of a file, read block by block: no more than the limit is held."""
    digest, parts, n = hashlib.sha256(), [], 0
    while block := fh.read(BLOCK):
        digest.update(block)
        n += len(block)
        if n <= limit:
            parts.append(block)
        else:
            parts.clear()
    return (b"".join(parts) if n <= limit else None), n, digest.hexdigest()


def _scan(listing: DataFrame, root: str, limit: int) -> DataFrame:
    """(path, raw, length, content_sha, status) of listed files; raw is null above ``limit`` bytes and where a file cannot be read."""
    schema = pa.schema([("path", pa.string()), ("raw", pa.binary()), ("length", pa.int64()), ("content_sha", pa.string()), ("status", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        for b in batches:
            out, held = [], 0
            for name in b.column("path").to_pylist():
                try:
                    with fs.open_input_stream(f"{base}/{name}", compression=None) as fh:
                        raw, n, sha = _stream(fh, limit)
                    out.append({"path": name, "raw": raw, "length": n, "content_sha": sha, "status": "ok" if raw is not None else "oversize"})
                    held += len(raw or b"")
                except OSError:
                    out.append({"path": name, "status": "unreadable"})
                if held >= READ_BYTES or len(out) == READ_ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)

    return listing.select("path").mapInArrow(read, "path string, raw binary, length bigint, content_sha string, status string")


def _listed(spark: SparkSession, root: str, keep: Callable[[Column], Column] | None, enter: Callable[[Column], Column] | None) -> DataFrame:
    listing = list_tree(spark, root, enter)
    return listing if keep is None else listing.filter(keep(F.col("path")))


def read_tree(spark: SparkSession, root: str, keep: Callable[[Column], Column] | None = None,
              lossy: bool = False, enter: Callable[[Column], Column] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Scan a tree into ``(path, content, status, content_sha)``.

    Two passes: the listing is filtered by ``keep(path)`` first, and only the files that pass are opened.
    ``lossy`` drops undecodable bytes (the reference-search reader); otherwise undecodable files get
    ``status='undecodable'``. A file that cannot be opened gets ``status='unreadable'``. One of over ``max_bytes`` gets its digest
    and ``status='oversize'`` without a content: ``read_chunks`` reads it.
    """
    root = root.rstrip("/")
    raw = _scan(_listed(spark, root, keep, enter), root, max_bytes)
    if lossy:
        content, status = T.decode_utf8_lossy("raw"), F.lit("ok")
    else:
        content, status = T.decode_utf8_strict("raw")
    return raw.select("path", content.alias("content"), F.when(F.col("status") == "ok", status).otherwise(F.col("status")).alias("status"), "content_sha")


def hash_tree(spark: SparkSession, root: str, keep: Callable[[Column], Column] | None = None,
              enter: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, length, content_sha, status) of files of any size: a task holds one block of one file."""
    root = root.rstrip("/")
    hashed = _scan(_listed(spark, root, keep, enter), root, -1)
    return hashed.select("path", "length", "content_sha", F.when(F.col("status") == "oversize", "ok").otherwise(F.col("status")).alias("status"))


def read_chunks(spark: SparkSession, root: str, keep: Callable[[Column], Column] | None = None, enter: Callable[[Column], Column] | None = None,
                over: int = MAX_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, chunk, offset, raw, status) of the files of more than ``over`` bytes: consecutive byte ranges, dealt out to tasks by range, so
    that one large file is read by many. A range that cannot be read has a null ``raw`` and the status ``unreadable``; so has one
    that the file no longer fills. Ranges are those of the length that the listing saw.
    """
    root = root.rstrip("/")
    ranges = _listed(spark, root, keep, enter).where(F.col("length") > over).select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / chunk_bytes))).alias("chunk"))
    ranges = ranges.select("path", "chunk", (F.col("chunk") * chunk_bytes).alias("offset"),
                           F.least(F.lit(chunk_bytes).cast("bigint"), F.col("length") - F.col("chunk") * chunk_bytes).alias("n"))
    schema = pa.schema([("path", pa.string()), ("chunk", pa.int64()), ("offset", pa.int64()), ("raw", pa.binary()), ("status", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        for b in batches:
            for name, k, offset, n in zip(*(b.column(c).to_pylist() for c in ("path", "chunk", "offset", "n"))):
                try:
                    with fs.open_input_file(f"{base}/{name}") as fh:
                        raw = fh.read_at(n, offset)
                except OSError:
                    raw = b""
                full = len(raw) == n
                yield pa.RecordBatch.from_pylist([{"path": name, "chunk": k, "offset": offset, "raw": raw if full else None,
                                                   "status": "ok" if full else "unreadable"}], schema)

    parts = spark.sparkContext.defaultParallelism
    return ranges.repartition(parts, "path", "chunk").mapInArrow(read, "path string, chunk bigint, offset bigint, raw binary, status string")
