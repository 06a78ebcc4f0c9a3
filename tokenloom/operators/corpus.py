"""Corpus table jobs: path predicates, fingerprints, token counts, comment-stripped view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tokenloom.functions import paths as P
from tokenloom.functions import text as T


def with_path_parts(df: DataFrame, path: str = "path") -> DataFrame:
    """Add name, lower-cased suffix ``ext`` and directory components ``dirs``."""
    return (df.withColumn("name", P.name(path))
              .withColumn("ext", F.lower(P.suffix(P.name(path))))
              .withColumn("dirs", P.dirs(path)))


def indexable(path: Column | str, excludes: Sequence[str] = P.DEFAULT_EXCLUDES,
              exts: Sequence[str] = P.INDEXABLE_EXTS) -> Column:
    """Index-scan predicate: suffix in the extension set, file name not excluded, and no
    directory component excluded or hidden (hidden *files* are kept)."""
    path = F.col(path) if isinstance(path, str) else path
    d = P.dirs(path)
    excl = F.array(*[F.lit(x) for x in excludes]) if excludes else F.array().cast("array<string>")
    return (F.lower(P.suffix(P.name(path))).isin(list(exts))
            & ~P.name(path).isin(list(excludes))
            & ~F.arrays_overlap(d, excl)
            & ~F.exists(d, lambda x: x.startswith(".")))


def watch_valid(path: Column | str, root_name: str, excludes: Sequence[str] = P.DEFAULT_EXCLUDES,
                exts: Sequence[str] = P.INDEXABLE_EXTS) -> Column:
    """Change-event predicate: every component (file name too) is tested; hidden names are
    rejected; a component equal to the project folder's own name, or '.', is exempt."""
    path = F.col(path) if isinstance(path, str) else path
    parts = P.parts(path)
    bad = F.exists(parts, lambda p: (p.isin(list(excludes)) | p.startswith("."))
                   & (p != F.lit(root_name)) & (p != F.lit(".")))
    return F.lower(P.suffix(P.name(path))).isin(list(exts)) & ~bad


def search_scannable(path: Column | str) -> Column:
    """Reference-search predicate on components below the root (file name included)."""
    path = F.col(path) if isinstance(path, str) else path
    ignore = F.array(*[F.lit(x) for x in P.SEARCH_IGNORE_DIRS])
    return (~F.arrays_overlap(P.parts(path), ignore)
            & ~F.lower(P.suffix(P.name(path))).isin(P.SEARCH_BINARY_SUFFIXES))


def fingerprints(corpus: DataFrame) -> DataFrame:
    """Document key = sha256(path); content fingerprint = sha256(content); line/char counts."""
    return corpus.select(
        "path",
        F.sha2(F.col("path"), 256).alias("doc_id"),
        F.sha2(F.col("content"), 256).alias("content_sha"),
        F.size(T.split_lines("content")).cast("bigint").alias("n_lines"),
        F.length("content").cast("bigint").alias("n_chars"),
    )


def token_counts(corpus: DataFrame) -> DataFrame:
    """Raw-read view: text tokens per file; unreadable files count 0."""
    ok = F.col("status") == "ok" if "status" in corpus.columns else F.lit(True)
    return corpus.select("path", F.when(ok, T.token_estimate("content")).otherwise(F.lit(0))
                         .cast("bigint").alias("tokens"))


def comment_stripped(corpus: DataFrame) -> DataFrame:
    """Comment-strip view of every file with its token count."""
    s = T.strip_hash_comments("content")
    return corpus.select("path", s.alias("text"), T.token_estimate(s).alias("tokens"))


def index_rows(corpus: DataFrame, project: Column | str | None = None, embed=None) -> DataFrame:
    """Rows ready for the vector index: readable files only (unreadable is never indexed).

    ``embed`` (a Column function of the text column giving array<float>) fills the vectors; without it
    a new key has none.
    """
    df = corpus.filter(F.col("status") == "ok") if "status" in corpus.columns else corpus
    proj = F.col(project) if isinstance(project, str) else (project if project is not None else F.lit("global"))
    vector = embed(F.col("content")) if embed is not None else F.lit(None).cast("array<float>")
    return df.select(proj.alias("project"), F.sha2("path", 256).alias("doc_id"), "path", "content",
                     F.create_map(F.lit("path"), F.col("path")).alias("metadata"), vector.alias("embedding"))


def index_files(current: DataFrame, corpus: DataFrame, mode: str = "upsert", project: Column | str | None = None, embed=None) -> DataFrame:
    """The index after a scan: readable, indexable files are written by key. ``mode="sync"`` also removes
    keys of the index whose file the scan no longer has. A single file is a scan of one row."""
    rows = index_rows(corpus.filter(indexable("path")), project, embed)
    batch = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(current.schema[c].dataType).alias(c) for c in current.columns])
    if mode == "sync":
        return batch
    if mode != "upsert":
        raise ValueError(f"unknown mode {mode!r}")
    return current.join(batch.select("doc_id"), "doc_id", "left_anti").unionByName(batch)


def _counts() -> list[Column]:
    fits, ok = indexable("path"), F.col("status") == "ok"
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return [n(fits & ok).alias("indexed"), n(fits & ~ok).alias("unreadable"), n(~fits).alias("skipped")]


def indexed_count(corpus: DataFrame) -> DataFrame:
    """How many files of a scan are indexed, and how many are left out by path or as unreadable."""
    return corpus.agg(*_counts())


def write_index_rows(corpus: DataFrame, path: str, project: Column | str | None = None, embed=None) -> dict[str, int]:
    """Write the index rows of a scan and return the counts of ``indexed_count``, taken while the scan is written:
    files are read once."""
    seen = Observation()
    rows = index_rows(corpus.observe(seen, *_counts()).filter(indexable("path")), project, embed)
    rows.write.mode("overwrite").parquet(path)
    return seen.get
