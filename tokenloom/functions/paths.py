"""Path Column helpers (``pathlib`` semantics on '/'-separated relative paths)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------------------
# Extensions the corpus scan indexes (compared lower-cased).
INDEXABLE_EXTS = [".py", ".js", ".ts", ".jsx", ".tsx", ".md", ".txt"]
# Default exclude names of the index scan and the watcher (exact name match, not globs).
DEFAULT_EXCLUDES = ["node_modules", ".git", "__pycache__", "venv", ".env"]
# Components skipped by the reference search.
SEARCH_IGNORE_DIRS = [".git", "node_modules", "__pycache__", "venv", ".venv", "dist", "build"]
# Suffixes the reference search skips (compared lower-cased).
SEARCH_BINARY_SUFFIXES = [".sqlite", ".db", ".pyc", ".png", ".jpg", ".exe", ".dll", ".zip", ".tar", ".gz"]
# Directory names left out of the tree listing.
TREE_IGNORE_DIRS = [".git", "node_modules", "__pycache__", "venv", ".venv", "env",
                    ".env", "dist", "build", "coverage", ".pytest_cache", ".idea", ".vscode"]
# Language dispatch by lower-cased suffix for the brace-language outline.
BRACE_LANG_BY_EXT = {".js": "javascript", ".jsx": "tsx", ".ts": "typescript", ".tsx": "tsx"}
# ---------------------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parts(path) -> Column:
    return F.split(_c(path), "/")


def name(path) -> Column:
    return F.element_at(parts(path), -1)


def dirs(path) -> Column:
    """Directory components (all parts but the file name)."""
    p = parts(path)
    return F.slice(p, 1, F.size(p) - 1)


def parent(path) -> Column:
    """Parent directory ('' for a top-level entry)."""
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def suffix(name_col) -> Column:
    """``Path.suffix``: last '.xxx' of the name; a name that is only a leading dot has none."""
    return F.regexp_extract(_c(name_col), r"(?s)^.+(\.[^./]+)$", 1)


def brace_lang(path) -> Column:
    """Brace-language of a path (lower-cased suffix), NULL when not one."""
    ext = F.lower(suffix(name(path)))
    expr = F.lit(None).cast("string")
    for e, lang in BRACE_LANG_BY_EXT.items():
        expr = F.when(ext == e, F.lit(lang)).otherwise(expr)
    return expr


def is_python(path) -> Column:
    """Python only when the path ends with lower-case '.py' ('.PY' is not Python)."""
    return _c(path).endswith(".py")


def ancestors(dir_col) -> Column:
    """All ancestor directories of a '/'-joined directory, itself included, nearest first.

    ``a/b/c`` -> ``[a/b/c, a/b, a]``; the empty root is never included.
    """
    p = F.split(_c(dir_col), "/")
    n = F.size(p)
    return F.when(_c(dir_col) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(p, 1, k), "/")))
