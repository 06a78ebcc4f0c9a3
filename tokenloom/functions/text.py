"""Text Column helpers with the exact Python semantics the reduced views depend on.

Every helper returns a Column built from ``pyspark.sql.functions`` only, so the work stays
inside whole-stage code generation (no Python worker on the hot path).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------
# Fixed values (must stay equal to the behaviour being reproduced)
# ---------------------------------------------------------------------------------------
# Characters Python's str.isspace() accepts, used for str.strip() and "line is blank".
PY_SPACE_CLASS = (
    r"\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# The same characters as a string.
PY_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Line boundaries of Python str.splitlines() once CR/CRLF are normalised to LF.
PY_LINE_BREAKS = r"[\x{000A}\x{000B}\x{000C}\x{001C}\x{001D}\x{001E}\x{0085}\x{2028}\x{2029}]"
# Pre-token pattern used as the native token estimate (letters runs, 1-3 digit groups,
# punctuation runs). Counts are an estimate of a BPE tokenizer, not BPE counts.
PRETOKEN_PATTERN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"
# Comment rule of the comment-strip view: '#' to end of line, in every language.
HASH_COMMENT = r"#[^\n]*"
# Display line limit of the reference search (117 characters and the ellipsis).
DISPLAY_MAX = 120
DISPLAY_ELLIPSIS = "..."
# Snippet limit for hits that carry no path.
SNIPPET_MAX = 500
SNIPPET_SUFFIX = "\n...[Content Truncated]"
# ---------------------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` (also for use inside lambdas)."""
    return F.transform(F.array(value), body)[0]


def normalize_newlines(c) -> Column:
    """Universal-newline read: CRLF and lone CR become LF (text-mode file read)."""
    return F.regexp_replace(_c(c), r"\r\n?", "\n")


def py_strip(c) -> Column:
    """``str.strip()`` — trims all Python whitespace, not only spaces."""
    return F.btrim(_c(c), F.lit(PY_SPACES))


def is_blank(c) -> Column:
    """True when ``not s.strip()``."""
    return ~_c(c).rlike(rf"[^{PY_SPACE_CLASS}]")


def split_lines(c) -> Column:
    """``str.splitlines()`` of an LF-normalised string as ARRAY<STRING>.

    ``split`` leaves one trailing empty element when the text ends with a break, and returns
    ``[""]`` for the empty string; both are removed so the pieces equal Python's.
    """
    c = _c(c)
    parts = F.split(c, PY_LINE_BREAKS, -1)
    n = F.size(parts)
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, n - 1)).otherwise(parts)
    return F.when(c.isNull(), F.lit(None)).when(c == "", F.array().cast("array<string>")).otherwise(trimmed)


def token_estimate(c) -> Column:
    """Token count estimate; empty or NULL text counts 0 (BIGINT)."""
    c = _c(c)
    return F.coalesce(F.regexp_count(c, F.lit(PRETOKEN_PATTERN)), F.lit(0)).cast("bigint")


def strip_hash_comments(c) -> Column:
    """Comment-strip view: drop '#…' to end of line, drop blank lines, join with LF."""
    no_comments = F.regexp_replace(_c(c), HASH_COMMENT, "")
    kept = F.filter(split_lines(no_comments), lambda s: ~is_blank(s))
    return F.array_join(kept, "\n")


def display_line(c, limit: int | None = None) -> Column:
    """A search result's line: whole, or with a ``limit`` (the search tool's is DISPLAY_MAX) cut to it,
    the ellipsis included."""
    s = _c(c)
    if limit is None:
        return s
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit - len(DISPLAY_ELLIPSIS)), F.lit(DISPLAY_ELLIPSIS))).otherwise(s)


def snippet(content, path, limit: int | None = None) -> Column:
    """Content of a hit without a path: whole, or with a ``limit`` (the search tool's is SNIPPET_MAX) its
    first characters and a suffix."""
    content = _c(content)
    if limit is None:
        return content
    return F.when(_c(path).isNull() & (F.length(content) > limit),
                  F.concat(F.substring(content, 1, limit), F.lit(SNIPPET_SUFFIX))).otherwise(content)


def decode_utf8_strict(binary_col) -> tuple[Column, Column]:
    """Strict UTF-8 decode: (text or NULL, status 'ok' / 'undecodable')."""
    txt = F.try_validate_utf8(_c(binary_col).cast("string"))
    return normalize_newlines(txt), F.when(txt.isNull(), F.lit("undecodable")).otherwise(F.lit("ok"))


def decode_utf8_lossy(binary_col) -> Column:
    """``errors='ignore'`` decode: invalid bytes are dropped (a genuine U+FFFD is dropped too)."""
    return normalize_newlines(F.replace(F.make_valid_utf8(_c(binary_col).cast("string")),
                                        F.lit("�"), F.lit("")))
