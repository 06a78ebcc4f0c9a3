"""Column helpers against the Python string semantics they reproduce."""

import pytest

from tokenloom.functions import paths as P
from tokenloom.functions import text as T

SAMPLES = [
    "", "a", "a\n", "a\n\nb", "\n", "x\x0by\x0cz", "p\x1cq\x85r s ", "tail\n\n",
    "  # comment only\ncode = 1  # trailing\n\n\t\nend # x", "#\n#\n", "## Heading\ntext",
    "　 wide  ", " \x1f x \x1c", "s = '#not' # real",
]


# the comment-strip view of each sample
STRIPPED = [
    "", "a", "a", "a\nb", "", "x\ny\nz", "p\nq\nr\ns", "tail", "code = 1  \nend ", "", "text", "\u3000 wide \xa0", " \x1f x ", "s = '",
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    return {r.i: r for r in df.select(
        "i", T.split_lines("s").alias("lines"), T.py_strip("s").alias("strip"),
        T.strip_hash_comments("s").alias("nocomment")).collect()}


def test_splitlines(rows):
    for i, s in enumerate(SAMPLES):
        assert list(rows[i].lines) == s.splitlines(), repr(s)


def test_strip(rows):
    for i, s in enumerate(SAMPLES):
        assert rows[i].strip == s.strip(), repr(s)


def test_comment_strip(rows):
    assert [rows[i].nocomment for i in range(len(SAMPLES))] == STRIPPED


def test_display_cut(spark):
    df = spark.createDataFrame([("x" * 120,), ("y" * 121,)], "s string")
    assert [r[0] for r in df.select(T.display_line("s", T.DISPLAY_MAX)).collect()] == ["x" * 120, "y" * 117 + "..."]
    assert [r[0] for r in df.select(T.display_line("s")).collect()] == ["x" * 120, "y" * 121]


def test_snippet(spark):
    df = spark.createDataFrame([("x" * 501, None), ("x" * 501, "p"), ("x" * 500, None)], "c string, p string")
    assert [r[0] for r in df.select(T.snippet("c", "p", T.SNIPPET_MAX)).collect()] == [
        "x" * 500 + "\n...[Content Truncated]", "x" * 501, "x" * 500]
    assert {r[0] for r in df.select(T.snippet("c", "p")).collect()} == {"x" * 501, "x" * 500}


def test_suffix_and_lang(spark):
    names = ["a.py", "a.tar.gz", ".bashrc", "a.", "..a", "noext", "X.PY", "c.TSX"]
    from pathlib import PurePosixPath

    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "p string")
           .select(P.suffix("p")).collect()]
    assert got == [PurePosixPath(n).suffix for n in names]


def test_token_estimate_zero_for_empty(spark):
    r = spark.createDataFrame([("",), (None,)], "s string").select(T.token_estimate("s")).collect()
    assert [x[0] for x in r] == [0, 0]
