"""Outline and block jobs: hand-written samples and a differential test against ``ast``."""

import ast
import glob
import os
import re
from dataclasses import replace

from pyspark.sql import functions as F
from tokenloom.operators import outline as O

PY_SAMPLE = '''import os

QUERY = """
def not_real():
    pass
"""


@register(
    "route",
    methods=["GET"])
async def handler(request):
    def inner():
        class Hidden:
            pass
    return inner


class Store(Base,
            Mixin):
    total = {"a": 1,
             "b": 2}

    @staticmethod
    def make(): return Store()

    def long_signature(self, a,
                       b, c=(1,
                             2)):
        x = a + \\
            b
        return x


if os.name:
    def posix_only():
        return 1
else:
    def other():
        return 2


def last(): pass
'''


def _definitions(src):
    """Every definition with its first line (decorators included), own line and last line."""
    kinds = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)
    found = [n for n in ast.walk(ast.parse(src)) if isinstance(n, kinds)]
    return [(min([d.lineno for d in n.decorator_list] + [n.lineno]), n.lineno, n.end_lineno, n) for n in found]


def expected_outline(src):
    """Lines of the definitions that lie in no function's span."""
    defs, lines = _definitions(src), src.split("\n")
    inside = {n for _, at, end, f in defs if not isinstance(f, ast.ClassDef) for n in ast.walk(f) if n is not f and at <= getattr(n, "lineno", 0) <= end}
    out = []
    for first, at, _, n in sorted(defs, key=lambda d: (d[1], d[3].col_offset)):
        if n not in inside:
            out += [x.strip() for x in lines[first - 1:at - 1]] + [lines[at - 1].strip() + " ..."]
    return "\n".join(out)


def expected_block(src, name):
    """The function of that name that begins last."""
    spans = [(at, first, end) for first, at, end, n in _definitions(src) if not isinstance(n, ast.ClassDef) and n.name == name]
    if not spans:
        return None
    _, first, end = max(spans)
    return "\n".join(src.split("\n")[first - 1:end])


def test_python_sample(spark):
    df = spark.createDataFrame([("s.py", PY_SAMPLE)], "path string, content string")
    got = O.python_outline(df).collect()[0].text
    assert got == expected_outline(PY_SAMPLE)


def test_python_blocks_sample(spark):
    df = spark.createDataFrame([("s.py", PY_SAMPLE)], "path string, content string")
    names = ["handler", "inner", "long_signature", "make", "Store", "other", "nope"]
    req = spark.createDataFrame([("s.py", n) for n in names], "path string, name string")
    got = {r.name: r.text for r in O.python_blocks(df, req).collect()}
    for n in names:
        assert got.get(n) == expected_block(PY_SAMPLE, n), n


def test_python_empty_file_gives_empty_outline(spark):
    df = spark.createDataFrame([("e.py", "x = 1\nprint(x)\n")], "path string, content string")
    r = O.python_outline(df).collect()[0]
    assert r.text == "" and r.tokens == 0


def _stdlib_files(n=120):
    import json

    base = os.path.dirname(json.__file__).rsplit("/", 1)[0]
    files = sorted(glob.glob(base + "/*.py"))[:n]
    out = []
    for f in files:
        src = open(f, encoding="utf-8").read()
        if "\t" in src or "\r" in src:
            continue
        try:
            ast.parse(src)
        except SyntaxError:
            continue
        out.append((f, src))
    return out


def test_python_outline_differential_stdlib(spark):
    files = _stdlib_files()
    df = spark.createDataFrame(files, "path string, content string")
    got = {r.path: r.text for r in O.python_outline(df).collect()}
    bad = [p for p, src in files if got[p] != expected_outline(src)]
    assert not bad, bad[:5]


JS_SAMPLE = """import React from 'react';
// function commented() {}
const s = "function quoted() {";
export default function App({ items }) {
  const inner = () => 1;
  return items.map((x) => x);
}
export class Widget extends Base {
  static create(a, b) {
    return new Widget(a, b);
  }
  async load() {
    const t = `${a} { not a brace`;
  }
}
export const Card = ({ title }) => {
  const onClick = () => {};
  return title;
};
const obj = { m() { return 1; } };
const plain = 42;
app.get('/x', (req, res) => {
  res.send('ok');
});
function* gen() { yield 1; }
"""

JS_EXPECTED = [
    "export default function App({ items }) { ...",
    "export class Widget extends Base { ...",
    "static create(a, b) { ...",
    "async load() { ...",
    "export const Card = ({ title }) => { ...",
    "app.get('/x', (req, res) => { ...",
]


def test_js_sample(spark):
    df = spark.createDataFrame([("a.jsx", JS_SAMPLE)], "path string, content string")
    got = O.js_outline(df).collect()[0].text.split("\n")
    assert got == JS_EXPECTED


def test_js_blocks(spark):
    df = spark.createDataFrame([("a.ts", JS_SAMPLE)], "path string, content string")
    req = spark.createDataFrame([("a.ts", "create"), ("a.ts", "App"), ("a.ts", "nope")], "path string, name string")
    got = {r.name: r.text for r in O.js_blocks(df, req).collect()}
    assert got["create"] == "static create(a, b) {\n    return new Widget(a, b);\n  }"
    assert got["App"].startswith("function App({ items }) {") and got["App"].endswith("\n}")
    assert "nope" not in got


JS_HEADS = """export const Card = ({
  title,
}) => {
  return a.map((x) => x);
};
class W {
  render(
    a,
  ) { return a.map((x) => x); }
  run(cb = noop()) {
    cb(() => 1);
  }
  id<T>(x: T): T { return x; }
}
abstract class Q { go() { return 1; } }
const a = () => 1; const b = () => 2;
const c = 1
items.forEach((item) => {
  console.log(item);
})
type Fn = (x: number) => void;
interface I { f: (x) => void }
foo((x) => x, (y) => y);
async function load<T>(a: T,
  b = (1)): Promise<T> { return a; }
"""


def test_js_heads_over_lines_generics_defaults_and_two_on_a_line(spark):
    df = spark.createDataFrame([("a.ts", JS_HEADS), ("b.ts", "foo((x) => {")], "path string, content string")
    got = {r.path: r for r in O.js_outline(df).collect()}
    assert got["a.ts"].text.split("\n") == [x + " ..." for x in (
        "export const Card = ({", "class W {", "render(", "run(cb = noop()) {", "id<T>(x: T): T { return x; }",
        "abstract class Q { go() { return 1; } }", "const a = () => 1; const b = () => 2;", "const a = () => 1; const b = () => 2;",
        "items.forEach((item) => {", "foo((x) => x, (y) => y);", "foo((x) => x, (y) => y);", "async function load<T>(a: T,")]
    assert got["a.ts"].balanced and not got["b.ts"].balanced
    req = spark.createDataFrame([("a.ts", n) for n in ("Card", "render", "b", "c", "load")], "path string, name string")
    blocks = {r.name: r.text for r in O.js_blocks(df, req).collect()}
    assert blocks["Card"] == JS_HEADS[len("export const "):JS_HEADS.index(";\nclass")]
    assert blocks["render"] == "render(\n    a,\n  ) { return a.map((x) => x); }"
    assert blocks["b"] == "b = () => 2" and blocks["c"] == "c = 1"
    assert blocks["load"].startswith("async function load<T>") and blocks["load"].endswith("{ return a; }")


def test_reduced_view_chain(spark):
    rows = [("a.js", "const x = 1;\n# hash\n", "ok"), ("b.py", "def f():\n    pass\n", "ok"),
            ("c.md", "# Title\ntext\n", "ok"), ("d.PY", "def g(): pass\n", "ok"), ("e.py", None, "undecodable")]
    df = spark.createDataFrame(rows, "path string, content string, status string")
    got = {r.path: (r.stage, r.text) for r in O.reduced_view(df).collect()}
    assert got["a.js"] == ("stripped", "const x = 1;")
    assert got["b.py"] == ("py_outline", "def f(): ...")
    assert got["c.md"] == ("stripped", "text")
    assert got["d.PY"] == ("stripped", "def g(): pass")
    assert got["e.py"][0] == "unreadable"


GO = """package main

import "fmt"

// func Hidden() {
type Shape struct {
\tName string
}

func (s *Shape) Area(w int, h int) int {
\tif w > 0 {
\t\treturn w * h
\t}
\tf := func(x int) int { return x }
\treturn f(0)
}

func main() { fmt.Println("func Fake() {") }
"""
NIM = """import os
# proc hidden() =
type Point = object
  x: int

proc area(w,
          h: int): int =
  proc inner(): int =
    w
  inner() * h

func twice(x: int): int =
  x * 2
echo area(1, 2)
"""


def test_other_languages_by_rows_alone(spark):
    """A brace language and an indentation language as rows of the rule table."""
    word = r"([A-Za-z_]\w*)"
    go = [("type", rf"type\s+{word}\s+struct\s*\{{", rf"(?m)^type\s+{word}\s+struct\s*\{{", rf"^type\s+{word}", r"^type\s+", True, False),
          ("func", rf"func\s+(?:\([^()]*\)\s*)?{word}\([^()]*\)[^{{\n]*\{{", rf"(?m)^func\s+(?:\([^()]*\)\s*)?{word}\([^()]*\)[^{{\n]*\{{",
           rf"^func\s+(?:\([^()]*\)\s*)?{word}", None, True, True)]
    nim = [("type", rf"^\s*type\s+{word}", None, None, None, True, False),
           ("proc", rf"^\s*(?:proc|func)\s+{word}", None, rf"^\s*(?:proc|func)\s+{word}", None, True, True)]
    rows = [(".go", "go_outline", "brace", r'//[^\n]*|/\*[\s\S]*?\*/|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"|`[^`]*+`', "//", "/*", go, r"[;\n]", None, None, True, False),
            (".nim", "nim_outline", "indent", r'#[^\n]*|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"', "#", None, nim, None, None, None, False, False)]
    table = O.languages(O.rule_rows(spark).unionByName(spark.createDataFrame(rows, O.RULE_SCHEMA)))
    assert {k: table[k] for k in O.LANGUAGES} == O.LANGUAGES and set(table) - set(O.LANGUAGES) == {".go", ".nim"}
    files = spark.createDataFrame([("a.go", GO, "ok"), ("b.nim", NIM, "ok"), ("c.py", "def f():\n    return 1\n", "ok"), ("d.rs", "fn x() {} # no\n", "ok"),
                                   ("e.go", "package x\n", "ok"), ("f.go", None, "unreadable"), ("g.JS", "function k() { }", "ok"), ("h.GO", GO, "ok")],
                                  "path string, content string, status string")
    view = {r.path: (r.stage, r.text, r.balanced) for r in O.reduced_view(files, table=table).collect()}
    assert view["a.go"] == ("go_outline", "type Shape struct { ...\nfunc (s *Shape) Area(w int, h int) int { ...\nfunc main() { fmt.Println(\"func Fake() {\") } ...", True)
    assert view["b.nim"] == ("nim_outline", "type Point = object ...\nproc area(w, ...\nfunc twice(x: int): int = ...", True)
    assert view["c.py"][:2] == ("py_outline", "def f(): ...") and view["g.JS"][0] == "js_outline" and view["f.go"][0] == "unreadable"
    assert {view[k][0] for k in ("d.rs", "e.go", "h.GO")} == {"stripped"}
    asked = spark.createDataFrame([("a.go", "Area"), ("a.go", "Shape"), ("a.go", "Fake"), ("b.nim", "area"), ("b.nim", "Point"), ("b.nim", "twice"), ("c.py", "f"),
                                   ("d.rs", "x")], "path string, name string")
    got = {(r.path, r.name): r.text if r.found else None for r in O.function_blocks(files, asked, table=table).collect()}
    assert got["a.go", "Area"] == GO[GO.index("func (s"):GO.index("\n\nfunc main")] and got["a.go", "Shape"] == "Shape struct {\n\tName string\n}"
    assert got["b.nim", "area"] == NIM[NIM.index("proc area"):NIM.index("\n\nfunc twice")] and got["b.nim", "twice"] == "func twice(x: int): int =\n  x * 2"
    assert got["c.py", "f"] == "def f():\n    return 1" and [got[k] for k in (("a.go", "Fake"), ("b.nim", "Point"), ("d.rs", "x"))] == [None] * 3


def test_rule_tables_that_cannot_be_used(spark):
    import pytest

    one = O.rule_rows(spark).where("ext = '.py'")
    with pytest.raises(ValueError, match="repeated"):
        O.languages(one.unionAll(one))
    with pytest.raises(ValueError, match="block style"):
        O.languages(one.withColumn("block", F.lit("columns")))
    with pytest.raises(ValueError, match="at most"):
        O.languages(spark.range(O.MAX_RULES + 1).select(F.concat(F.lit("."), F.col("id").cast("string")).alias("ext")).crossJoin(one.drop("ext")))


MODES = r"""const a = `x ${ok ? `in ${deep(`}`)} {` : "}"} y {`;
function one(b): { n: number; s: string } {
  return { n: 1, s: `${b.map((q) => `<${q}>`).join(`,`)} it's {` };
}
const two: (x: number) => string = (x) => `${x}`;
const three = (x: number): { n: Map<string, { k: number }> } => {
  return x; // don't {
};
class W {
  four(a: string): Promise<{ n: number }[]> {
    return a.replace(/[/"'`{]/g, "}").split(/\{/);
  }
  five(cb: (e: { m: string }) => void): { ok: boolean } | null {
    /* `${ ' " */
    return <p>Don't {cb} stop, it's {a}</p>;
  }
}
const six = `line {
  ${list.map((i) => { return `${i}
  }`; })}
  function hidden() {`;
function seven() { return 'it\'s { \
 }' + "\"{"; }
"""


def test_js_modes_follow_nested_literals_and_types(spark):
    df = spark.createDataFrame([("a.ts", MODES)], "path string, content string")
    got = O.js_outline(df).collect()[0]
    assert got.balanced
    assert got.text.split("\n") == [
        "function one(b): { n: number; s: string } { ...", "const two: (x: number) => string = (x) => `${x}`; ...",
        "const three = (x: number): { n: Map<string, { k: number }> } => { ...", "class W { ...",
        "four(a: string): Promise<{ n: number }[]> { ...", "five(cb: (e: { m: string }) => void): { ok: boolean } | null { ...",
        "function seven() { return 'it\\'s { \\ ..."]
    names = ["one", "two", "three", "four", "five", "six", "seven", "hidden"]
    req = spark.createDataFrame([("a.ts", n) for n in names], "path string, name string")
    blocks = {r.name: r.text for r in O.js_blocks(df, req).collect()}
    src = MODES
    assert blocks["one"] == src[src.index("function one"):src.index("\nconst two")]
    assert blocks["two"] == "two: (x: number) => string = (x) => `${x}`"
    assert blocks["three"] == src[src.index("three ="):src.index(";\nclass W")]
    assert blocks["four"] == src[src.index("four("):src.index("\n  five(")]
    assert blocks["five"] == src[src.index("five("):src.index("\n}\nconst six")]
    assert blocks["six"] == src[src.index("six ="):src.index(";\nfunction seven")]
    assert blocks["seven"] == src[src.index("function seven"):].rstrip()
    assert "hidden" not in blocks


def test_mask_keeps_every_character_in_place(spark):
    import random

    rng, marks = random.Random(3), ["`", "${", "}", "{", "'", '"', "/", "//", "/*", "*/", "\\", "\n", "=", "(", "a", "é", " ", "[", "]", "x=>", "𝒳"]
    texts = [MODES, "", None] + ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", O.mask(F.col("t"), O.JAVASCRIPT).alias("m")).collect():
        assert (r.m is None) == (r.t is None)
        if r.t is not None:
            assert len(r.m) == len(r.t), r
            assert [i for i, c in enumerate(r.t) if c == "\n"] == [i for i, c in enumerate(r.m) if c in "\n" + O.INNER_BREAK]


def _masked_by_hand(t):
    '''Nested templates without other literals: text is filler, code and the braces around it stay.'''
    out, stack, i = [], [], 0
    while i < len(t):
        c = t[i]
        if stack and stack[-1] == "t":
            if t.startswith("${", i):
                out.append("x{")
                stack.append("e")
                i += 2
                continue
            if c == "`":
                stack.pop()
            out.append(O.INNER_BREAK if c == "\n" else "x")
        elif c == "`":
            stack.append("t")
            out.append("x")
        else:
            if c == "{":
                stack.append("b")
            elif c == "}" and stack:
                stack.pop()
            out.append(c)
        i += 1
    return "".join(out)


def test_templates_of_any_depth(spark):
    import random

    rng = random.Random(8)

    def code(d):
        kinds = [rng.choice(["a", " + ", "{b}", "\n", "`" if d else "c"]) for _ in range(rng.randrange(5))]
        return "".join(f"`{text(d - 1)}`" if k == "`" else k for k in kinds)

    def text(d):
        kinds = [rng.choice(["t", "{", "}", "'", '"', "//", "/*", "\n", "$t", "${", "${"]) for _ in range(rng.randrange(6))]
        return "".join("${" + code(d) + "}" if k == "${" else k for k in kinds)

    texts = [code(12) for _ in range(200)] + ["`${" * 40 + "x" + "}`" * 40]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", O.mask(F.col("t"), O.JAVASCRIPT).alias("m")).collect():
        assert r.m == _masked_by_hand(r.t)


def test_heavy_rows_are_dealt_out_without_the_setting(spark):
    from tokenloom.plans import code_corpus, domain

    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (
        code_corpus.code_files(spark, "/root/testdata/sf0.001"), domain.corpus(spark, "/root/testdata/sf0.001", heavy=True))]
    assert all("RepartitionByExpression" in p for p in plans)


def test_blocks_are_joined_without_a_broadcast(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "def f():\n    return 1\n", "ok"), ("b.js", "function g() { return 2; }\n", "ok")], "path string, content string, status string")
    asked = spark.createDataFrame([("a.py", "f"), ("b.js", "g"), ("b.js", "h")], "path string, name string")
    files.write.parquet(str(tmp_path / "files"))                # a table with a measured size, which is far below the threshold
    asked.write.parquet(str(tmp_path / "asked"))
    got = O.function_blocks(spark.read.parquet(str(tmp_path / "files")), spark.read.parquet(str(tmp_path / "asked")))
    assert sorted((r.path, r.name, r.found) for r in got.collect()) == [("a.py", "f", True), ("b.js", "g", True), ("b.js", "h", False)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_texts_without_brackets_or_arrows_are_not_folded(spark):
    texts = ["plain; text, 'its", "a class of its own", "const a = 1\nlet b", "x => y", "`${a}`", "", "class A {", ")", "'(' \"", "type A = b;\nfunction f", "/* ( */", None]
    files = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    whole = O._js_rows(O._js_events(F.col("content")))
    got = files.select("i", "content", O._js_outlined(F.col("content")).alias("short"), whole.alias("whole"))
    assert [r.i for r in got.collect() if r.short != r.whole] == []
    plan = got.select("short")._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT RLIKE(content" in plan


def test_a_text_is_cut_in_one_search(spark):
    texts = ["", "a1b22c", "1", "11a", "x\u00021y2", "no digits", "é1\n2", "$0\\1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.c.gaps, r.c.found) for r in df.select("t", O._cut(F.col("t"), r"\d+", lambda g, f: F.struct(g.alias("gaps"), f.alias("found"))).alias("c")).collect()}
    assert got == {t: (re.split(r"\d+", t), re.findall(r"\d+", t)) for t in texts}
    assert spark.range(1).select(O._cut(F.lit(None).cast("string"), "x", lambda g, f: g).alias("c")).first().c is None


def test_events_inside_words_are_skipped_without_a_difference(spark):
    text = "let a = myasync (x) => x;\nfoo\u0002(b)\nif (q) { get z() { return 'it' } } // it's {\nxfunction f() {}\n$async\n(y) => {}\n"
    every = replace(O.JAVASCRIPT, separator=O.JS_SEPARATOR + "|(?!)")        # the same events, looked for at every place
    assert "(?!async)" in str(O._js_events(F.col("t"))) and "(?!async)" not in str(O._js_events(F.col("t"), every))
    for t in (text, text.replace("\u0002", "")):
        got = spark.createDataFrame([(t,)], "t string").select(O._js_events(F.col("t")).alias("e"), O._js_events(F.col("t"), every).alias("all")).first()
        assert got.e == got["all"] and "async (x) => " in [e.text for e in got.e] and len(got.e) > 12


def test_only_names_that_a_file_has_are_looked_for(spark):
    df = spark.createDataFrame([(["f", "g", "h"], [("g",), ("",), ("g",), ("f",)])], "names array<string>, l array<struct<name:string>>")
    assert df.select(O._defined("names", "l.name").alias("n")).first().n == ["f", "g"]
    files = spark.createDataFrame([("a.js", "function f() { g(); }\nfunction g() { return 1; }\nconst f = 2;", "ok"), ("a.py", "def f():\n    pass\ndef f(x):\n    return x\n", "ok")],
                                  "path string, content string, status string")
    asked = spark.createDataFrame([(p, n) for p in ("a.js", "a.py") for n in ("f", "g", "h")], "path string, name string")
    got = {(r.path, r.name): r.text if r.found else None for r in O.function_blocks(files, asked).collect()}
    assert got == {("a.js", "f"): "function f() { g(); }", ("a.js", "g"): "function g() { return 1; }", ("a.js", "h"): None,
                   ("a.py", "f"): "def f(x):\n    return x", ("a.py", "g"): None, ("a.py", "h"): None}
