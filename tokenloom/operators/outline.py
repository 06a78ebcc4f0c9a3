"""Outlines and definition blocks of source files, as folds over arrays inside each row.

No parser runs here and nothing is shuffled: a file is one row, and everything is built from functions
on its text. The text is masked first (comments become blanks, literals become filler, every character keeps
its place), then cut into lines (Python) or into heads, brackets and separators (JS/TS) by one regular
expression, and one fold over that list tracks bracket depth and the definition that covers the
current place. Only requests for single blocks are joined with their files.

Rules by language are a table (``LANGUAGES``, as rows ``rule_rows``), read by every function here: another brace or indentation
language is rows with its patterns (``languages``). The patterns become part of the plan, where they are compiled once; they are not
compared with texts as columns.

Known limits: syntax errors are not followed, but a file whose brackets do not balance is flagged
(``balanced``); JS/TS regex literals are recognised heuristically; parentheses are followed five levels deep
inside a head, type arguments and braces in types three. Template literals are followed to any depth, code inside them is code; an
apostrophe in JSX text is told by the letters around it, other single quotes there end with their line.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import paths as P
from tokenloom.functions import text as T

# ---------------------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------------------
SIG_SUFFIX = " ..."
NOT_EXTRACTED = "# Function '%s' could not be extracted accurately. Use raw read or check name."
UNREADABLE_PREFIX = "# could not read file: "
# ---------------------------------------------------------------------------------------

INNER_BREAK = "\u0001"       # a line break inside a literal
CUT = "\u0002"               # stands around what a pattern cuts out

PY_MASK = (r'#[^\n]*'
           r'|(?:\b[rRbBuUfF]{1,2})?(?:"""[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+"""'
           r"|'''[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+'''"
           r'|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"'
           r"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+')")
_PY_NAME = r"([\p{L}_][\p{L}\p{N}_]*)"

# marks that can change what the text after them is; a slash that may begin a regex is cut with the sign before it, and an
# apostrophe inside a word with the letter after it
JS_MARKS = (r"(?=[\\/*$=(,:!&|?;'\"`{}\[\]\n])(?:"          # the first sign of a mark, so that most places are left at once
            r"\\\n|\\[^\n*]|//|/\*|\*/|\$\{|[=(,:!&|?;][ \t]{0,3}/(?![*/])(?=[^\n]*/)"
            r"|(?<=\p{L})(?<!\b(?:return|case|typeof|in|of|else|import|from|export|default|as))'\p{L}"
            r"""|["'`{}\[\]\n/])""")
# Modes: q s strings, t template text, e code inside a template, b braces in code, l k comments, r regex, i class in a regex.
# Classes of marks: the mark itself, L K D // /* */, $ the braces in a template, O slash of a regex, A apostrophe, n line break, N escaped one.
_OPENS, _OPENED, _OPENED_AS = "\"'`LKO{$", "qstlkrbb", "XXXCCRcc"
_CLOSES = " q\" qn s' sA sn t` ln lN kD r/ rL rK rD rO rn i] in e} b} "


def _nested(open_: str, close: str, levels: int, stop: str = "") -> str:
    """A bracketed text with the same brackets nested up to ``levels`` deep."""
    plain = rf"[^{open_}{close}{stop}]"
    out = rf"\{open_}{plain}*+\{close}"
    for _ in range(levels - 1):
        out = rf"\{open_}(?:{plain}++|{out})*+\{close}"
    return out


_PARENS = _nested("(", ")", 6)
_BRACES = _nested("{", "}", 4)
_ANGLES = rf"<(?:[^<>(){{}};]++|{_BRACES}|<(?:[^<>(){{}};]++|{_BRACES}|<[^<>(){{}};]*+>)*+>)*+>"
# after the colon of a result: a brace is part of the type if something other than the body follows it on the line
_RESULT = rf"(?:\s*:(?:[^{{}};=]++|=>|{_BRACES}(?=[ \t]*[\[|&>{{,]))*+)?"
_TYPES = rf"(?:\s*{_nested('<', '>', 3, '(){};')})?"
_NAME = r"#?[\w$]+"
_STATEMENT = r"(?<![=(,:?&|!+\-*/%<>.\w$\[]\s{0,20})"            # not inside an expression
_MEMBER = r"(?<=[{};,\n][ \t]{0,99})"                            # begins a member or a statement
_ARROW = rf"(?:async\s*+)?(?:(?:{_nested('<', '>', 3, '(){};')}\s*)?{_PARENS}(?:\s*:(?:[^=(){{}};,<]++|{_ANGLES}|{_BRACES})*+)?|(?<![\w$])[\w$]++)\s*+=>\s*+\{{?"
_KEYWORDS = r"(?!(?:if|for|while|switch|catch|with|function|return|do|else|await|typeof|new|super)\b)"
_MODIFIERS = r"(?:(?:static|async|get|set|public|private|protected|readonly|override|accessor)\s+|\*\s*)*"
# kind -> pattern; the order decides. A head may span lines.
JS_HEADS = {
    "function": rf"(?=export|async|function){_STATEMENT}(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s+{_NAME}{_TYPES}\s*{_PARENS}{_RESULT}\s*\{{",
    "class": rf"(?=export|class){_STATEMENT}(?:export\s+(?:default\s+)?)?class\s+{_NAME}[^{{;]*+\{{",
    "interface": rf"(?=export|declare|interface){_STATEMENT}(?:export\s+(?:default\s+)?)?(?:declare\s+)?interface\s+{_NAME}[^{{;]*+\{{",
    "type": rf"(?=export|type){_STATEMENT}(?:export\s+)?type\s+{_NAME}{_TYPES}\s*=(?:[^;{{}}()\n]++|{_PARENS})*+",
    "arrow_declarator": rf"(?=export|const|let|var)(?<![\w$.])(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*(?::(?:[^=;{{}}]++|=>|{_BRACES})*+)?=\s*{_ARROW}",
    "declarator": rf"(?=const|let|var)(?<![\w$.])(?:const|let|var)\s+(?:{_NAME})?",
    "method": rf"(?=[\w$#*])(?<![\w$#.]){_MEMBER}{_MODIFIERS}{_KEYWORDS}{_NAME}{_TYPES}\s*{_PARENS}{_RESULT}\s*\{{",
    "arrow": _ARROW,
}
JS_NAME = {
    "function": rf"\bfunction\s+({_NAME})",
    "arrow_declarator": rf"\b(?:const|let|var)\s+({_NAME})",
    "declarator": rf"^(?:const|let|var)\s+({_NAME})",
    "method": rf"^{_MODIFIERS}({_NAME})",
}
# what stands before a node in its head: an export, the word that opens a declaration
JS_BEFORE = {
    "function": r"^export\s+(?:default\s+)?",
    "arrow_declarator": r"^(?:export\s+)?(?:const|let|var)\s+",
    "declarator": r"^(?:const|let|var)\s+",
}
# a line end that ends a statement: nothing is left open before it and a new statement begins after it
_LINE_END = r"(?=[ \t\n])(?<![-=>,(+*/&|?:\[{.<\s])[ \t]*+\n(?=\s*[\w$@\[{])"
JS_SEPARATOR = rf"[;,]|{_LINE_END}"
OPENING, CLOSING = r"[\(\[\{]", r"[\)\]\}]"
JS_INSIDE = r"(?<=[\w$])(?!async)[\w$]"       # inside a word, where no event begins
JS_NEEDS = r"[(\[{)\]}]|=>"   # a text without this has no bracket and none of the shown JS_HEADS


@dataclass(frozen=True)
class Head:
    """How a definition begins. ``cut`` finds it in a text and may look at what stands before it, ``tell`` recognises the cut
    text (a whole line in an indentation language); ``name`` has the name as its first group, a head without one is no block;
    ``before`` is what of the head stands before the node. ``shown`` heads are lines of an outline, those that ``cover`` hide
    what lies inside them."""

    kind: str
    tell: str
    cut: str | None = None
    name: str | None = None
    before: str | None = None
    shown: bool = True
    cover: bool = True


BLOCKS = ("indent", "brace", "brace_modes")


@dataclass(frozen=True)
class Language:
    """Rules of one language. The first head that fits counts. ``above`` and ``continues`` are lines of an indentation
    language that belong to the next definition, and that go on in the next line; ``separator`` ends a statement of a brace
    language. With ``or_else`` a file without definitions has no outline, and the next view is taken. In a ``brace_modes``
    language literals may hold code: ``mask`` cuts marks, and a stack of modes tells what each of them means."""

    stage: str
    block: str                    # one of BLOCKS
    mask: str                     # comments and literals
    line_comment: str
    block_comment: str | None
    heads: tuple[Head, ...]
    separator: str = "[;,]"
    above: str | None = None
    continues: str | None = None
    or_else: bool = False
    any_case: bool = False        # of the suffix


PYTHON = Language("py_outline", "indent", PY_MASK, "#", None, (
    Head("class", rf"^\s*class\s+{_PY_NAME}", cover=False),
    Head("function", rf"^\s*(?:def|async\s+def)\s+{_PY_NAME}", name=rf"^\s*(?:def|async\s+def)\s+{_PY_NAME}")), above=r"^\s*@", continues=r"\\\s*$")
JAVASCRIPT = Language("js_outline", "brace_modes", JS_MARKS, "//", "/*", tuple(
    # what stood before a head was checked when it was cut out
    Head(k, p.replace(_STATEMENT, "").replace(_MEMBER, ""), p, JS_NAME.get(k), JS_BEFORE.get(k),
         k in ("function", "class", "arrow_declarator", "method", "arrow"), k not in ("class", "type"))
    for k, p in JS_HEADS.items()), JS_SEPARATOR, or_else=True, any_case=True)
# in the order of the views
LANGUAGES: dict[str, Language] = {".js": JAVASCRIPT, ".jsx": JAVASCRIPT, ".ts": JAVASCRIPT, ".tsx": JAVASCRIPT, ".py": PYTHON}

MAX_RULES = 1_000        # rows of a rule table: they become part of the plan
RULE_SCHEMA = ("ext string, stage string, block string, mask string, line_comment string, block_comment string, "
               "heads array<struct<kind:string,tell:string,cut:string,name:string,before:string,shown:boolean,cover:boolean>>, "
               "separator string, above string, continues string, or_else boolean, any_case boolean")


def rule_rows(spark: SparkSession, table: Mapping[str, Language] = LANGUAGES) -> DataFrame:
    """The language table as rows, one a suffix."""
    return spark.createDataFrame([{"ext": e, **asdict(r)} for e, r in table.items()], RULE_SCHEMA)


def languages(rules: DataFrame) -> dict[str, Language]:
    """Rules by suffix from such rows. A repeated suffix, an unknown block style or more than MAX_RULES rows are errors."""
    out: dict[str, Language] = {}
    rows = rules.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"a rule table has at most {MAX_RULES} rows")
    for r in rows:
        row = r.asDict(recursive=True)
        ext = row.pop("ext")
        if ext in out or row["block"] not in BLOCKS:
            raise ValueError(f"rule for {ext!r} is repeated or has an unknown block style")
        heads = tuple(Head(**{**h, "shown": h["shown"] is not False, "cover": h["cover"] is not False}) for h in row.pop("heads"))
        out[ext] = Language(**{**row, "heads": heads, "separator": row["separator"] or "[;,]", "or_else": bool(row["or_else"]),
                               "any_case": bool(row["any_case"])})
    return out


def _by_language(table: Mapping[str, Language]) -> list[tuple[Language, list[str]]]:
    """Every language once, with its suffixes."""
    out: dict[Language, list[str]] = {}
    for ext, lang in table.items():
        out.setdefault(lang, []).append(ext)
    return list(out.items())


def _written_in(lang: Language, exts: list[str]) -> Column:
    if lang.any_case:
        return F.lower(P.suffix(P.name("path"))).isin([e.lower() for e in exts])
    return F.greatest(*[F.col("path").endswith(e) for e in [*exts, exts[0]]])


def _filler(literal: Column) -> Column:
    return F.translate(F.regexp_replace(literal, r"[^\n]", "x"), "\n", INNER_BREAK)


def _blank(comment: Column) -> Column:
    return F.regexp_replace(comment, r"[^\n]", " ")


def _cut(text: Column, pattern: str, body) -> Column:
    """``body(gaps, found)``: what the pattern finds in a text, and what stands before each find and after the last. The text is searched once,
    by a pattern that is compiled once (``split`` compiles its pattern for every text)."""
    def of(pieces: Column) -> Column:
        return F.struct(F.filter(pieces, lambda x, i: i % 2 == 0).alias("gaps"), F.filter(pieces, lambda x, i: i % 2 == 1).alias("found"))
    once = T.let(F.split(F.regexp_replace(text, pattern, f"{CUT}$0{CUT}"), CUT, -1), of)
    twice = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"))
    return T.let(F.when(text.contains(CUT), twice).otherwise(once), lambda c: body(c["gaps"], c["found"]))


def mask(content: Column, lang: Language) -> Column:
    """The text with comments blanked and literals filled, character for character."""
    if lang.block == "brace_modes":
        return _mask_by_modes(content, lang)

    def one(lit: Column) -> Column:
        out = F.when(lit.startswith(lang.line_comment), F.repeat(F.lit(" "), F.length(lit)))
        if lang.block_comment:
            out = out.when(lit.startswith(lang.block_comment), _blank(lit))
        return out.otherwise(_filler(lit))

    def whole(parts: Column, lits: Column) -> Column:
        rest = F.zip_with(F.transform(lits, one), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
                          lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.concat(parts[0], F.array_join(rest, ""))

    return _cut(content, lang.mask, whole)


def _mark_class(m: Column) -> Column:
    """One sign a mark (see JS_MARKS)."""
    return (F.when(m == "\n", "n").when(m == "//", "L").when(m == "/*", "K").when(m == "*/", "D").when(m == "${", "$").when(m == "\\\n", "N")
            .when(m.startswith("\\"), "\\").when(F.length(m) == 1, m).when(m.startswith("'"), "A").otherwise("O"))


def _modes(classes: Column) -> Column:
    """A fold over marks with a stack of modes (a string, its top first): what becomes of the text before each mark and of the
    mark (one sign a mark, see ``_mask_by_modes``), and the stack at the end."""
    def step(acc: Column, c: Column) -> Column:
        def of(top: Column) -> Column:
            stack, code = acc["stack"], top.isin("", "e", "b")
            opens = F.when(code, F.instr(F.lit(_OPENS), c)).otherwise(0)
            closes = F.instr(F.lit(_CLOSES), F.concat(F.lit(" "), top, c, F.lit(" "))) > 0
            after = (F.when(closes & (top == "i") & (c == "n"), F.substring(stack, 3, 1 << 30)).when(closes, F.substring(stack, 2, 1 << 30))
                     .when(opens > 0, F.concat(F.substring(F.lit(_OPENED), opens, F.lit(1)), stack))
                     .when((top == "t") & (c == "$"), F.concat(F.lit("e"), stack)).when((top == "r") & (c == "["), F.concat(F.lit("i"), stack))
                     .otherwise(stack))
            sign = (F.when(opens > 0, F.substring(F.lit(_OPENED_AS), opens, F.lit(1))).when(code, "c").when(top.isin("l", "k"), "k")
                    .when((top == "t") & (c == "$"), "E").when((top != "t") & (c == "n"), "n").otherwise("x"))
            turned = F.struct(F.concat(acc["signs"], sign).alias("signs"), after.alias("stack"))
            # most marks are line breaks in code, which change nothing
            return F.when((c == "n") & code, F.struct(F.concat(acc["signs"], F.lit("c")).alias("signs"), stack.alias("stack"))).otherwise(turned)
        return T.let(F.substring(acc["stack"], 1, 1), of)
    return F.aggregate(classes, F.struct(F.lit("").alias("signs"), F.lit("").alias("stack")), step)


def _mask_by_modes(content: Column, lang: Language) -> Column:
    """Code inside a template stays code, between the braces that hold it. Signs: c all stays, C the mark begins a comment, X a literal,
    R a regex, E code in a template; x and k lie inside a literal and a comment, n is the line break that ends an open literal."""
    def whole(parts: Column, marks: Column, modes: Column) -> Column:
        def one(m: Column, i: Column, signs: Column) -> Column:
            k, p = F.get(signs, i), F.get(parts, i)
            before = F.when(k.isin("c", "C", "X", "R"), p).when(k == "k", _blank(p)).otherwise(_filler(p))
            own = (F.when(k.isin("c", "n"), m).when(k.isin("C", "k"), _blank(m)).when(k == "E", F.lit("x{"))
                   .when(k == "R", F.concat(F.substring(m, F.lit(1), F.length(m) - 1), F.lit("x"))).otherwise(_filler(m)))
            return F.concat(before, own)
        top, rest = F.substring(modes["stack"], 1, 1), F.element_at(parts, -1)
        last = F.when(top.isin("", "e", "b"), rest).when(top.isin("l", "k"), _blank(rest)).otherwise(_filler(rest))
        body = T.let(F.split(modes["signs"], "", -1), lambda signs: F.array_join(F.transform(marks, lambda m, i: one(m, i, signs)), ""))
        return F.concat(body, last)

    return _cut(content, lang.mask, lambda parts, found: T.let(_modes(F.transform(found, _mark_class)), lambda modes: whole(parts, found, modes)))


def _delta(s: Column) -> Column:
    return (F.regexp_count(s, F.lit(OPENING)) - F.regexp_count(s, F.lit(CLOSING))).cast("int")


# ------------------------------------------------------------------------------- Python


def _py_lines(content: Column, lang: Language = PYTHON) -> Column:
    """One struct a line: what the fold needs of it, computed once."""
    def first(m: Column, value, default: Column) -> Column:
        out = default
        for h in reversed(lang.heads):
            out = F.when(m.rlike(h.tell), value(h, m)).otherwise(out)
        return out

    def fits(m: Column, pattern: str | None) -> Column:
        return m.rlike(pattern) if pattern else F.lit(False)

    def of(masked: Column) -> Column:
        breaks = F.regexp_extract_all(masked, F.lit(f"[\n{INNER_BREAK}]"), 0)
        return T.let(breaks, lambda br: F.transform(F.split(masked, f"[\n{INNER_BREAK}]", -1), lambda m, i: F.struct(
            i.alias("i"), (~m.rlike(r"\S")).alias("blank"),
            F.when(i > 0, F.get(br, i - 1) == INNER_BREAK).otherwise(False).alias("inside"),
            _delta(m).alias("delta"), fits(m, lang.continues).alias("goes_on"),
            F.length(F.regexp_extract(m, r"^[ \t]*", 0)).alias("indent"),
            first(m, lambda h, _: F.lit(h.kind), F.lit("")).alias("kind"),
            first(m, lambda h, x: F.regexp_extract(x, h.name, 1) if h.name else F.lit(""), F.lit("")).alias("name"),
            fits(m, lang.above).alias("at"))))
    return T.let(mask(content, lang), of)


def _py_statement(acc: Column, s: Column) -> Column:
    """The line begins a statement: not blank, not in a literal, a bracket or a continued line."""
    return ~s["blank"] & ~s["inside"] & (acc["depth"] <= 0) & ~acc["goes_on"]


def _py_decorated(acc: Column, s: Column, begins: Column) -> Column:
    """First line of the decorators above the next definition, -1 without any."""
    return (F.when(begins & s["at"], F.when(acc["first"] >= 0, acc["first"]).otherwise(s["i"]))
            .when(begins, F.lit(-1)).otherwise(acc["first"]))


def _py_rows(lines: Column, lang: Language = PYTHON) -> Column:
    """(i, signature) of every outline line, and the bracket depth at the end of the file."""
    shown, covering = [h.kind for h in lang.heads if h.shown], [h.kind for h in lang.heads if h.cover]

    def step(acc: Column, s: Column) -> Column:
        begins = _py_statement(acc, s)
        cover = F.when(begins & (s["indent"] <= acc["cover"]), F.lit(-1)).otherwise(acc["cover"])
        head = begins & (s["kind"] != "") & (cover < 0)
        kept = head & s["kind"].isin(shown)
        own = F.struct(s["i"].alias("i"), F.lit(True).alias("signature"))
        above = F.when((acc["first"] >= 0), F.transform(F.sequence(acc["first"], s["i"] - 1), lambda i: F.struct(
            i.alias("i"), F.lit(False).alias("signature")))).otherwise(F.array().cast("array<struct<i:int,signature:boolean>>"))
        return F.struct((acc["depth"] + s["delta"]).alias("depth"), s["goes_on"].alias("goes_on"),
                        F.when(head & s["kind"].isin(covering), s["indent"]).otherwise(cover).alias("cover"),
                        _py_decorated(acc, s, begins).alias("first"),
                        F.when(kept, F.concat(acc["rows"], above, F.array(own))).otherwise(acc["rows"]).alias("rows"))

    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("goes_on"), F.lit(-1).alias("cover"), F.lit(-1).alias("first"),
                    F.array().cast("array<struct<i:int,signature:boolean>>").alias("rows"))
    return F.aggregate(lines, zero, step, lambda acc: F.struct(acc["rows"].alias("rows"), (acc["depth"] == 0).alias("balanced")))


def _text(content: Column, rows: Column) -> Column:
    """Outline text: the named lines, stripped, signatures marked."""
    return T.let(F.split(content, "\n", -1), lambda o: F.array_join(F.transform(rows, lambda r: F.concat(
        T.py_strip(o[r["i"]]), F.when(r["signature"], F.lit(SIG_SUFFIX)).otherwise(F.lit("")))), "\n"))


def _py_span(lines: Column, name: Column) -> Column:
    """(start, end) lines of the last function of that name, start -1 without one."""
    def step(acc: Column, s: Column) -> Column:
        begins = _py_statement(acc, s)
        match = begins & (s["name"] != "") & (s["name"] == name)
        closes = begins & (acc["start"] >= 0) & (acc["end"] < 0) & (s["indent"] <= acc["indent"])
        return F.struct(
            (acc["depth"] + s["delta"]).alias("depth"), s["goes_on"].alias("goes_on"), _py_decorated(acc, s, begins).alias("first"),
            F.when(match, F.when(acc["first"] >= 0, acc["first"]).otherwise(s["i"])).otherwise(acc["start"]).alias("start"),
            F.when(match, s["indent"]).otherwise(acc["indent"]).alias("indent"),
            F.when(match, F.lit(-1)).when(closes, acc["full"]).otherwise(acc["end"]).alias("end"),
            F.when(s["blank"] & ~s["inside"], acc["full"]).otherwise(s["i"]).alias("full"))

    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("goes_on"), F.lit(-1).alias("first"), F.lit(-1).alias("start"),
                    F.lit(0).alias("indent"), F.lit(-1).alias("end"), F.lit(-1).alias("full"))
    return F.aggregate(lines, zero, step, lambda acc: F.struct(
        acc["start"].alias("start"), F.when(acc["end"] < 0, acc["full"]).otherwise(acc["end"]).alias("end")))


def python_outline(code: DataFrame, lang: Language = PYTHON) -> DataFrame:
    """(path, text, tokens, balanced): signature lines of definitions not inside a function, each with
    its decorator lines; a file without definitions has an empty outline."""
    res = code.select("path", "content", _py_rows(_py_lines(F.col("content"), lang), lang).alias("o"))
    res = res.select("path", _text(F.col("content"), F.col("o.rows")).alias("text"), F.col("o.balanced").alias("balanced"))
    return res.select("path", "text", T.token_estimate("text").alias("tokens"), "balanced")


def _asked(code: DataFrame, requests: DataFrame) -> DataFrame:
    """Files with the names that are asked of them: texts travel once, before anything is derived."""
    asked = requests.groupBy("path").agg(F.collect_set("name").alias("names"))
    return code.select("path", "content").hint("merge").join(asked, "path")      # sizes of derived texts are guessed far too low to broadcast by


def _defined(names: str, own: str) -> Column:
    """The names that a file's lines or events have: only these are looked for in it."""
    return T.let(F.array_distinct(own), lambda o: F.filter(names, lambda n: F.array_contains(o, n)))


def python_blocks(code: DataFrame, requests: DataFrame, lang: Language = PYTHON) -> DataFrame:
    """(path, name, text) for requested function names: the last match in file order; classes never
    match; decorators are included."""
    got = _asked(code, requests).select("path", "content", "names", _py_lines(F.col("content"), lang).alias("l"))
    got = got.select("path", "content", "l", F.explode(_defined("names", "l.name")).alias("name")).select(
        "path", "name", "content", F.explode(F.filter(F.array(_py_span(F.col("l"), F.col("name"))), lambda s: s["start"] >= 0)).alias("s"))
    return got.select("path", "name", F.array_join(F.slice(
        F.split("content", "\n", -1), F.col("s.start") + 1, F.col("s.end") - F.col("s.start") + 1), "\n").alias("text"))


# ------------------------------------------------------------------------------- JS / TS


def _no_rows() -> Column:
    return F.struct(F.array().cast("array<struct<i:int,signature:boolean>>").alias("rows"), F.lit(True).alias("balanced"))


def _js_events(content: Column, lang: Language = JAVASCRIPT) -> Column:
    """Heads, brackets and separators in order, with kind, name, line breaks and characters."""
    event = "|".join([*(h.cut or h.tell for h in lang.heads), r"[(\[{]", r"[)\]}]", lang.separator])
    if lang.heads == JAVASCRIPT.heads and lang.separator == JS_SEPARATOR:
        event = rf"(?!{JS_INSIDE})(?:{event})"

    def of(masked: Column) -> Column:
        def breaks(x: Column) -> Column:
            return F.length(x) - F.length(F.translate(x, f"\n{INNER_BREAK}", ""))

        def one(e: Column, before: Column) -> Column:
            sign = F.length(e) == 1                      # most events are one sign, which needs no pattern
            kind = F.when(sign & e.isin("(", "[", "{"), "open").when(sign & e.isin(")", "]", "}"), "close").when(sign & e.isin(";", ",", "\n"), "sep") \
                .when(e.rlike(r"^[ \t]*\n$"), "sep")
            for h in lang.heads:
                kind = kind.when(e.rlike("^(?:" + h.tell + ")$"), h.kind)
            delta = F.when(sign, F.when(e.isin("(", "[", "{"), 1).when(e.isin(")", "]", "}"), -1).otherwise(0)).otherwise(_delta(e))
            name, lead = F.lit(""), F.lit(0)
            return F.struct(kind.alias("kind"), e.alias("text"), delta.alias("delta"), e.endswith("{").alias("braced"),
                            breaks(before).alias("breaks"), breaks(e).alias("own_breaks"),
                            F.length(before).alias("gap"), F.length(e).alias("size"), name.alias("name"), lead.alias("lead"))
        return _cut(masked, event, lambda gaps, found: F.zip_with(found, F.slice(gaps, 1, F.size(found)), one))
    return T.let(mask(content, lang), of)


def _js_named(events: Column, lang: Language = JAVASCRIPT) -> Column:
    """Events with the name of the node and the length of what stands before it in its head."""
    def one(e: Column) -> Column:
        name, lead = F.lit(""), F.lit(0)
        for h in lang.heads:
            if h.name:
                name = F.when(e["kind"] == h.kind, F.regexp_extract(e["text"], h.name, 1)).otherwise(name)
            if h.before:
                lead = F.when(e["kind"] == h.kind, F.length(F.regexp_extract(e["text"], h.before, 0))).otherwise(lead)
        return e.withField("name", name).withField("lead", lead)
    return F.transform(events, one)


def _js_over(acc: Column, e: Column, level: str, braced: str) -> Column:
    """The node open at ``level`` ends with this event: its brace closes, or without one the expression
    ends at a separator or at the bracket around it."""
    after = acc["depth"] + e["delta"]
    return F.when(acc[braced], (e["kind"] == "close") & (after <= acc[level])).otherwise(
        ((e["kind"] == "sep") & (acc["depth"] <= acc[level])) | ((e["kind"] == "close") & (after < acc[level])))


def _js_rows(events: Column, lang: Language = JAVASCRIPT) -> Column:
    """(i, signature) of every outline line; a covering head hides what lies inside it."""
    kinds, shown, covering = ([h.kind for h in lang.heads if x(h)] for x in (lambda h: True, lambda h: h.shown, lambda h: h.cover))

    def step(acc: Column, e: Column) -> Column:
        line = acc["line"] + e["breaks"]
        over = (acc["cover"] >= 0) & _js_over(acc, e, "cover", "braced")
        cover = F.when(over, F.lit(-1)).otherwise(acc["cover"])
        head = e["kind"].isin(kinds) & (cover < 0)
        hides = head & e["kind"].isin(covering)
        return F.struct(
            (line + e["own_breaks"]).alias("line"), (acc["depth"] + e["delta"]).alias("depth"),
            F.when(hides, acc["depth"]).otherwise(cover).alias("cover"), F.when(hides, e["braced"]).otherwise(acc["braced"]).alias("braced"),
            F.when(head & e["kind"].isin(shown), F.concat(acc["rows"], F.array(F.struct(line.alias("i"), F.lit(True).alias("signature")))))
             .otherwise(acc["rows"]).alias("rows"))

    zero = F.struct(F.lit(0).alias("line"), F.lit(0).alias("depth"), F.lit(-1).alias("cover"), F.lit(False).alias("braced"),
                    F.array().cast("array<struct<i:int,signature:boolean>>").alias("rows"))
    return F.aggregate(events, zero, step, lambda acc: F.struct(acc["rows"].alias("rows"), (acc["depth"] == 0).alias("balanced")))


def _js_outlined(content: Column, lang: Language = JAVASCRIPT) -> Column:
    """``_js_rows`` of a text. With the heads of JS/TS, one that lacks what each of them needs has no rows and is balanced."""
    rows = _js_rows(_js_events(content, lang), lang)
    return F.when(~content.rlike(JS_NEEDS), _no_rows()).otherwise(rows) if lang.heads == JAVASCRIPT.heads else rows


def _js_span(events: Column, name: Column) -> Column:
    """(start, end) characters of the first function, method or declarator of that name, start -1 without one."""
    def step(acc: Column, e: Column) -> Column:
        at = acc["at"] + e["gap"]

        def after(start: Column, level: Column, braced: Column, end: Column) -> Column:
            return F.struct((at + e["size"]).alias("at"), (acc["depth"] + e["delta"]).alias("depth"), start.alias("start"), level.alias("level"),
                            braced.alias("braced"), end.alias("end"))
        same = acc["start"], acc["level"], acc["braced"]
        match = (e["name"] != "") & (e["name"] == name)
        before = F.when(match, after(at + e["lead"], acc["depth"], e["braced"], acc["end"])).otherwise(after(*same, acc["end"]))
        inside = F.when(_js_over(acc, e, "level", "braced"), after(*same, F.when(acc["braced"], at + 1).otherwise(at))).otherwise(after(*same, acc["end"]))
        return F.when(acc["end"] >= 0, acc).when(acc["start"] < 0, before).otherwise(inside)

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(-1).alias("start"), F.lit(0).alias("level"),
                    F.lit(False).alias("braced"), F.lit(-1).alias("end"))
    return F.aggregate(events, zero, step, lambda acc: F.struct(acc["start"].alias("start"), acc["end"].alias("end")))


def js_outline(code: DataFrame, lang: Language = JAVASCRIPT) -> DataFrame:
    """(path, text, tokens, balanced): one line per kept definition in file order; files without a
    definition are left out (the chain goes on to the next view)."""
    found = T.let(_js_outlined(F.col("content"), lang), lambda o: F.when(F.size(o["rows"]) > 0, F.array(F.struct(
        _text(F.col("content"), o["rows"]).alias("text"), o["balanced"].alias("balanced")))))
    res = code.select("path", F.explode(found).alias("o")).select("path", "o.text", "o.balanced")   # a filter would run it twice
    return res.select("path", "text", T.token_estimate("text").alias("tokens"), "balanced")


def js_blocks(code: DataFrame, requests: DataFrame, lang: Language = JAVASCRIPT) -> DataFrame:
    """(path, name, text): first match in file order, from the definition's first character to the
    bracket that closes it or to the end of its expression."""
    got = _asked(code, requests).select("path", "content", "names", _js_named(_js_events(F.col("content"), lang), lang).alias("e"))
    got = got.select("path", "content", "e", F.explode(_defined("names", "e.name")).alias("name")).select(
        "path", "name", "content", F.explode(F.filter(F.array(_js_span(F.col("e"), F.col("name"))), lambda s: s["start"] >= 0)).alias("s"))
    end = F.when(F.col("s.end") < 0, F.length("content")).otherwise(F.col("s.end"))
    return got.select("path", "name", F.rtrim(F.substring(F.col("content"), F.col("s.start") + 1, end - F.col("s.start"))).alias("text"))


# ------------------------------------------------------------------------------- chains


def reduced_view(corpus: DataFrame, token_count=T.token_estimate, keep: tuple[str, ...] = (), table: Mapping[str, Language] = LANGUAGES) -> DataFrame:
    """(path, text, tokens, stage, balanced) and the ``keep`` columns: the outline of the suffix's language ->
    comment strip.

    One projection per row, no join. Unreadable files give the sentinel text with 0 tokens.
    ``token_count`` is the token function (a Column function of a text column).
    """
    content = F.col("content")
    ok = F.col("status") == "ok"
    none = _no_rows()
    outline, stage = F.when(~ok, none), F.when(~ok, "unreadable")
    for lang, exts in _by_language(table):
        here = _written_in(lang, exts)
        rows = _py_rows(_py_lines(content, lang), lang) if lang.block == "indent" else _js_outlined(content, lang)
        outline = outline.when(here, rows)
        stage = stage.when((F.col("_lang") == lang.stage) & ((F.size("o.rows") > 0) if lang.or_else else F.lit(True)), lang.stage)
    spoken = F.coalesce(*[F.when(_written_in(lang, exts), lang.stage) for lang, exts in _by_language(table)], F.lit(""))
    views = corpus.select("path", *keep, "status", "content", spoken.alias("_lang"), outline.otherwise(none).alias("o"))
    stage = stage.otherwise("stripped")
    views = views.select("path", *keep, "status", "content", "o", stage.alias("stage"))
    text = (F.when(F.col("stage") == "unreadable", F.concat(F.lit(UNREADABLE_PREFIX), F.col("status")))
            .when(F.col("stage") == "stripped", T.strip_hash_comments("content"))
            .otherwise(_text(content, F.col("o.rows"))))
    views = views.select("path", *keep, text.alias("text"), "stage", F.col("o.balanced").alias("balanced"))
    return views.select("path", *keep, "text", F.when(F.col("stage") == "unreadable", F.lit(0).cast("bigint"))
                        .otherwise(token_count("text")).alias("tokens"), "stage", "balanced")


def function_blocks(corpus: DataFrame, requests: DataFrame, token_count=T.token_estimate, table: Mapping[str, Language] = LANGUAGES) -> DataFrame:
    """(path, name, text, tokens, found): the block in its file's language, else a message with 0 tokens."""
    ok = corpus.filter(F.col("status") == "ok").select("path", "content")
    req = requests.select("path", "name").distinct()
    blocks = None
    for lang, exts in _by_language(table):
        here = _written_in(lang, exts)
        one = (python_blocks if lang.block == "indent" else js_blocks)(ok.filter(here), req.filter(here), lang)
        blocks = one if blocks is None else blocks.unionByName(one)
    out = req.join(blocks.withColumnRenamed("text", "block").hint("merge"), ["path", "name"], "left")
    block = F.col("block")
    text = F.coalesce(block, F.format_string(NOT_EXTRACTED, F.col("name")))
    tokens = F.when(block.isNotNull(), token_count(block)).otherwise(F.lit(0)).cast("bigint")
    return out.select("path", "name", text.alias("text"), tokens.alias("tokens"), block.isNotNull().alias("found"))
