"""Project roots (nearest-ancestor join) and layered configuration merge."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tokenloom.functions import paths as P
from tokenloom.functions import text as T

# ---------------------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------------------
DEFAULT_CONFIG = {
    "daily_limit": "200000",
    "exclude_patterns": '["node_modules",".git","__pycache__","venv",".env"]',
}
PROJECT_MARKER = "project"      # preferred marker kind
GIT_MARKER = "git"              # fallback marker kind
GLOBAL_PROJECT = "global"       # index / config scope of paths with no root
# ---------------------------------------------------------------------------------------


def project_roots(files: DataFrame, markers: DataFrame) -> DataFrame:
    """``(path, root, project)`` for every file path.

    The root is the nearest ancestor directory holding a project marker; only when no
    ancestor has one, the nearest holding a git marker; else NULL (project ``global``).
    Distinct directories are expanded to their ancestors (bounded by depth) and equi-joined
    with the marker table; the choice is a combinable ``max_by`` per directory.
    """
    dirs = files.select(P.parent("path").alias("dir")).distinct()
    anc = dirs.select("dir", F.explode(P.ancestors("dir")).alias("anc"))
    mk = markers.select(F.col("dir").alias("anc"), "kind").distinct()
    hit = anc.join(mk, "anc")
    score = F.struct((F.col("kind") == PROJECT_MARKER).alias("is_project"), F.length("anc").alias("len"))
    best = hit.groupBy("dir").agg(F.max_by("anc", score).alias("root"))
    out = files.select("path", P.parent("path").alias("dir")).join(best, "dir", "left")
    return out.select("path", "root", F.coalesce("root", F.lit(GLOBAL_PROJECT)).alias("project"))


class _Number(str):
    """A number as it is written."""


def _text(v) -> str:
    if isinstance(v, _Number):
        return str(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_text(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(_text(x) for x in v) + "]"
    return json.dumps(v, ensure_ascii=False)


def parse_layer(text: str | None) -> dict[str, str | None] | None:
    """A JSON object as key -> value text (strings as they are, all else as JSON). Of a repeated key the
    last one counts; anything but one object, text after it included, gives None (the layer is skipped)."""
    try:
        d = json.loads(text, parse_int=_Number, parse_float=_Number)
    except (TypeError, ValueError, RecursionError):
        return None
    if not isinstance(d, dict):
        return None
    return {k: None if v is None else str(v) if isinstance(v, str) else _text(v) for k, v in d.items()}


@F.pandas_udf(TY.MapType(TY.StringType(), TY.StringType()))
def _json_map(texts: pd.Series) -> pd.Series:
    return texts.map(parse_layer, na_action="ignore")


_SPACE = " \t\n\r"
_PLAIN = r'"[^"\\\x00-\x1f]*+"'
_PAIR = rf'({_PLAIN})[ \t\n\r]*+:[ \t\n\r]*+({_PLAIN}|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null)'
_MARK = "\u0002"         # in no valid JSON text


def _flat_map(text: Column) -> Column:
    """The same map for an object of plain strings, numbers and constants without escapes or repeated keys, by functions
    alone; null for any other text. What is left when its pairs are cut out must be the braces and commas around them."""
    def of(keys: Column) -> Column:
        values = F.transform(F.regexp_extract_all(text, F.lit(_PAIR), 2), lambda v: F.when(v.startswith('"'), F.substring(v, F.lit(2), F.length(v) - 2))
                             .when(v != "null", v))
        rest = F.translate(F.regexp_replace(text, _PAIR, _MARK), _SPACE, "")
        frame = F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda _: F.lit(_MARK)), ","), F.lit("}"))
        fits = (rest == frame) & ~F.contains(text, F.lit(_MARK)) & (F.size(F.array_distinct(keys)) == F.size(keys))
        return F.when(fits, F.map_from_arrays(F.transform(keys, lambda k: F.substring(k, F.lit(2), F.length(k) - 2)), values))
    return T.let(F.regexp_extract_all(text, F.lit(_PAIR), 1), of)


def _without_keys(m: Column, upper: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~F.array_contains(F.map_keys(upper), k))


def _literal(layer: dict[str, str | None]) -> Column:
    if not layer:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for k, v in layer.items() for x in (F.lit(k), F.lit(v).cast("string"))])


def merge_layers(project_layers: DataFrame, global_json: str | None = None,
                 defaults: dict[str, str] | None = None) -> DataFrame:
    """``(project, key, value, layer)``: defaults < global < project, whole-key replacement.

    One row per project holds that project's layer text; the default and global layers are
    small literal maps. Flat objects are cut into pairs by functions; only other texts are parsed in Arrow batches, and the
    global layer is parsed once. Lower layers lose every key an upper layer defines (no deep merge),
    so the merge is a per-row map operation — no shuffle. ``bad_layer`` marks a project whose
    text did not parse (it is then ignored, as the reference ignores malformed files).
    """
    defaults = DEFAULT_CONFIG if defaults is None else defaults
    d, g = _literal(defaults), _literal(parse_layer(global_json) or {})
    project_layers = project_layers.select("project", "json", _flat_map(F.col("json")).alias("_f"))
    project_layers = project_layers.select("project", "json", F.coalesce("_f", _json_map(F.when(F.col("_f").isNull(), F.col("json")))).alias("_p"))
    parsed = F.col("_p")
    pj = F.coalesce(parsed, F.create_map().cast("map<string,string>"))
    upper_g = F.map_concat(_without_keys(g, pj), pj)
    layered = F.map_concat(
        F.transform_values(_without_keys(d, upper_g), lambda k, v: F.struct(F.lit(0).alias("layer"), v.alias("value"))),
        F.transform_values(_without_keys(g, pj), lambda k, v: F.struct(F.lit(1).alias("layer"), v.alias("value"))),
        F.transform_values(pj, lambda k, v: F.struct(F.lit(2).alias("layer"), v.alias("value"))),
    )
    rows = project_layers.select("project", (parsed.isNull() & F.col("json").isNotNull()).alias("bad_layer"),
                                 F.explode(layered).alias("key", "lv"))
    return rows.select("project", "key", F.col("lv.value").alias("value"), F.col("lv.layer").alias("layer"),
                       "bad_layer")
