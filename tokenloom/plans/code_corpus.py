"""A synthetic code corpus derived from ``part``: one Python and one JS/TS file per part.

The texts follow fixed templates whose slots are filled from the part's columns, so the
expected outlines and blocks have closed forms (written in SQL by ``plans/oracle.py``). The
same template renders to a Spark ``concat`` (here) and to a SQL ``||`` chain (oracle), so
both sides read identical inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.sources.tables import read_table

PY_TEMPLATE = '''"""Part {K}: {NAME}.

def fake_{K}(): not code, this is a docstring
"""
import math

RATE_{K} = {S}


def make_{K}(size={S}):
    return Part{K}(size)


class Part{K}(object):
    """A {TYPE} part; class Fake: inside a docstring."""

    def __init__(self, size):
        self.size = size  # def not_a_def(): a comment
        self.tags = {"kind": "{TYPE}",
                     "id": {K}}

{DEC}    def price(self,
              qty=1):
{NEST}        return qty * {CENTS}

    async def fetch(self): return {K}


if RATE_{K} > 10:
    def big_{K}():
        return True
'''

JS_TEMPLATE = '''// Part {K}: {NAME} -- function fake() { not code
import { base } from './base';

/* block comment
   function fake{K}() { */
export function price{K}(qty) {
  const inner = (x) => x * 2;
  return qty * {CENTS};
}

class Part{K} extends Base {
  constructor(size) {
    super();
    this.size = size;
  }

  async load(id) {
    const url = `/parts/${id}?q={`;
    return fetch(url);
  }

  get label() { return "{NAME}"; }
}

export const make{K} = (size) => new Part{K}(size);
const config{K} = { size: {S}, name: '{NAME}' };
items.forEach((item) => {
  console.log(item);
});
function* gen{K}() { yield 1; }
export const Card{K} = ({
  size,
}) => {
  return [size].map((x) => x + {S});
};
abstract class Shape{K} { area(): number { return {S}; } }
class Box{K}<T> {
  put(
    item: T,
    times = limit({S}),
  ): void { this.items.push(item); }
  id<U>(x: U): U { return x; }
}
const one{K} = () => 1; const two{K} = (a = (2)) => a;
type Fn{K} = (x: number) => void;
'''

DEC_PROPERTY = "    @property\n"
DEC_CACHE = "    @cache(\n        maxsize={S})\n"
NEST = "        def helper(x):\n            return x\n"
SLOTS = ("K", "S", "NAME", "TYPE", "CENTS", "DEC", "NEST")


def tokens_of(template: str) -> list[tuple[str, str]]:
    """Split a template into ('lit', text) and ('slot', name) pieces (only known slots)."""
    out, pos = [], 0
    for m in re.finditer(r"\{(" + "|".join(SLOTS) + r")\}", template):
        if m.start() > pos:
            out.append(("lit", template[pos:m.start()]))
        out.append(("slot", m.group(1)))
        pos = m.end()
    if pos < len(template):
        out.append(("lit", template[pos:]))
    return out


def _spark_slots() -> dict:
    k = F.col("p_partkey")
    s = F.col("p_size").cast("string")
    dec_cache = F.concat(*[F.lit(t) if kind == "lit" else s for kind, t in tokens_of(DEC_CACHE)])
    return {
        "K": k.cast("string"),
        "S": s,
        "NAME": F.regexp_replace("p_name", " ", "_"),
        "TYPE": F.lower("p_type"),
        "CENTS": F.round(F.col("p_retailprice") * 100).cast("bigint").cast("string"),
        "DEC": F.when(F.pmod(k, F.lit(3)) == 0, F.lit(DEC_PROPERTY))
                .when(F.pmod(k, F.lit(3)) == 1, dec_cache).otherwise(F.lit("")),
        "NEST": F.when(F.pmod(k, F.lit(4)) == 0, F.lit(NEST)).otherwise(F.lit("")),
    }


def render_spark(template: str):
    slots = _spark_slots()
    return F.concat(*[F.lit(t) if kind == "lit" else slots[t] for kind, t in tokens_of(template)])


def brand_dir():
    return F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part_key, path, content, status) — two files per part."""
    from tokenloom.session import spread

    part = spread(read_table(spark, sf_dir, "part"), "p_partkey", heavy=True)
    k = F.col("p_partkey")
    py = part.select(k.alias("part_key"),
                     F.concat(F.lit("code/"), brand_dir(), F.lit("/part_"), k.cast("string"), F.lit(".py")).alias("path"),
                     render_spark(PY_TEMPLATE).alias("content"))
    js = part.select(k.alias("part_key"),
                     F.concat(F.lit("web/"), brand_dir(), F.lit("/part"), k.cast("string"),
                              F.when(F.pmod(k, F.lit(2)) == 1, F.lit(".ts")).otherwise(F.lit(".js"))).alias("path"),
                     render_spark(JS_TEMPLATE).alias("content"))
    return py.unionByName(js).withColumn("status", F.lit("ok"))


def block_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, name) requests: a method, a nested helper and a function per part file."""
    files = code_files(spark, sf_dir)
    k = F.col("part_key").cast("string")
    names = F.when(F.col("path").endswith(".py"),
                   F.array(F.lit("price"), F.lit("helper"), F.concat(F.lit("Part"), k))) \
             .otherwise(F.array(F.lit("load"), F.concat(F.lit("price"), k), F.lit("missing"), F.lit("put"),
                           F.concat(F.lit("Card"), k), F.concat(F.lit("two"), k)))
    return files.select("path", F.explode(names).alias("name"))
