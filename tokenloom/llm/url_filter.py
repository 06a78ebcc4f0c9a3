"""Operator 6: URL filter.

A blocked Bloom filter of all listed keys passes possible hits to an exact hash join that removes
the false ones. Two kinds of entries are listed:

* rules (host, path, verdict): fit the host and its subdomains where the url's path starts with the
  rule's path; the longest fitting rule (host and path together, then the host) decides;
* canonical urls: block every page with that canonical url. Scheme, query and fragment are removed, A-Z of the host lower-cased;
  a dot at the host's end and the ports 80 and 443 go; an escape (%41) of a letter, digit or one of ``-._~`` becomes that sign, other
  escapes get upper-case digits; the segments ``.`` and ``..`` are resolved; an empty path is ``/``. Rules see host and path
  as they are, so none of this changes which rule fits.

A url is expanded into the keys under which it could be listed: every host suffix joined with every
path prefix of a length that some rule has, and its own canonical form. The work is linear in urls.

Defined results: a null url, or one without ``://``, has empty host and path, fits nothing and gets
the default verdict; repeated urls and page ids each get their row; an empty list gives every page
the default; only the named columns of the input are read, so further columns do not matter.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import bloom
from tokenloom.llm.common import lean, let, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url as the module text says."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def _unescaped(path: Column) -> Column:
    """Escapes of unreserved signs decoded, the digits of others in upper case."""
    escape = "%[0-9A-Fa-f]{2}"

    def one(e: Column) -> Column:
        sign = F.char(F.conv(F.substring(e, 2, 2), 16, 10).cast("int"))
        return F.when(sign.rlike(r"\A[A-Za-z0-9\-._~]\z"), sign).otherwise(F.translate(e, LOWER[:6], UPPER[:6]))

    found = F.transform(F.regexp_extract_all(path, F.lit(escape), 0), one)
    # one part more than escapes
    return F.array_join(F.zip_with(F.split(path, escape, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _resolved(path: Column) -> Column:
    """The path without its ``.`` and ``..`` segments; one of them at the end leaves a slash."""
    def step(acc: Column, s: Column) -> Column:
        return (F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                .otherwise(F.concat(acc, F.array(s))))

    segments = F.split(path, "/", -1)            # the first is what stands before the first slash: nothing
    kept = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array().cast("array<string>"), step)
    end = F.when(F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), end)


def canonical(host: Column, path: Column) -> Column:
    """The canonical url of a host and a path of ``url_parts``, null without a host."""
    bare = F.regexp_replace(host, r"\.?(?::(?:80|443)?)?\z", "")
    plain = F.when(F.contains(path, F.lit("%")), _unescaped(path)).otherwise(path)
    whole = let(plain, lambda p: F.when(p == "", "/").when(F.contains(p, F.lit("/.")), _resolved(p)).otherwise(p))
    return F.when(host != "", F.concat(bare, whole))


def _key(kind: str, *parts: Column) -> Column:
    return F.xxhash64(F.lit(kind), *parts)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, default: str = "allow",
          url_col: str = "url", log2_blocks: int = 14) -> DataFrame:
    """Every page with host, path, rule, verdict, listed (its canonical url is on the list).

    ``rules``: host, path, verdict. ``listed``: url (canonical, see ``canonical``).
    """
    host, path = url_parts(F.col(url_col))
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "listed")]
    pages = pages.select(*keep, host.alias("host"), path.alias("path"))
    rules = materialize(rules.select("host", "path", "verdict").where("host is not null and path is not null")
                        .groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
                        .withColumn("key", _key("rule", F.col("host"), F.col("path"))), "rules")
    listed = materialize(listed.select("url").where("url is not null").distinct()
                         .withColumn("key", _key("url", F.col("url"))), "listed")
    # distinct path lengths of rules: at most the longest path, not the number of rules
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    bits = bloom.build(rules.select("key").union(listed.select("key")), "key", log2_blocks)
    shared = pages.sparkSession.sparkContext.broadcast(bits)     # 64 bytes a block: fixed by the parameter

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_distinct(F.filter(
        F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]),
        lambda p: p.isNotNull()))
    cand = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(
        _key("rule", s, p).alias("key"), s.alias("rule_host"), p.alias("rule_path")))))
    own = F.array(F.struct(_key("url", F.col("url")).alias("key"),
                           F.lit(None).cast("string").alias("rule_host"), F.lit(None).cast("string").alias("rule_path")))
    urls = pages.select("host", "path").where("host != ''").distinct().withColumn("url", canonical(F.col("host"), F.col("path")))
    keys = (urls.select("host", "path", "url", F.explode(F.concat(cand, own)).alias("c")).select("host", "path", "url", "c.*")
            .withColumn("block", bloom.block_of("key", log2_blocks)))

    def possible(batches):
        lean()
        b = shared.value
        for batch in batches:
            hit = bloom.probe(b, batch.column("block").to_numpy(), batch.column("key").to_numpy())
            yield batch.filter(pa.array(hit))

    keys = materialize(keys.mapInArrow(possible, keys.schema), "urlhits")
    by_rule = (keys.where("rule_host is not null")
               .join(rules.select("key", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict"),
                     ["key", "rule_host", "rule_path"])
               .groupBy("host", "path")
               .agg(F.max(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"),
                                   F.length("rule_host").alias("m"),
                                   F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("best"))
               .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"),
                       F.lit(False).alias("on_list")))
    by_url = (keys.where("rule_host is null")
              .join(listed.select("key", "url"), ["key", "url"])
              .select("host", "path", F.lit(None).cast("string").alias("rule"),
                      F.lit(None).cast("string").alias("rule_verdict"), F.lit(True).alias("on_list")))
    hits = materialize(by_rule.union(by_url).groupBy("host", "path")
                       .agg(F.max("rule").alias("rule"), F.max("rule_verdict").alias("rule_verdict"),
                            F.max("on_list").alias("on_list")), "verdicts")
    return (pages.join(hits, ["host", "path"], "left")
            .select(*keep, "host", "path", "rule",
                    F.coalesce("rule_verdict", F.when(F.col("on_list"), F.lit("block")), F.lit(default)).alias("verdict"),
                    F.coalesce("on_list", F.lit(False)).alias("listed")))
