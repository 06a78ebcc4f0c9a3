import numpy as np

from tokenloom.llm import bloom, url_filter
from tokenloom.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    rest = rest[end:]
    return host, rest[:min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]


def judged(url, rules, listed):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    return host, path, None, "block" if host and host + path in listed else "allow"


URLS = [None, "", "no scheme", "http://", "http:///x", "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "http://example.com/EN/", "http://example.com/en",
        "http://com/", "http://notexample.com/en/1", "http://x.net/es/ü?q=/fr/", "http://x.net?/es/", "http://y.net#/fr/", "http://NET/fr/2", "ftp://bad.org/page",
        "http://bad.org/page?x=1", "http://bad.org/page2", "http://bad.org", "a://b://c.net/es/", "http://sub.www.example.com/en/q", "http://..net/es/",
        "http://ÄB.net/fr/", "http://x.org/" + "p/" * 5000, "http://bad.org/page"]
LISTED = ["bad.org/page", "x.org/" + "p/" * 5000, "unused.org/", None]


def run(spark, rules, listed, urls=URLS, blocks=4):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    li = spark.createDataFrame([(x,) for x in listed], "url string")
    out = url_filter.judge(pages, r, li, log2_blocks=blocks).collect()
    return {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in out}


def test_equals_plain_python(spark):
    got = run(spark, URL_RULES, LISTED)
    assert got == {i: judged(u, URL_RULES, set(LISTED)) for i, u in enumerate(URLS)}


def test_rules_without_a_trailing_slash_and_many_of_them(spark):
    rules = [("net", "/e", "block"), ("x.net", "/es", "allow"), ("net", "", "allow")] + [(f"h{i}.org", f"/p{i}", "block") for i in range(300)]
    urls = URLS + [f"http://a.h{i}.org/p{i}x" for i in range(300)]
    assert run(spark, rules, [], urls, blocks=1) == {i: judged(u, rules, set()) for i, u in enumerate(urls)}    # a full filter is still exact


def test_no_rules_no_list_no_pages(spark):
    assert {v[3] for v in run(spark, [], []).values()} == {"allow"}
    assert run(spark, URL_RULES, LISTED, urls=[(None)][:0] or []) == {}


def test_filters_have_no_false_negatives(spark):
    keys = np.random.default_rng(1).integers(-2**62, 2**62, 5000)
    df = spark.createDataFrame([(int(k),) for k in keys], "key long")
    rows = df.withColumn("block", bloom.block_of("key", 6)).toPandas()
    assert bloom.probe(bloom.build(df, "key", 6), rows["block"].to_numpy(), rows["key"].to_numpy()).all()
    may = bloom.native(df, "key", 18)
    from pyspark.sql import functions as F
    assert df.where(may(F.col("key"))).count() == 5000
    others = spark.range(100_000).select((F.col("id") * 7 + 1).alias("key"))
    assert others.where(may(F.col("key"))).count() < 5_000


def plain_canonical(host, path):
    """Canonical url by a plain loop over signs and segments."""
    for port in (":443", ":80", ":"):
        if host.endswith(port):
            host = host[:-len(port)]
            break
    host = host[:-1] if host.endswith(".") else host
    out, i = "", 0
    while i < len(path):
        two = path[i + 1:i + 3]
        if path[i] == "%" and len(two) == 2 and all(c in "0123456789abcdefABCDEF" for c in two):
            c = chr(int(two, 16))
            out += c if c.isascii() and (c.isalnum() or c in "-._~") else "%" + two.upper()
            i += 3
        else:
            out += path[i]
            i += 1
    segments, kept = out.split("/")[1:], []
    for s in segments:
        if s == "..":
            kept = kept[:-1]
        elif s != ".":
            kept.append(s)
    return host + "/" + "/".join(kept) + ("/" if kept and segments[-1] in (".", "..") else "")


def test_canonical_urls_equal_plain_python(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    hosts = ["bad.org", "bad.org.", "bad.org:80", "bad.org:443", "bad.org:8080", "bad.org.:80", "bad.org:"]
    bits = ["/", "/", "a", ".", "..", "%2e", "%41", "%2f", "%c3%bc", "%", "%4", "%zz", "ü", "~", "/./", "/../", "b"]
    urls = [f"https://{rng.choice(hosts)}{p and '/'}{p}" for p in ("".join(rng.choice(bits) for _ in range(rng.randrange(7))) for _ in range(400))]
    host, path = url_filter.url_parts(F.col("url"))
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for r in df.select("url", url_filter.canonical(host, path).alias("c")).collect():
        assert r["c"] == plain_canonical(*parts(r["url"])), r["url"]
    spellings = ["http://BAD.org:80/a/b", "https://bad.org./a/./b#x", "http://bad.org/a/c/../b?q", "http://bad.org/%61/b", "http://bad.org/a/%2E%2e/a/b"]
    others = ["http://bad.org:8080/a/b", "http://bad.org/a/b/", "http://bad.org/a%2Fb", "http://bad.org/A/b"]
    got = run(spark, [], ["bad.org/a/b"], spellings + others)
    assert [got[i][3] for i in range(9)] == ["block"] * 5 + ["allow"] * 4
