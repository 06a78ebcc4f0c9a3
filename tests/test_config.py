"""Layered configuration: last of repeated keys, text after the object, the global layer."""

from tokenloom.operators import config as CF


def test_layers(spark):
    rows = [("a", '{"daily_limit": 5, "daily_limit": 7, "custom_key": "v"}'), ("b", '{"x": 1} trailing'), ("c", None), ("d", "[1, 2]"),
            ("e", '{"exclude_patterns": ["q", {"n": 1.50, "t": true}], "f": 2.0, "z": null, "u": "\\u00e9"}')]
    df = spark.createDataFrame(rows, "project string, json string")
    got = {}
    for r in CF.merge_layers(df, global_json='{"daily_limit": 9, "theme": "dark"}').collect():
        got.setdefault(r.project, {})[r.key] = (r.value, r.layer, r.bad_layer)
    assert got["a"]["daily_limit"] == ("7", 2, False) and got["a"]["custom_key"] == ("v", 2, False) and got["a"]["theme"] == ("dark", 1, False)
    assert got["b"]["daily_limit"] == ("9", 1, True) and "x" not in got["b"] and got["d"]["theme"] == ("dark", 1, True)
    assert got["c"]["exclude_patterns"][1:] == (0, False)
    assert got["e"]["exclude_patterns"] == ('["q",{"n":1.50,"t":true}]', 2, False) and got["e"]["f"][0] == "2.0"
    assert got["e"]["z"][0] is None and got["e"]["u"][0] == "é"


def test_flat_objects_equal_the_parser(spark):
    """Cut into pairs or left to the parser: never another answer, and no plain object is left to it."""
    import random

    from pyspark.sql import functions as F

    plain = ["{}", " { } ", '{"a":1}', '{ "a" : "x, y: {z}" ,\n"b":-0.50e+3, "":null }\t', '{"é":"ü\u007f","t":true,"f":false}', '{"a":""}']
    other = ['{"a":1,"a":2}', '{"a":"\\u00e9"}', '{"a":[1]}', '{"a":{}}', '{"a":01}', '{"a":1,}', '{,"a":1}', '{"a":1 "b":2}', '{"a":1}}', '[]', "",
             '{"a":NaN}', '{"a":1.}', '{"a" "b"}', '{"a":"b":"c"}', '{\u0002}', '{"a":"\u0002"}', '{"a":"x\ny"}', '{"a":1}{"b":2}', '"a":1', '{"a":tru}',
             '﻿{"a":1}', '{"a":1 }', '{"a\\"":1}', "null", None]
    rng, signs = random.Random(4), ['"a"', '"b"', ":", ":", ",", "{", "}", "1", "null", " ", '"', "-", "0.5", "\\"]
    mixed = ["{" + "".join(rng.choice(signs) for _ in range(rng.randrange(9))) + "}" for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in plain + other + mixed], "t string")
    rows = df.select("t", CF._flat_map(F.col("t")).alias("f"), F.coalesce(CF._flat_map(F.col("t")), CF._json_map(F.col("t"))).alias("m")).collect()
    for r in rows:
        assert r.m == CF.parse_layer(r.t), r
    assert all(r.f is not None for r in rows if r.t in plain) and all(r.f is None for r in rows if r.t in other)
