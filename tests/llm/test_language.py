import duckdb

from conftest import SF01
from small import corpus, frame
from tokenloom.llm import language, queries


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries.op5_language_id(spark, SF01).collect()}
    lang = dict(duckdb.sql(f"select doc_id, lang from '{SF01}/documents.parquet'").fetchall())
    held = [k for k in got if got[k]["held_out"]]
    assert len(got) == len(lang) and len(held) > 150
    assert sum(got[k]["lang_pred"] == lang[k] for k in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_vectors_are_bound_as_stated():
    import numpy as np
    letters = language._letter_vectors()
    table = language._slot_table()
    code = language._grams("abc", table)
    inner = code[1:2]                                     # " ab", "abc", "bc "
    a, b, c = (letters[language._slots(x, table)[0]] for x in "abc")
    assert len(code) == 3
    assert np.array_equal(language._gram_vectors(inner, letters)[0], np.roll(a, 2) * np.roll(b, 1) * c)


def test_awkward_texts(spark):
    train = spark.createDataFrame([("the cat sat on the mat", "en"), ("der hund und die katze", "de"), ("nothing", None), (None, "fr"), ("", "es")],
                                  "text string, lang string")
    model = language.fit(train)
    assert sorted(model) == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the mat"), (5, "und die"), (6, "the mat " * 50_000), (7, "𐍈𐌰"), (4, "the mat")]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(frame(spark, rows), model).orderBy("doc_id").collect()]
    assert [g[1] for g in got] == ["und"] * 3 + ["en", "en", "de", "en"] + [got[-1][1]]
    assert all(s == 0.0 for _, lang, s in got if lang == "und") and got[-1][1] in ("de", "en")


def test_nothing_learned_and_empty_table(spark):
    empty = frame(spark, corpus()).limit(0)
    model = language.fit(empty)
    assert model == {} and {r["lang_pred"] for r in language.predict(frame(spark, corpus()), model).collect()} == {"und"}
    assert language.predict(empty, language.fit(frame(spark, corpus()))).count() == 0
