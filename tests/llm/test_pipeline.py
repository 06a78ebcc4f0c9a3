import random

import duckdb

import corpus_pipeline as P
from conftest import SF001, SF01
from small import corpus, frame, tables
from test_decontaminate import brute as hits
from test_jaccard_join import brute as links
from test_jaccard_join import near_group
from test_line_dedup import kept as deduped


def test_stages_against_plain_python(spark, tmp_path):
    rng = random.Random(2)
    rows = [r for r in corpus(17) if r[0] not in (None, 1010) and (r[1] or "").split()]
    rows += [(9000 + i, t) for i, t in enumerate(near_group(3, 6, 120, 2))]
    item = " ".join(rows[2][1].split()[:25])
    rows += [(9100, " ".join(f"q{rng.randint(0, 999)}" for _ in range(60)) + "\n" + item + "\nthe end of it")]
    sf = tables(spark, tmp_path, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    docs = frame(spark, rows)
    columns = docs.columns

    kept = P.line_dedup_stage(spark, docs, sf)
    want = {k: t for (k, _), t in deduped(rows, 3, 50).items() if t.strip()}
    assert kept.columns == columns and {r["doc_id"]: r["text"] for r in kept.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())

    rest = sorted(want.items())
    near = P.near_duplicates(spark, kept, sf)
    groups = {}
    for k, _, cls, _ in links(rest):
        groups.setdefault(cls, []).append(k)
    assert near.columns == columns and sorted(r["doc_id"] for r in near.collect()) == sorted(min(v) for v in groups.values())

    rest = [(k, t) for k, t in rest if k in {min(v) for v in groups.values()}]
    clean = P.benchmark_decontamination(spark, near, sf)
    want = {k: t for k, _, _, _, t in hits(rest, [(1, item)], 10) if t.strip()}
    assert clean.columns == columns and {r["doc_id"]: r["text"] for r in clean.collect()} == want
    assert sum(t != dict(rest)[k] for k, t in want.items()) >= 1


def test_quality_stage_keeps_good_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    kept = {r["doc_id"] for r in P.quality_classifier(spark, docs, SF01).select("doc_id").collect()}
    lab = duckdb.sql(f"select doc_id, quality from '{SF01}/labels.parquet' join '{SF01}/documents.parquet' using (doc_id)").fetchall()
    assert sum((k in kept) == (q == 1) for k, q in lab) / len(lab) > 0.98


def test_whole_pipeline(spark):
    out = P.run(spark, SF001).collect()
    ids = [r["doc_id"] for r in out]
    assert 0 < len(ids) <= 200 and len(set(ids)) == len(ids) and all(r["rate"] >= 0 for r in out)
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination",
                                        "mixing sources to target weights"]


def test_line_dedup_stage_takes_the_end_of_a_repeated_run(spark, tmp_path):
    passage = "\n".join(" ".join([f"{c}{i}" for i in range(n)]) for c, n in (("a", 60), ("b", 10), ("c", 10)))
    rows = [(1, passage), (2, f"before\n{passage}\nafter"), (3, passage)]
    kept = P.line_dedup_stage(spark, frame(spark, rows), str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {1: passage, 2: "before\nafter"}


def test_documents_of_which_only_white_space_is_left_go(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(25))
    copy = "\n".join(" ".join([f"{c}{i}" for i in range(20)]) for c in "abc") + "\n\n\n"
    rows = [(1, copy), (2, copy), (3, f"\n\n{item}\n\t\n"), (4, " \n\n")]
    sf = tables(spark, tmp_path, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    docs = frame(spark, rows)
    assert sorted(r["doc_id"] for r in P.line_dedup_stage(spark, docs, sf).collect()) == [1, 3, 4]      # 4 was not changed
    assert sorted(r["doc_id"] for r in P.benchmark_decontamination(spark, docs, sf).collect()) == [1, 2, 4]
