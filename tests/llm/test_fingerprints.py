import hashlib

from small import corpus, frame, tables
from tokenloom.llm import fingerprints as FP
from tokenloom.llm import queries
from pyspark.sql import functions as F


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_plain_python(spark, tmp_path):
    rows = [r for r in corpus(5) if r[0] is not None]
    seen, unique = set(), []
    for k, t in rows:                                     # one row an id, so that the order is total
        if k not in seen:
            seen.add(k)
            unique.append((k, t))
    sf = tables(spark, tmp_path, documents=frame(spark, unique))
    got = {r["doc_id"]: r for r in queries.op2_fingerprints(spark, sf).collect()}
    order = sorted(unique, key=lambda r: -r[0])
    assert len(got) == len(order)
    errors = []
    for (k, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        cut = len(t) // 3
        edited = t[:len(t) - cut] + nxt[:cut]
        r = got[k]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"] == "") == (not shingles(t))
        for col, other in (("near_edited", edited), ("near_next", nxt)):
            assert 0 <= r[col] <= 1
            errors.append(abs(r[col] - jaccard(shingles(t), shingles(other))))
    assert sum(errors) / len(errors) < 0.03
    by_text = {}
    for k, t in order:
        by_text.setdefault(t or "", set()).add(got[k]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_likeness_follows_jaccard(spark):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k, share in enumerate((1.0, 0.9, 0.8, 0.5, 0.2, 0.0)):
        n = int(400 * share)
        rows.append((k, " ".join(words), " ".join(words[:n] + [f"x{k}_{i}" for i in range(400 - n)])))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    got = df.select("k", FP.likeness(FP.fingerprint(F.col("a")), FP.fingerprint(F.col("b"))).alias("j"), "a", "b").collect()
    for r in got:
        assert abs(r["j"] - jaccard(shingles(r["a"]), shingles(r["b"]))) < 0.12


def test_nulls_ties_and_repeated_rows(spark, tmp_path):
    rows = corpus(6)
    sf = tables(spark, tmp_path, documents=frame(spark, rows))
    got = queries.op2_fingerprints(spark, sf)
    assert got.count() == len(rows)
    assert got.where("near_edited is null or near_next is null or fingerprint is null").count() == 0


def test_one_row_and_empty_table(spark, tmp_path):
    sf = tables(spark, tmp_path, documents=frame(spark, [(5, "a b c d e f g h i j")]))
    r = queries.op2_fingerprints(spark, sf).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1.0
    none = tables(spark, tmp_path / "none", documents=frame(spark, rows := corpus()).limit(0))
    assert rows and queries.op2_fingerprints(spark, none).count() == 0


def test_ranges_of_any_size_give_the_same_neighbours(spark):
    rows = [(k * k % 997, f"t{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for per_range in (3, 50, 1000):
        got = {r["text"]: r["next"]["text"] for r in FP.with_next(df, ["text"], {}, per_range=per_range).collect()}
        ids = {}
        for k, t in rows:
            ids.setdefault(k, []).append(t)
        order = sorted(ids, reverse=True)
        assert len(got) == len(rows)
        for a, b in zip(order, order[1:] + order[:1], strict=True):
            assert any(got[t] in ids[b] for t in ids[a])
