"""Small tables with the awkward cases every operator has to handle."""

import random

EXTRA = "score double, kept string, th long, key binary, `n_words` int, items string, bytes string, body string, c long"


def corpus(seed: int = 3, n: int = 40) -> list[tuple]:
    """(doc_id, text): null and empty texts, null and repeated ids, repeated rows, copies, one very long text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(1, 7)))
    line = lambda k: " ".join(word() for _ in range(k))
    shared = [line(60), line(30) + "\n" + line(12) + "\n" + line(9)]
    rows: list[tuple] = []
    for i in range(n):
        parts = [line(rng.randint(3, 40)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), shared[i % 2])
        rows.append((i * 7, "\n".join(parts)))
    copy = rows[4][1]
    near = rows[9][1].split(" ")
    near[len(near) // 2] = "zzz"
    rows += [(1001, copy), (1002, copy), (1003, " ".join(near)), (1004, None), (1005, ""), (1006, " \n\n "), (None, copy),
             (None, None), (1007, "one two"), (1008, "one two"), (1009, "ab ab ab ab ab ab " * 60), (1010, copy), (1010, copy), (1011, "x"),
             (1010, "another text under the same id " + line(30)), (1012, "\n".join(line(20) for _ in range(400)))]
    return rows


def frame(spark, rows: list[tuple]):
    """The rows as documents with further columns whose names operators use themselves."""
    names = [c.split()[0].strip("`") for c in EXTRA.split(", ")]
    return spark.createDataFrame([(*r, "en", "src0", len(r[1] or ""), *[None] * len(names)) for r in rows],
                                 f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


def tables(spark, tmp_path, **frames) -> str:
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
