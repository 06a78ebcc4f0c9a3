"""Operator 11 against an exhaustive automaton in plain Python, over damaged tables and hot conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from small import tables
from tokenloom.llm import conversation_repair as cr
from tokenloom.llm import queries

BLANKS = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")
ALLOWED = {"": "su", "s": "u", "u": "a", "a": "u"}            # last initial of a repaired beginning -> next ones


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(BLANKS)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by relaxing every edit of every row; states are the last initial."""
    best = {"": (0, "", ())}

    def offer(to, last, value):
        if last not in to or value < to[last]:
            to[last] = value

    def inserts(states):
        for _ in range(4):
            for last, (c, a, out) in list(states.items()):
                for role in ("user", "assistant"):
                    if role[0] in ALLOWED[last]:
                        offer(states, role[0], (c + 3, a + "I", (*out, (role, ""))))
        return states

    best = inserts(best)
    for (_, role, text), fault in zip(rows, faults_of(rows), strict=True):
        new = {}
        for last, (c, a, out) in best.items():
            offer(new, last, (c + 4, a + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault == "truncated" else 0
            for name, price, edit in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                if name[:1] and name[0] in ALLOWED[last]:
                    offer(new, name[0], (c + price + extra, a + edit, (*out, (name, text))))
        best = inserts(new)
    return min(best[x] for x in ("", "a") if x in best)


def expected(rows):
    """rows: (turn, role, text) in order -> the result columns and the digest."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    faults, turns = faults_of(rows), [t for t, _, _ in rows if t is not None]
    cost, audit, out = cheapest(rows)
    assert GRAMMAR.fullmatch("".join(r[0] for r, _ in out))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def grouped(rows, damage):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def made_up(seed, n=120):
    rng = random.Random(seed)
    says = ["Yes.", "No", "Why?", "  ", "", "Go on.  \n", "a ", "Über!", None]
    rows = []
    for conv in range(n):
        turns = rng.sample([None, *range(12)], rng.randint(1, 9))
        rows += [(conv if conv else None, t, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, " ", "u"]),
                  rng.choice(says) if rng.random() < 0.5 else f"{rng.random()}.") for t in turns]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force(spark, tmp_path, seed):
    rows = made_up(seed)
    given = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "conv_id long, turn long, role string, text string, k double, audit string")
    sf = tables(spark, tmp_path, conversations=given.repartition(5))
    got = {r["conv_id"]: tuple(r[c] for c in [*cr.RESULT, "repaired_sha256"]) for r in queries.op11_conversation_repair(spark, sf).collect()}
    assert got == {c: expected(in_order(r)) for c, r in grouped(rows, True).items()}


def test_hot_conversations_over_many_partitions(spark):
    """Two conversations hold nearly all rows; each lies in several sorted partitions and in several blocks."""
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Same.", f"Turn {t}.", f"turn {t}", " "]))
            for c in (None, 7) for t in range(900)]
    rows += [(8, 1, "user", "A."), (8, 2, "assistant", "B.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = cr.repair(df).collect()
        sha = {r["conv_id"]: r["sha256"] for r in cr.digest(cr.apply(df, cr.repair(df))).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {c: expected(in_order(r)) for c, r in grouped(rows, False).items()}
    assert {r["conv_id"]: tuple(r[c] for c in cr.RESULT) for r in found} == {c: v[:-1] for c, v in want.items()}
    assert sha == {c: v[-1] for c, v in want.items()}


def test_repeated_rows_and_ties(spark):
    rows = [(1, 0, "user", "A.")] * 5 + [(1, 1, "assistant", "B.")] * 3 + [(2, 5, "assistant", "x."), (2, 5, "user", "y.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in cr.repair(df).collect()}
    assert (got[1]["duplicate"], got[1]["cost"], got[1]["audit"], got[1]["illegal"]) == (6, 24, "KDDDDKDD", 6)
    assert (got[2]["gaps"], got[2]["cost"], got[2]["audit"]) == (0, 6, "IKKI")       # assistant before user
    turns = [(r["position"], r["role"], r["text"], r["edit"]) for r in cr.apply(df, cr.repair(df)).where("conv_id = 2").orderBy("position").collect()]
    assert turns == [(1, "user", "", "I"), (2, "assistant", "x.", "K"), (3, "user", "y.", "K"), (4, "assistant", "", "I")]


def test_empty_table_and_listed_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair(df).count() == 0
    listed = spark.createDataFrame([(1,), (1,), (None,)], "conv_id long")
    assert sorted((tuple(r) for r in cr.repair(df, listed).collect()), key=str) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]


def test_blocks_give_what_single_rows_give():
    rng = random.Random(9)
    for _ in range(60):
        steps = [cr.edits_of(rng.choice("suat "), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 14))]
        cut = rng.randint(0, len(steps))
        parts = [cr.as_step(p) for p in (steps[:cut], steps[cut:]) if p]
        assert cr.derive(parts, 0, whole=True) == cr.derive(steps, 0, whole=True)
