"""Operator 11: conversation structure repair by Knuth's lightest-derivation agenda.

A conversation's rows, in order of turn, are to become an optional system turn followed by pairs of user and assistant
turns, or nothing. Edits: Keep, Rerole (to user or assistant), Delete, Insert (an empty user or assistant turn). The repair
is the lightest derivation in a weighted hypergraph:

* an edit item (j, p, q) takes row j and moves the automaton of the grammar from state p to q; edits are axioms,
* a prefix item (j, q) says that the first j rows are repaired and the automaton is in q. It follows from prefix
  (j - 1, p) and edit (j - 1, p, q), or by an insert from prefix (j, p),
* the goal follows from a prefix of all rows in a final state.

Values are (cost, rows taken, audit), and audits are joined. Items leave the agenda in ascending order and are then final:
each deduction is monotone (two equally dear audits of the same rows are never one the beginning of the other) and
superior (a result takes more rows, or costs more, than what it follows from), so Knuth's argument holds and the goal's
first value is the cheapest one with the least audit.

Scale: edits need a few bytes a row, so the texts stay out of the search. Equal rows of one turn are counted before the
shuffle, repeated texts are found by an aggregate, and the rows are range-partitioned and sorted by (conversation, turn), so
that a conversation with a third of all rows lies in many partitions. A task derives runs of rows in blocks
into edit items of whole blocks (the same agenda from every state), and only the first and last conversation of a
partition, which may go on in others, are joined afterwards, again by the agenda over their pieces. Repaired rows then come
from one pass over rows sorted behind their audit, in bounded memory.

Defined results: null roles and texts are one space; rows without a turn come first; equal turns are ordered by role, then by
a digest of role and text; equal rows are duplicates from the second on; a conversation of the list without
rows has zeros and an empty audit; a null id is a conversation; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tokenloom.llm.common import lean, materialize

BLOCK = 64
BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; 0 and 3 are final.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
WANTED = {0: "user", 1: "user", 2: "assistant", 3: "user"}       # the role that an edit gives in each state
LEGAL = {"su", "ua", "au"}

Value = tuple[int, int, str]                 # cost, rows taken, audit
Edits = dict[tuple[int, int], Value]         # (state before, state after) -> value


# ---- the agenda -----------------------------------------------------------------------------------------

def edits_of(initial: str, fault: bool, truncated: bool, n: int = 1) -> Edits:
    """Edit items of a row, or of n rows that all have to go."""
    out: Edits = {(p, p): (DELETE * n, n, "D" * n) for p in range(4)}
    if not fault:
        extra = TRUNCATED if truncated else 0
        for p in range(4):
            out[p, NEXT[p, WANTED[p][0]]] = (REROLE + extra, 1, "R")
            if (p, initial) in NEXT:
                out[p, NEXT[p, initial]] = (extra, 1, "K")
    return out


def derive(steps: list[Edits], entry: int, whole: bool = False) -> dict[int, Value] | Value:
    """Lightest values of the prefixes that take all steps, by final state; with ``whole``, that of the goal."""
    agenda: list[tuple[Value, int, int, int]] = [((0, 0, ""), 0, -1, entry)]     # value, step, state before (-1: a prefix), state
    agenda += [(v, j, p, q) for j, step in enumerate(steps) for (p, q), v in step.items()]
    heapq.heapify(agenda)
    prefixes: dict[tuple[int, int], Value] = {}
    edits: dict[tuple[int, int], list[tuple[int, Value]]] = {}
    out: dict[int, Value] = {}
    while agenda:
        value, j, before, state = heapq.heappop(agenda)
        if before >= 0:                                          # an edit is final: combine with the prefix in front of it
            edits.setdefault((j, before), []).append((state, value))
            if (j, before) in prefixes:
                a = prefixes[j, before]
                heapq.heappush(agenda, ((a[0] + value[0], a[1] + value[1], a[2] + value[2]), j + 1, -1, state))
            continue
        if (j, state) in prefixes:
            continue
        prefixes[j, state] = value
        if j == len(steps):
            out[state] = value
            if whole and state in FINAL:                         # the goal is final
                return value
        heapq.heappush(agenda, ((value[0] + INSERT, value[1], value[2] + "I"), j, -1, NEXT[state, WANTED[state][0]]))
        for q, e in edits.get((j, state), ()):
            heapq.heappush(agenda, ((value[0] + e[0], value[1] + e[1], value[2] + e[2]), j + 1, -1, q))
    return out


def as_step(steps: list[Edits]) -> Edits:
    """Several steps as one."""
    return {(p, q): v for p in range(4) for q, v in derive(steps, p).items()}


def folded(steps: list[Edits]) -> list[Edits]:
    """At most BLOCK steps that stand for all of them."""
    while len(steps) > BLOCK:
        steps = [as_step(steps[i:i + BLOCK]) for i in range(0, len(steps), BLOCK)]
    return steps


class Piece:
    """Consecutive rows of one conversation."""

    def __init__(self) -> None:
        self.steps: list[Edits] = []
        self.blocks: list[Edits] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None     # turns and initials at the ends

    def add(self, turn: int | None, initial: str, blank: bool, repeated: bool, truncated: bool, n: int) -> None:
        if turn is not None:
            self.turns += self.high is None or turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.illegal += n - 1 + (self.last is not None and self.last + initial not in LEGAL)
        self.first = initial if self.first is None else self.first
        self.last = initial
        gone = n if blank or repeated else n - 1
        self.blank += n if blank else 0
        self.duplicate += 0 if blank else gone
        if gone < n:
            self.truncated += truncated
            self.step(edits_of(initial, False, truncated))
        if gone:
            self.step(edits_of(initial, True, False, gone))

    def step(self, edits: Edits) -> None:
        self.steps.append(edits)
        if len(self.steps) == 2 * BLOCK:
            self.blocks.append(as_step(self.steps[:BLOCK]))
            del self.steps[:BLOCK]

    def follow(self, other: Piece) -> None:
        """Appends the next piece."""
        if other.first is None:
            return
        if self.first is None:
            self.__dict__.update(other.__dict__)
            return
        self.blank, self.duplicate, self.truncated = self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated
        self.illegal += other.illegal + (self.last + other.first not in LEGAL)
        self.turns += other.turns - (other.low is not None and other.low == self.high)
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high
        self.last = other.last
        self.blocks, self.steps = self.blocks + self.steps + other.blocks, other.steps

    def result(self) -> list:
        """gaps, blank, duplicate, truncated, illegal, cost, audit"""
        value = derive(folded(self.blocks + self.steps), 0, whole=True)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [(gaps + 2**63) % 2**64 - 2**63, self.blank, self.duplicate, self.truncated, self.illegal, value[0], value[2]]

    def dump(self) -> str:
        steps = self.blocks + self.steps
        edits = as_step(folded(steps)) if steps else {}
        return json.dumps({**self.__dict__, "blocks": [[[p, q, *v] for (p, q), v in edits.items()]] if edits else [], "steps": []})

    @classmethod
    def load(cls, text: str) -> Piece:
        out = cls()
        out.__dict__.update(json.loads(text))
        out.blocks = [{(p, q): (c, n, a) for p, q, c, n, a in b} for b in out.blocks]
        return out


# ---- jobs -----------------------------------------------------------------------------------------------

RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, and a digest of conversation, role and text."""
    r, t, c = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in (role, text, conv))
    mark = F.concat(F.col(conv).isNull().cast("string"), F.lit(":"), F.length(c), F.lit(":"), c, F.length(r), F.lit(":"), r, t)
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), r.alias("role"), t.alias("text"),
                       F.unhex(F.md5(mark.cast("binary"))).alias("k"))


def _flagged(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """One row for equal rows of a turn (n of them), with what the search needs; a row with n = 0 for each listed conversation."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    slim = materialize(rows.groupBy("conv", "turn", "role", "k", (body == "").alias("blank"),
                                    (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("truncated")).agg(F.count(F.lit(1)).alias("n")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    first = slim.where("not blank").groupBy("k").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    flagged = slim.join(first, "k", "left").withColumn("repeated", F.coalesce(place > F.col("first"), F.lit(False))).drop("first")
    empty = {"turn": None, "role": None, "k": None, "blank": False, "truncated": False, "n": 0, "repeated": False}
    none = listed.select("conv").distinct().select("conv", *(F.lit(v).cast(flagged.schema[c].dataType).alias(c) for c, v in empty.items()))
    return flagged.unionByName(none)


def _pieces(flagged: DataFrame) -> DataFrame:
    """Results of conversations that lie inside one sorted partition; pieces of the first and last one of each."""
    order = ["conv", "turn", "role", "k"]
    schema = StructType([StructField("conv", flagged.schema["conv"].dataType), *(StructField(c, LongType()) for c in RESULT[:-1]),
                         StructField("audit", StringType()), *(flagged.schema[c] for c in order[1:]), StructField("piece", StringType())])
    columns = [*order, "blank", "repeated", "truncated", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        out: list[list] = []
        at, piece, edge = None, Piece(), True

        def close(edge: bool) -> None:
            head = at[1:]
            out.append([at[0], *[None] * len(RESULT), *head, piece.dump()] if edge else [at[0], *piece.result(), *head, None])

        def batch() -> pa.RecordBatch:
            rows = [pa.array([r[i] for r in out], kinds[i]) for i in range(len(names))]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, names=names)

        names, kinds = schema.names, None
        for b in batches:
            kinds = kinds or [b.schema.field("conv").type, *[pa.int64()] * 6, pa.string(), *(b.schema.field(c).type for c in order[1:]), pa.string()]
            for conv, turn, role, k, blank, repeated, truncated, n in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if at is None or conv != at[0]:
                    if at is not None:
                        close(edge)
                        edge = False
                    at, piece = (conv, turn, role, k), Piece()
                if n:
                    piece.add(turn, role[:1], blank, repeated, truncated, n)
            if out:
                yield batch()
        if at is not None:
            close(True)
            yield batch()

    return flagged.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _joined(pieces: DataFrame, schema: StructType) -> DataFrame:
    """Results of conversations from their pieces in order."""
    rows = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("has"), "turn",
                                                                           F.col("role").isNotNull().alias("named"), "role", "k", "piece"))).alias("p"))
    rows = rows.select("conv", F.col("p.piece").alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for texts in b.column("pieces").to_pylist():
                whole = Piece()
                for t in texts:
                    whole.follow(Piece.load(t))
                out.append(whole.result())
            yield pa.RecordBatch.from_arrays([b.column("conv"), *(pa.array([r[i] for r in out], pa.string() if c == "audit" else pa.int64())
                                                                  for i, c in enumerate(RESULT))], names=schema.names)

    return rows.mapInArrow(run, schema)


def repair(rows: DataFrame, listed: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: faults, gaps, cost and audit of the cheapest repair. ``listed`` names conversations to report
    even without rows."""
    listed = (rows if listed is None else listed).select(F.col(conv).alias("conv"))
    pieces = materialize(_pieces(materialize(_flagged(_rows(rows, conv, turn, role, text), listed), "flagged-turns")), "pieces")
    done = pieces.where("piece is null").select("conv", *RESULT)
    return done.unionByName(_joined(pieces.where("piece is not null"), done.schema)).withColumnRenamed("conv", conv)


def apply(rows: DataFrame, repaired: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: conv_id, position (from 1), role, text, edit; each conversation in order within one partition."""
    body = _rows(rows, conv, turn, role, text).withColumn("audit", F.lit(None).cast("string"))
    heads = repaired.select(F.col(conv).alias("conv"), "audit").where("audit <> ''")
    both = body.withColumn("is_row", F.lit(1)).unionByName(heads.withColumn("is_row", F.lit(0)), allowMissingColumns=True)
    both = both.repartition("conv").sortWithinPartitions("conv", "is_row", "turn", "role", "k").select("conv", "is_row", "role", "text", "audit")
    schema = StructType([StructField(conv, rows.schema[conv].dataType), StructField("position", LongType()), StructField("role", StringType()),
                         StructField("text", StringType()), StructField("edit", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        at, audit, step, state, n = None, "", 0, 0, 0
        out: list[tuple] = []

        def put(name: str, body: str, edit: str) -> None:
            nonlocal state, n
            state, n = NEXT[state, name[0]], n + 1
            out.append((at, n, name, body, edit))

        def inserts() -> None:
            nonlocal step
            while step < len(audit) and audit[step] == "I":
                put(WANTED[state], "", "I")
                step += 1

        for b in batches:
            for c, is_row, name, body, a in zip(*b.to_pydict().values(), strict=True):
                if not is_row:
                    inserts()
                    at, audit, step, state, n = c, a, 0, 0, 0
                    continue
                inserts()
                edit, step = audit[step], step + 1
                if edit != "D":
                    put(name if edit == "K" else WANTED[state], body, edit)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (
                    b.schema.field("conv").type, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=schema.names)
                out.clear()
            kind = b.schema.field("conv").type
        inserts()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (
                kind, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=schema.names)

    return both.mapInArrow(run, schema)


def digest(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conversation, sha256 of its role:text lines) of the rows of ``apply``, in the order in which they come. SHA-256 is
    sequential, so one task reads a conversation, a batch at a time."""
    schema = StructType([turns.schema[conv], StructField("sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        at, state, kind, out = None, None, None, []
        for b in batches:
            kind = b.schema.field(conv).type
            for c, position, role, text in zip(*(b.column(x).to_pylist() for x in (conv, "position", "role", "text")), strict=True):
                if position == 1:
                    if state is not None:
                        out.append((at, state.hexdigest()))
                    at, state = c, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    state.update(f"\n{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.string())], names=schema.names)
                out.clear()
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], kind), pa.array([state.hexdigest()], pa.string())], names=schema.names)

    return turns.mapInArrow(run, schema)




def chance(conv: Column, turn: Column, n: int) -> Column:
    """crc32 of conversation and turn, modulo n; nulls are one space."""
    key = F.concat_ws(":", F.coalesce(conv.cast("string"), F.lit(" ")), F.coalesce(turn.cast("string"), F.lit(" ")))
    return F.crc32(key.cast("binary")) % n
