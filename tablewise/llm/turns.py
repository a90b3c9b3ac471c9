"""Repair of conversation structure: the cheapest edits that make roles alternate, found in linear space.

A conversation is a string of one byte a turn: first letter of the role and fault. Edits walk through four
states (nothing yet, after a system, a user, an assistant turn). Forward cost vectors from one end
and backward ones from the other meet mid-conversation; the best crossing splits the conversation in two
halves, which are solved alike. Beside its cost each state holds the rank of its audit among those of the
four states, so that the crossing with the least audit is known without building any. Vectors are kept
relative to their least cost; few different ones exist, and their steps are looked up.

In Spark, faults are found in narrow rows spread over all executors; texts are only read as a sorted stream.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import ref

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: A turn's byte: initial (s, u, a, other), plus 4 if truncated; or gone: 8 blank, 9 duplicate. END closes a string.
INITIALS = "sua"
OTHER, TRUNCATED, BLANK, DUPLICATE, END = 3, 4, 8, 9, 10
#: Least numbers of inserted turns that lead from a state to others.
FILL = {NOTHING: {0: 0, 2: 1, 3: 2}, SYSTEM: {1: 0, 2: 1, 3: 2}, USER: {2: 0, 3: 1}, ASSISTANT: {3: 0, 2: 1}}
#: The state after a turn of an initial that may follow a state.
FOLLOWS = {(NOTHING, 0): SYSTEM, (NOTHING, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}


def _edits(code: int, state: int) -> dict[int, tuple[int, str]]:
    """State after the turn: least cost and, among equals, the least letters that lead there."""
    found: dict[int, tuple[int, str]] = {}

    def offer(after, cost, letters):
        found[after] = min(found.get(after, (cost, letters)), (cost, letters))

    for between, n in FILL[state].items():
        paid, before = INSERT * n, "I" * n
        if code == END:  # ends in NOTHING, whatever it was; a first user turn alone is no end
            if between in (NOTHING, ASSISTANT):
                offer(NOTHING, paid, before)
            continue
        offer(between, paid + DELETE, before + "D")
        if code in (BLANK, DUPLICATE):
            continue
        cut = CUT if code >= TRUNCATED else 0
        for initial in range(3):
            after = FOLLOWS.get((between, initial))
            if after is None:
                continue
            if initial == code % 4:
                offer(after, paid + cut, before + "K")
            if initial:
                offer(after, paid + cut + REROLE, before + "R")
    return found


EDITS = [[_edits(code, state) for state in range(4)] for code in range(END + 1)]
Vector = tuple  # for each state None, or (cost above the least, rank of the audit)


def _ranked(best: list) -> Vector:
    """``best``: for each state None or (cost, audit as something that sorts like it)."""
    least = min(b[0] for b in best if b is not None)
    rank = {a: i for i, a in enumerate(sorted({b[1] for b in best if b is not None}))}
    return tuple(None if b is None else (b[0] - least, rank[b[1]]) for b in best)


def _step_forward(vector: Vector, code: int) -> Vector:
    best: list = [None] * 4
    for state, here in enumerate(vector):
        if here is None:
            continue
        for after, (cost, letters) in EDITS[code][state].items():
            offer = (here[0] + cost, (here[1], letters))
            if best[after] is None or offer < best[after]:
                best[after] = offer
    return _ranked(best)


def _step_back(vector: Vector, code: int) -> Vector:
    best: list = [None] * 4
    for state in range(4):
        for after, (cost, letters) in EDITS[code][state].items():
            if vector[after] is not None:
                offer = (cost + vector[after][0], (letters, vector[after][1]))
                if best[state] is None or offer < best[state]:
                    best[state] = offer
    return _ranked(best) if any(best) else tuple(best)


class _Walk:
    """Vectors by number, with the number of the vector after each code."""

    def __init__(self, step):
        self.step, self.numbers, self.vectors, self.after = step, {}, [], []

    def number(self, vector: Vector) -> int:
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.after.append([-1] * (END + 1))
        return self.numbers[vector]

    def run(self, codes, state: int) -> Vector:
        here = self.number(tuple((0, 0) if s == state else None for s in range(4)))
        for code in codes:
            there = self.after[here][code]
            if there < 0:
                there = self.after[here][code] = self.number(self.step(self.vectors[here], code))
            here = there
        return self.vectors[here]


_FORWARD, _BACK = _Walk(_step_forward), _Walk(_step_back)
SHORT = 16


@lru_cache(1 << 16)
def _short_audit(codes: bytes, state: int, goal: int) -> str:
    return "".join(_halves(memoryview(codes), state, goal))


def _halves(codes: memoryview, state: int, goal: int) -> list[str]:
    """Least of the cheapest audits that lead over ``codes`` from one state to another."""
    if len(codes) == 1:
        return [EDITS[codes[0]][state][goal][1]]
    middle = len(codes) // 2
    left, right = codes[:middle], codes[middle:]
    ahead, behind = _FORWARD.run(left, state), _BACK.run(reversed(right), goal)
    # audits up to the crossing end in a turn's own letter: none of two different ones begins the other
    _, _, _, cross = min((a[0] + b[0], a[1], b[1], s) for s, (a, b) in enumerate(zip(ahead, behind)) if a and b)
    if len(codes) <= SHORT:
        return _halves(left, state, cross) + _halves(right, cross, goal)
    return [p for part, a, b in ((left, state, cross), (right, cross, goal)) for p in _parts(part, a, b)]


def _parts(codes: memoryview, state: int, goal: int) -> list[str]:
    return [_short_audit(bytes(codes), state, goal)] if len(codes) <= SHORT else _halves(codes, state, goal)


def audit(codes: bytes) -> str:
    """Letters of the cheapest edits, the ASCII-least ones among equals."""
    return "".join(_parts(memoryview(codes + bytes([END])), NOTHING, NOTHING))


def edited(codes: bytes, letters: str):
    """For each letter: the number of the turn (None if inserted) and the initial there (None if deleted)."""
    state, turn = NOTHING, 0
    for letter in letters:
        if letter == "D":
            yield letter, turn, None
        elif letter == "K" and codes[turn] % 4 == 0:
            state = SYSTEM
            yield letter, turn, "s"
        else:
            state = ASSISTANT if state == USER else USER
            yield letter, None if letter == "I" else turn, "a" if state == ASSISTANT else "u"
        turn += letter != "I"


def audit_cost(codes: bytes, letters: str) -> int:
    price = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}
    kept = [t for name, t, _ in edited(codes, letters) if name in "KR"]
    return sum(price[x] for x in letters) + CUT * sum(TRUNCATED <= codes[t] < BLANK for t in kept)


# --- rows

SPACE = r"\x20\x09-\x0D"
#: Order of turns; equal numbers go by role and MD5 of the text.
ORDER = ["has_turn", "turn", "role", "digest"]
PLAN = {
    "gaps": T.LongType(), "blank": T.LongType(), "duplicate": T.LongType(), "truncated": T.LongType(),
    "illegal": T.LongType(), "cost": T.LongType(), "audit": T.StringType(),
}


def turn_rows(rows: DataFrame, conv_col, turn_col, role_col, text_col, copies: Column | None = None) -> DataFrame:
    """``conv, conv_id, has_turn, turn, role, text, digest, copies``; ``conv`` is never null and tells
    conversations apart, a null role or text is one space."""
    text = F.coalesce(ref(text_col).cast("string"), F.lit(" "))
    return rows.select(
        F.coalesce(F.concat(F.lit(":"), ref(conv_col).cast("string")), F.lit("")).alias("conv"),
        ref(conv_col).alias("conv_id"),
        ref(turn_col).isNotNull().alias("has_turn"),
        F.coalesce(ref(turn_col).cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(ref(role_col).cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"),
        (F.lit(1) if copies is None else copies).cast("int").alias("copies"),
    ).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults by the hash of ``conv_id:turn``; a row that is dropped has 0 copies."""
    chance = F.pmod(
        F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")),
        F.lit(20),
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(
        "conv_id",
        "turn",
        F.when(chance == 4, "user").otherwise(F.col("role").cast("string")).alias("role"),
        F.when(chance == 1, "").when(chance == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(chance == 0, 0).when(chance == 3, 2).otherwise(1).alias("copies"),
    )


def _coded(turns: DataFrame) -> DataFrame:
    """One narrow row for each different turn, with its byte and whether its role and text came earlier."""
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    initial = F.when((initial == 0) | (F.col("role") == ""), OTHER).otherwise(initial - 1)
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut = ~F.col("text").rlike(f"[.!?][{SPACE}]*\\z")
    code = F.when(blank, BLANK).otherwise(initial + F.when(cut, TRUNCATED).otherwise(0))
    kinds = turns.select("conv", "conv_id", *ORDER, "copies", code.alias("code"), initial.alias("initial"))
    marks = kinds.groupBy("conv", *ORDER).agg(
        F.first("conv_id").alias("conv_id"), F.first("code").alias("code"), F.first("initial").alias("initial"),
        F.sum("copies").alias("n"),
    )
    first = marks.where("n > 0").groupBy("conv", "role", "digest").agg(F.min(F.struct("has_turn", "turn")).alias("first"))
    first = first.select("conv", "role", "digest", "first.has_turn", "first.turn", F.lit(True).alias("new"))
    return marks.join(first, ["conv", *ORDER], "left")


class _Plan:
    """What is known of one conversation while its turns pass by: one byte a turn."""

    def __init__(self, conv, conv_id):
        self.conv, self.conv_id = conv, conv_id
        self.codes, self.illegal, self.last = bytearray(), 0, None
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, has_turn, turn, code, initial, new, n):
        if not n:
            return
        if has_turn and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        pairs = ((0, 1), (1, 2), (2, 1))
        self.illegal += (self.last is not None and (self.last, initial) not in pairs) + n - 1
        self.last = initial
        again = BLANK if code == BLANK else DUPLICATE
        self.codes += bytes([code if new or code == BLANK else DUPLICATE]) + bytes([again]) * (n - 1)

    def row(self):
        codes = bytes(self.codes)
        letters = audit(codes)
        seen = np.bincount(np.frombuffer(codes, np.uint8), minlength=END)
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (
            self.conv, self.conv_id, gaps, int(seen[BLANK]), int(seen[DUPLICATE]), int(seen[TRUNCATED:BLANK].sum()),
            self.illegal, audit_cost(codes, letters), letters, codes,
        )


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


#: Rows, and letters of audits, of one batch that a task returns.
BATCH_ROWS, BATCH_LETTERS = 4096, 4 << 20


def _in_batches(rows, schema: pa.Schema, weight):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if len(held) >= BATCH_ROWS or size >= BATCH_LETTERS:
            yield _batch(held, schema)
            held, size = [], 0
    yield _batch(held, schema)


def _values(batches, names):
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names])


def repair_plans(turns: DataFrame) -> DataFrame:
    """``conv, conv_id``, the numbers of faults, ``cost``, ``audit`` and ``codes`` of each conversation."""
    kind = turns.schema["conv_id"].dataType
    schema = T.StructType(
        [T.StructField("conv", T.StringType()), T.StructField("conv_id", kind)]
        + [T.StructField(n, t) for n, t in PLAN.items()] + [T.StructField("codes", T.BinaryType())]
    )

    def plans(batches):
        plan = None
        for conv, conv_id, *turn in _values(batches, ["conv", "conv_id", "has_turn", "turn", "code", "initial", "new", "n"]):
            if plan is None or plan.conv != conv:
                if plan is not None:
                    yield plan.row()
                plan = _Plan(conv, conv_id)
            plan.add(*turn)
        if plan is not None:
            yield plan.row()

    def run(batches):
        yield from _in_batches(plans(batches), _arrow(schema), lambda r: 2 * len(r[8]))

    return _coded(turns).repartition("conv").sortWithinPartitions("conv", *ORDER).mapInArrow(run, schema)


FULL = {"u": "user", "a": "assistant"}


def _repaired(batches):
    """The plan of each conversation, then its turns after the edits as (number, edit, role, text)."""

    def inserted(edits, at):
        """Yields inserted turns up to the next turn's own edit, which is returned."""
        for letter, turn, initial in edits:
            if turn is not None:
                return letter, initial
            at[0] += 1
            yield at[0], letter, FULL[initial], ""
        return None

    edits, at = iter(()), [0]
    for values in _values(batches, ["conv_id", *PLAN, "codes", "role", "text", "copies"]):
        plan, codes, (role, text, copies) = values[: len(PLAN) + 1], values[-4], values[-3:]
        if codes is not None:
            yield from inserted(edits, at)  # what comes after the last turn of the one before
            edits, at = edited(codes, plan[-1]), [0]
            yield plan, None
            continue
        for _ in range(copies):
            letter, initial = yield from inserted(edits, at)
            if letter != "D":
                at[0] += 1
                yield at[0], letter, role if letter == "K" else FULL[initial], text
    yield from inserted(edits, at)


def _stream(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan, followed by its turns in order; a conversation lies in one partition."""
    head = plans.withColumn("kind", F.lit(0))
    rows = turns.where("copies > 0").withColumn("kind", F.lit(1))
    both = head.unionByName(rows, allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "kind", *ORDER).drop("conv", "kind", *[c for c in ORDER if c != "role"])


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv_id, position`` (from 1)``, edit`` (K, R or I)``, role, text`` of every conversation after its edits."""
    kind = turns.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("position", T.LongType())] + [
        T.StructField(n, T.StringType()) for n in ("edit", "role", "text")])

    def rows(batches):
        conv_id = None
        for item in _repaired(batches):
            if len(item) == 2:
                conv_id = item[0][0]
            else:
                yield conv_id, *item

    def run(batches):
        yield from _in_batches(rows(batches), _arrow(schema), lambda r: len(r[4]))

    return _stream(turns, plans).mapInArrow(run, schema)


def repair_digests(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """The plans' columns and ``repaired_sha256`` over ``role:text`` of the turns after the edits, joined by newlines."""
    schema = T.StructType(
        [T.StructField("conv_id", turns.schema["conv_id"].dataType)] + [T.StructField(n, t) for n, t in PLAN.items()]
        + [T.StructField("repaired_sha256", T.StringType())]
    )

    def rows(batches):
        plan, digest = None, None
        for item in _repaired(batches):
            if len(item) == 2:
                if plan is not None:
                    yield *plan, digest.hexdigest()
                plan, digest = item[0], hashlib.sha256()
            else:
                position, _, role, text = item
                digest.update(("\n" * (position > 1) + f"{role}:{text}").encode())
        if plan is not None:
            yield *plan, digest.hexdigest()

    def run(batches):
        yield from _in_batches(rows(batches), _arrow(schema), lambda r: len(r[-2]))

    return _stream(turns, plans).mapInArrow(run, schema)


def repair_conversations(
    rows: DataFrame, copies: Column | None = None, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"
) -> tuple[DataFrame, DataFrame]:
    """Turns and plans of conversations, for ``repaired_turns`` and ``repair_digests``.

    A null role or text is one space; rows without a conversation make one of their own. Turns go by
    number, nulls first, equal ones by role and MD5 of the text. Rows alike in all four
    columns are copies: the first counts, the others are duplicates. Only a role whose first letter is
    s, u or a can be kept. ``copies`` (0 or more) repeats rows; a conversation whose rows all
    have 0 has zeros and an empty audit. Other columns are not looked at. An empty table gives no rows.

    An audit has one letter for every turn and is a single value of the result, so one task holds one
    byte a turn of a conversation, and hashes or writes its texts as they stream by in order.
    """
    turns = turn_rows(rows, conv_col, turn_col, role_col, text_col, copies)
    return turns, repair_plans(turns)
