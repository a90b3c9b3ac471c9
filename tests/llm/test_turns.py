"""Conversation repair against all possible edits, and whole conversations against a plain version."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tablewise.llm import turns

GOAL = re.compile(r"(s?(ua)+)?")
CODES = [0, 1, 2, 3, 4, 5, 6, 7, 8]


def all_edits(codes):
    """Least (cost, audit, roles) over every edit of every turn with up to two inserted turns before each and at the end."""
    ways = []
    for n, c in enumerate(codes):
        cut, own = (1 if 4 <= c < 8 else 0), "sua?"[c % 4]
        ways.append([(3, "D", "")] + ([] if c >= 8 else [(cut, "K", own), (2 + cut, "R", "u"), (2 + cut, "R", "a")]))
    fills = [(2 * k, "I" * k, "".join(f)) for k in range(3) for f in itertools.product("ua", repeat=k)]
    best = None
    slots = [s for w in ways for s in (fills, w)] + [fills]
    for choice in itertools.product(*slots):
        roles = "".join(x[2] for x in choice)
        if GOAL.fullmatch(roles):
            offer = (sum(x[0] for x in choice), "".join(x[1] for x in choice), roles)
            best = offer if best is None else min(best, offer)
    return best


def by_strings(codes):
    """The same for long conversations: the best audit up to each state, kept as a string."""
    best = {"": (0, "", "")}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, roles) in list(best.items()):
                for r in "ua":
                    if GOAL.fullmatch(roles + r) or GOAL.fullmatch(roles + r + "a"):
                        offer = (cost + 2, audit + "I", roles + r)
                        best[r] = min(best.get(r, offer), offer)
        return best

    for c in codes:
        after = {}
        cut, own = (1 if 4 <= c < 8 else 0), "sua?"[c % 4]
        for state, (cost, audit, roles) in inserted(best).items():
            ways = [(3, "D", "")] + ([] if c >= 8 else [(cut, "K", own), (2 + cut, "R", "u"), (2 + cut, "R", "a")])
            for price, letter, r in ways:
                new = roles + r
                if any(GOAL.fullmatch(new + end) for end in ("", "a", "ua")):
                    offer = (cost + price, audit + letter, new)
                    best_here = after.get(r or state)
                    after[r or state] = offer if best_here is None else min(best_here, offer)
        best = after
    return min(v for v in inserted(best).values() if GOAL.fullmatch(v[2]))


def check(codes, want):
    got = turns.audit(codes)
    assert (turns.audit_cost(codes, got), got) == want[:2], codes
    assert "".join(i for _, _, i in turns.edited(codes, got) if i) == want[2]


def test_audit_is_the_least_of_all_edits():
    for n in range(3):
        for codes in itertools.product(CODES, repeat=n):
            check(bytes(codes), all_edits(codes))
    rng = random.Random(1)
    for _ in range(60):
        codes = bytes(rng.choices(CODES, k=3))
        check(codes, all_edits(codes))


def test_long_audits():
    rng = random.Random(2)
    for n in [3, 4, 5, 8, 15, 16, 17, 33, 70, 300, 1000]:
        for _ in range(12):
            codes = bytes(rng.choices(CODES, [2, 9, 9, 1, 1, 2, 2, 1, 2], k=n))
            check(codes, by_strings(codes))
    assert turns.audit(b"") == ""


def plain(rows):
    """Digest columns of each conversation of damaged (conv_id, turn, role, text) rows, by the contract."""
    out = {}
    for conv_id in {r[0] for r in rows}:
        kept = []
        mine = [r for r in rows if r[0] == conv_id]
        order = lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", hashlib.md5((" " if r[3] is None else r[3]).encode()).digest())
        for _, turn, role, text in mine:
            role, text = " " if role is None else role, " " if text is None else text
            d = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
            if d == 0:
                continue
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(d, text)
            kept += [(conv_id, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
        kept.sort(key=order)
        codes, seen = [], set()
        for _, _, role, text in kept:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            initial = {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)
            codes.append(8 if not body else 9 if (role, text) in seen else initial + (4 if body[-1] not in ".!?" else 0))
            seen.add((role, text))
        numbers = [r[1] for r in kept if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, letters, roles = by_strings([min(c, 8) for c in codes])
        repaired, at, taken = [], 0, iter(roles)
        for x in letters:
            r = "" if x == "D" else {"u": "user", "a": "assistant", "s": "system"}[next(taken)]
            if x in "KR":
                repaired.append((kept[at][2] if x == "K" else r) + ":" + kept[at][3])
            elif x == "I":
                repaired.append(r + ":")
            at += x != "I"
        out[conv_id] = (
            gaps, codes.count(8), codes.count(9), sum(4 <= c < 8 for c in codes), illegal, cost, letters,
            hashlib.sha256("\n".join(repaired).encode()).hexdigest(),
        )
    return out


def awkward_rows():
    rng = random.Random(4)
    texts = ["Yes.", "No!  \n", "why", "", " \t\x0b", None, "é?", "Yes.", "long " * 20_000 + ".", " ", "a\nb."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User", "usher"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            role = roles[turn % 2] if rng.random() < 0.7 else rng.choice(roles)
            text = f"Turn {turn}{rng.choice('.!?x')}" if rng.random() < 0.6 else rng.choice(texts)
            rows.append((conv, rng.choice([turn, turn, turn * 3, 2, None]), role, text))
    rows += rows[:5] + [rows[7]] * 4
    # a conversation of which every row is dropped, and one without turn numbers
    gone = next(i for i in itertools.count(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    return rows + [(gone, 1, "user", "x"), (70, None, "user", "a."), (70, None, "assistant", "b.")]


def test_conversations(spark):
    rows = awkward_rows()
    df = spark.createDataFrame([(*r, "x", 5, 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, copies int, code int")
    made, plans = turns.repair_conversations(turns.damaged(df.repartition(5)), F.col("copies"))
    want = plain(rows)
    got = {r[0]: tuple(r)[1:] for r in turns.repair_digests(made, plans).collect()}
    assert got == want
    # the written turns give the same digest
    texts = {}
    for r in sorted(turns.repaired_turns(made, plans).collect(), key=lambda r: r.position):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(texts.get(c, [])).encode()).hexdigest() == want[c][-1] for c in want)


def test_query_and_empty_table(spark):
    folder = "/root/testdata/sf0.001"
    from tablewise.llm.queries import QUERIES

    found = QUERIES["op11_conversation_repair"](spark, folder).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in found} == plain(rows)
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert turns.repair_digests(*turns.repair_conversations(none)).count() == 0


@pytest.mark.parametrize("kind", ["conv_id string", "conv_id long"])
def test_one_conversation_may_hold_most_rows(spark, kind):
    text = F.concat(F.lit("Turn "), F.col("id"), F.lit("."))
    rows = spark.range(30_000).select(
        F.lit(1).cast(kind.split()[1]).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") % 3 == 0, "Same.").otherwise(text).alias("text"),
    )
    found = turns.repair_digests(*turns.repair_conversations(rows)).first()
    assert found.duplicate == 9998 and found.gaps == 0 and found.illegal == 0 and found.audit.count("D") >= 9998
