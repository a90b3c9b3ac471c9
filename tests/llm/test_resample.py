"""Importance resampling against a plain dictionary version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewise.llm import resample
from tablewise.llm.batches import buffer_of
from tablewise.llm.crc import crc_of, joined_crc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(g.encode()) % 10000 for g in grams]


def brute(rows, target):
    s = Counter(b for _, t in rows for b in brute_features(t)[1])
    t = Counter(b for x in target for b in brute_features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out, able = [], []
    for i, text in rows:
        n, found = brute_features(text)
        weight = math.floor(sum(map(gain, found)) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
        if n >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for rank, row in enumerate(able[: 25 * len(able) // 100]):
        row[4] = rank + 1
    return Counter(map(tuple, out))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    syllables = ["ba", "DE", "ki", "Ö", "é", "x1", "語"]
    text = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(-5, 120)]
    rows += [(200, None), (201, ""), (202, "!?_ \x7f"), (203, "w" * 70_000 + " " + "z" * 40), (None, text(50)), (204, text(9000))]
    rows += [rows[3], rows[30], rows[30], (None, rows[-2][1])]
    rows += [(300 + i, rows[10][1]) for i in range(30)]
    target = [text(30) for _ in range(4)] + [None, ""]
    docs = spark.createDataFrame([(*r, 1, "a", 2) for r in rows], "doc_id long, text string, rank int, score string, _row int")
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    return rows, target, docs.repartition(4), goal


def test_resampling_equals_brute_force(tables):
    rows, target, docs, goal = tables
    found = resample.importance_resample(docs, goal)
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect())
    assert got == brute(rows, target)
    kept = resample.drawn_documents(docs, found)
    assert kept.columns == docs.columns and kept.count() >= len(rows) // 6


def test_empty_tables(spark, tables):
    _, target, docs, goal = tables
    assert resample.importance_resample(docs.limit(0), goal).count() == 0
    assert resample.importance_resample(docs, goal.limit(0)).where("rank is not null").count() > 0


def test_joined_crcs():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in [0, 1, 2, 3, 7, 64, 1000, 65537]]
    left, right = zip(*[(a, b) for a in parts for b in parts])
    got = joined_crc(crc_of(pa.array(left, pa.binary())), crc_of(pa.array(right, pa.binary())), np.array([len(b) for b in right]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(left, right)]
    assert buffer_of(pa.array(["é"]))[0].tolist() == [0xC3, 0xA9]


@pytest.mark.parametrize("count", [0, 1, 7, 50, 99, 100, 500])
def test_first_rows_with_ties(spark, count):
    rng = random.Random(count)
    rows = sorted((rng.choice([-(10**12), 0, 3, 3, 4]), rng.randint(0, 3), i) for i in range(100))
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(3)
    keys = [F.col("a"), F.col("b"), F.col("c")]
    got = df.where(resample.first_rows(df, keys, count)).collect()
    assert sorted(map(tuple, got)) == rows[:count]
