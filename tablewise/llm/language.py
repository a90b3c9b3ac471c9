"""Language by two steps: the family first, then one-versus-one linear machines inside it."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import ref
from tablewise.llm.batches import LOWER, coded, documents, pieces, slices, spread_indices, totals
from tablewise.llm.ngrams import NO_LETTER, grams, marked
from tablewise.plans.shape import spread, stored

#: Families of common language codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
    "indic": "hi ur bn pa mr gu ne".split(),
}
BUCKETS = 2048
GRAM_ORDERS = (1, 2, 3, 4)
#: Labelled texts that are learned from, over all languages (about).
MAX_ROWS = 4_000
SLICE = 4 << 20


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.split("-")[0].lower() in codes), lang)


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every gram of every word, and where each word's buckets begin (n + 1)."""
    symbols, at = marked(words)
    long = grams(symbols, at, max(GRAM_ORDERS))
    columns = []
    for n in GRAM_ORDERS:
        key = (long & np.uint64((1 << 8 * n) - 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        columns.append((key >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
    return np.stack(columns, 1).reshape(-1), at * len(GRAM_ORDERS)


def linear_machine(x: np.ndarray, y: np.ndarray, shrink: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge, balanced classes) by accelerated descent."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b = np.zeros(x.shape[1]), 0.0
    v, c, t = w.copy(), 0.0, 1.0
    # the largest curvature, by power steps
    probe = np.random.default_rng(0).normal(size=x.shape[1])
    for _ in range(20):
        probe = x.T @ (weight * (x @ probe))
        norm = np.linalg.norm(probe) or 1.0
        probe /= norm
    rate = 1 / (2 * (norm + 1) + shrink)
    for _ in range(steps):
        slack = weight * np.maximum(0, 1 - y * (x @ v + c)) * y
        w2, b2 = v + rate * (2 * x.T @ slack - shrink * v), c + rate * 2 * slack.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, float(b)


@dataclass
class LanguageModel:
    families: dict[str, list[str]]
    planes: np.ndarray  # one column of bucket weights for each machine
    offsets: np.ndarray
    family_planes: dict[str, int] = field(default_factory=dict)
    pair_planes: dict[tuple[str, str], int] = field(default_factory=dict)

    def predict(self, raw: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(at) - 1
        words, first = pieces(LOWER[raw], at, NO_LETTER)
        index, distinct = coded(words)
        buckets, begin = word_features(distinct)
        size = np.diff(begin)
        count = np.maximum(totals(size[index], first), 1)
        margins = np.zeros((n, len(self.offsets)))
        for p in range(len(self.offsets)):
            of_word = totals(self.planes[buckets, p], begin)
            margins[:, p] = totals(of_word[index], first) / count + self.offsets[p]
        sure = lambda m: 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
        names = sorted(self.families)
        if len(names) > 1:
            by_family = np.stack([margins[:, self.family_planes[f]] for f in names], 1)
        else:
            by_family = np.full((n, len(names)), 30.0)
        choice = by_family.argmax(1) if names else np.zeros(n, int)
        langs, score = ["und"] * n, np.zeros(n)
        for k, f in enumerate(names):
            rows = np.flatnonzero(choice == k)
            codes = self.families[f]
            votes, belief = np.zeros((len(rows), len(codes))), np.zeros((len(rows), len(codes)))
            for (a, b), p in self.pair_planes.items():
                if a in codes and b in codes:
                    s, i, j = sure(margins[rows, p]), codes.index(a), codes.index(b)
                    votes[:, i] += s >= 0.5
                    votes[:, j] += s < 0.5
                    belief[:, i] += s
                    belief[:, j] += 1 - s
            others = max(1, len(codes) - 1)
            # most votes win; among equals the larger sum of beliefs, then the first code
            win = (votes + belief / (2 * others)).argmax(1)
            inner = belief[np.arange(len(rows)), win] / others if len(codes) > 1 else np.ones(len(rows))
            score[rows] = sure(by_family[rows, k]) * inner
            for r, w in zip(rows.tolist(), win.tolist()):
                langs[r] = codes[w]
        return langs, score


def _features(batches):
    for rows, raw, at in slices(batches, limit=SLICE):
        words, first = pieces(LOWER[raw], at, NO_LETTER)
        index, distinct = coded(words)
        buckets, begin = word_features(distinct)
        values = []
        for i in range(len(at) - 1):
            here, n = np.unique(index[first[i] : first[i + 1]], return_counts=True)
            sizes = begin[here + 1] - begin[here]
            spots = spread_indices(begin[here], sizes)
            counts = np.bincount(buckets[spots], np.repeat(n, sizes), BUCKETS) if len(spots) else np.zeros(BUCKETS)
            values.append((counts / max(1.0, counts.sum())).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([rows.column("lang"), pa.array(values, pa.binary())], ["lang", "x"])


def fit_language(
    docs: DataFrame, learn: Column | None = None, max_rows: int = MAX_ROWS, id_col="doc_id", text_col="text", lang_col="lang"
) -> LanguageModel:
    """Learn from about ``max_rows`` whole texts, as many of each language, chosen by key hash.

    ``learn`` is a condition on ``doc_id``. Rows without a language are left out; a language whose
    family has no other is told by its family alone.
    """
    known = docs.select(
        ref(id_col).cast("long").alias("doc_id"),
        F.coalesce(ref(text_col).cast("string"), F.lit("")).alias("text"),
        ref(lang_col).cast("string").alias("lang"),
    ).where("lang is not null")
    if learn is not None:
        known = known.where(learn)
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    each = max_rows / max(1, len(langs))
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, each / sizes[lang]).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    sample = stored(known.where(draw < share).where("text != ''").select("text", "lang"))
    table = sample.mapInArrow(_features, "lang string, x binary").toPandas()
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(family_of(lang), []).append(lang)
    model = LanguageModel(families, np.zeros((BUCKETS, 0)), np.zeros(0))
    if not len(table):
        return model
    x = np.stack([np.frombuffer(b, np.float32) for b in table["x"]]).astype(np.float64)
    y = table["lang"].to_numpy(object)
    middle, scale = x.mean(0), 1 / np.maximum(x.std(0), 1e-4) / np.sqrt(x.shape[1])
    z = (x - middle) * scale
    planes, offsets = [], []

    def machine(rows, side):
        w, b = linear_machine(z[rows], side)
        planes.append(w * scale)
        offsets.append(b - float((w * scale) @ middle))
        return len(planes) - 1

    family = np.array([family_of(v) for v in y], object)
    if len(families) > 1:
        for f in sorted(families):
            model.family_planes[f] = machine(np.ones(len(y), bool), np.where(family == f, 1.0, -1.0))
    for codes in families.values():
        for a, b in combinations(codes, 2):
            rows = (y == a) | (y == b)
            model.pair_planes[a, b] = machine(rows, np.where(y[rows] == a, 1.0, -1.0))
    model.planes = np.stack(planes, 1) if planes else np.zeros((BUCKETS, 0))
    model.offsets = np.array(offsets)
    return model


def predict_language(docs: DataFrame, model: LanguageModel, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; a text that is null or has no letter is ``und``
    with score 0, as are all where nothing was learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for rows, raw, at in slices(batches, limit=SLICE):
            langs, score = shared.value.predict(raw, at)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("letters"), pa.array(langs, pa.string()), pa.array(score)],
                ["doc_id", "letters", "lang_pred", "score"],
            )

    plain = documents(docs, id_col, text_col).withColumn("letters", F.col("text").rlike(r"\p{L}"))
    found = spread(plain).mapInArrow(run, "doc_id long, letters boolean, lang_pred string, score double")
    return found.select(
        "doc_id",
        F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"),
    )
