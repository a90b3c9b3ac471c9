"""Toxicity by two class-conditional Kneser-Ney models of word spellings.

Each class has counts of symbol grams inside words, discounted as Kneser-Ney does; below the longest
order both classes fall back to the same continuation counts, gathered from both. Where the counts of
the two classes do not differ by more than chance both use the same probability too, so that ordinary
spelling weighs nothing and a rare expression weighs what the counts of its class say. A word counts
once per text. A text is scored by the difference of its two log-likelihoods per symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import ref
from tablewise.llm.batches import LOWER, coded, documents, pieces, slices, totals
from tablewise.llm.ngrams import NO_LETTER, find, grams, marked
from tablewise.plans.shape import spread, stored

ORDER = 6
DISCOUNT = 0.75
#: Standard deviations by which a class must differ from both classes together in a gram.
SURE = 4.5
#: Least log-likelihood ratio that counts; smaller ones come from the mix of languages and topics.
LEAST_RATIO = 1.0
#: Texts of the sample that must have a gram for it to be looked at.
LEAST_TEXTS = 3
#: Labelled texts that are learned from, for each class at most (about).
ROWS_PER_CLASS = 6_000
#: Symbols of no opinion that every text has besides its own.
PRIOR_SYMBOLS = 60
SLICE = 4 << 20


@dataclass
class ToxicityModel:
    grams: np.ndarray  # grams in which the classes differ, sorted
    gram_ratio: np.ndarray  # log P(symbol | context, toxic) - log P(symbol | context, ordinary)
    slope: float = 1.0
    offset: float = 0.0

    def word_ratios(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        symbols, at = marked(words)
        keys = grams(symbols, at, ORDER)
        where, known = find(self.grams, keys)
        value = np.where(known, self.gram_ratio[where], 0.0) if len(self.grams) else np.zeros(len(keys))
        value[at[:-1]] = 0.0  # a BEGIN mark says nothing
        return totals(value, at), np.diff(at) - 1

    def ratios(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio per symbol of each text."""
        words, first = pieces(LOWER[raw], at, NO_LETTER)
        index, distinct = coded(words)
        value, symbols = self.word_ratios(distinct)
        return totals(value[index], first) / (totals(symbols[index], first) + PRIOR_SYMBOLS)

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.ratios(raw, at) + self.offset, -30, 30)))


def shared_backoff(keys: np.ndarray, order: int) -> np.ndarray:
    """Kneser-Ney probability of each gram's last symbol after the context one shorter, from the
    number of different grams (of both classes) that continue to it."""
    levels = [keys]  # the distinct grams of each order, longest first
    for n in range(order - 1, 0, -1):
        levels.append(np.unique(levels[-1] & np.uint64((1 << 8 * n) - 1)))
    p, shorter = np.full(len(levels[-1]), 1 / 256), levels[-1]
    for n in range(1, order):
        longer, here = levels[order - 1 - n], levels[order - n]
        mask = np.uint64((1 << 8 * n) - 1)
        kinds = np.bincount(np.searchsorted(here, longer & mask), minlength=len(here))
        context = here >> np.uint64(8)
        names, which = np.unique(context, return_inverse=True)
        total = np.bincount(which, kinds, len(names))
        types = np.bincount(which, minlength=len(names))
        below = p[np.searchsorted(shorter, here & np.uint64((1 << 8 * (n - 1)) - 1))] if n > 1 else np.full(len(here), 1 / 256)
        p = (np.maximum(kinds - DISCOUNT, 0) + DISCOUNT * types[which] * below) / total[which]
        shorter = here
    return p[np.searchsorted(shorter, keys & np.uint64((1 << 8 * (order - 1)) - 1))]


def fit_counts(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> ToxicityModel:
    """Model from the counts of sorted distinct grams in both classes."""
    if not len(keys):
        return ToxicityModel(keys, np.zeros(0))
    below = shared_backoff(keys, ORDER)
    contexts, which = np.unique(keys >> np.uint64(8), return_inverse=True)
    logs, held = [], []
    for counts in (toxic, ordinary):
        total = np.bincount(which, counts, len(contexts))
        types = np.bincount(which, counts > 0, len(contexts))
        left = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
        own = np.maximum(counts - DISCOUNT, 0) / np.maximum(total, 1)[which]
        logs.append(np.log(own + left[which] * below))
        held.append(total[which])
    share = held[0] / (held[0] + held[1])
    expected = share * (toxic + ordinary)
    sure = np.abs(toxic - expected) > SURE * np.sqrt(expected * (1 - share) + 1)
    ratio = logs[0] - logs[1]
    sure &= np.abs(ratio) >= LEAST_RATIO
    return ToxicityModel(keys[sure], ratio[sure])


def calibrate(ratios: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit (Newton steps with a little shrinkage)."""
    if not len(ratios) or toxic.min() == toxic.max():
        return 1.0, -30.0 if not len(ratios) or not toxic.max() else 30.0
    scale = float(np.std(ratios)) or 1.0
    x = np.stack([ratios / scale, np.ones(len(ratios))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - toxic) + 1e-3 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / scale), float(w[1])


def labelled_sample(docs, labels, learn: Column, rows_per_class, id_col, text_col, label_col) -> DataFrame:
    """``text, toxic, half`` of about ``rows_per_class`` labelled texts of either class, by key hash."""
    known = labels.where(ref(label_col).isNotNull()).select(
        ref(id_col).cast("long").alias("doc_id"), (ref(label_col) == 1).cast("int").alias("toxic")
    )
    known = known.where(learn)
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic") == 1, rows_per_class / max(1, n.get(1, 0))).otherwise(rows_per_class / max(1, n.get(0, 0)))
    chosen = known.where(draw < share).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int"))
    # About 2 * rows_per_class rows of three numbers.
    return documents(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("text", "toxic", "half")


def _count(batches):
    for rows, raw, at in slices(batches, limit=SLICE):
        words, first = pieces(LOWER[raw], at, NO_LETTER)
        index, distinct = coded(words)
        symbols, mark = marked(distinct)
        keys = grams(symbols, mark, ORDER)
        inner = np.ones(len(keys), bool)
        inner[mark[:-1]] = False
        owner = np.repeat(np.arange(len(distinct)), np.diff(mark))
        names, which = np.unique(keys[inner], return_inverse=True)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
        group = (2 * rows.column("toxic").to_numpy(zero_copy_only=False) + rows.column("half").to_numpy(zero_copy_only=False))
        out = [pa.array(names.view(np.int64))]
        once = np.unique(doc * np.int64(len(distinct)) + index)
        doc, index = once // max(1, len(distinct)), once % max(1, len(distinct))
        for g in range(4):
            used = np.bincount(index[group[doc] == g], minlength=len(distinct))
            out.append(pa.array(np.bincount(which, used[owner[inner]], len(names)).astype(np.int64)))
        yield pa.RecordBatch.from_arrays(out, ["gram", "o0", "o1", "t0", "t1"])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, learn: Column | None = None, rows_per_class: int = ROWS_PER_CLASS,
    id_col="doc_id", text_col="text", label_col="toxic",
) -> ToxicityModel:
    """Learn from at most about ``rows_per_class`` labelled whole texts of each class.

    ``learn`` is a condition on ``doc_id`` for the labels to use. The score's slope and offset are fit
    on ratios that each half of the sample gets from the model of the other half. Rows without a label
    of 1 or another number are left out; a document with several labels counts once for each. With no toxic label at all every score is near 0.
    """
    sample = stored(labelled_sample(docs, labels, F.lit(True) if learn is None else learn, rows_per_class, id_col, text_col, label_col))
    counted = sample.mapInArrow(_count, "gram long, o0 long, o1 long, t0 long, t1 long")
    table = counted.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("o0", "o1", "t0", "t1")])
    table = table.where(F.col("o0") + F.col("o1") + F.col("t0") + F.col("t1") >= LEAST_TEXTS).toPandas()
    keys = table["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, n = keys[order], {c: table[c].to_numpy(np.int64)[order] for c in ("o0", "o1", "t0", "t1")}
    halves = []
    for half in "01":
        there = n["o" + half] + n["t" + half] > 0
        halves.append(fit_counts(keys[there], n["t" + half][there], n["o" + half][there]))
    models = docs.sparkSession.sparkContext.broadcast(halves)

    def ratios(batches):
        for rows, raw, at in slices(batches, limit=SLICE):
            half = rows.column("half").to_numpy(zero_copy_only=False)
            both = [m.ratios(raw, at) for m in models.value]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(half == 1, both[0], both[1])), rows.column("toxic")], ["ratio", "toxic"]
            )

    held = sample.mapInArrow(ratios, "ratio double, toxic int").toPandas()
    models.unpersist()
    model = fit_counts(keys, n["t0"] + n["t1"], n["o0"] + n["o1"])
    model.slope, model.offset = calibrate(held["ratio"].to_numpy(float), held["toxic"].to_numpy(float))
    return model


def with_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """All rows and columns and the score of the whole text; null and empty texts score as no text.

    ``name`` must not be a column yet, whatever its case.
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {name} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        for rows, raw, at in slices(batches, text_col, SLICE):
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(shared.value.scores(raw, at), pa.float64())], [*rows.schema.names, name]
            )

    return spread(docs).mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold=0.7, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, score, predicted`` of every row."""
    scored = with_toxicity(documents(docs, id_col, text_col), model, "text", "score")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fold(modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))
