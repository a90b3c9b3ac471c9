"""Importance resampling towards a target: hashed word features, array-scored weights, drawn by keyed noise.

Two passes over the texts: one counts features by bucket, one scores each text against the gains of the
buckets. The scores are written once, without texts. Which rows are drawn follows from a cutoff in the order
(score down, key up) that counting jobs over the written scores close in on; only the drawn rows are
sorted, by ranges, for their ranks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import ref
from tablewise.llm.batches import LOWER, coded, documents, pieces, slices, totals
from tablewise.llm.crc import crc_of, crc_then_byte, joined_crc
from tablewise.plans.ordering import row_index
from tablewise.plans.shape import spread, stored

BUCKETS = 10_000
#: Words are runs of digits, letters a to z and everything beyond ASCII.
NO_WORD = np.ones(256, bool)
NO_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Values that one counting job tries: as many halvings at once as its binary logarithm.
PROBES = 31
LARGEST = (1 << 63) - 1
SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def features(raw: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every word and of every two words in a row, the document of each, and words per document."""
    words, first = pieces(LOWER[raw], at, NO_WORD)
    index, distinct = coded(words)
    crc = crc_of(distinct)
    size = np.fromiter((len(s.as_buffer()) for s in distinct), np.int64, len(distinct))
    owner = np.repeat(np.arange(len(at) - 1), np.diff(first))
    inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
    spaced = crc_then_byte(crc, 0x20)
    pairs = joined_crc(spaced[index[inner]], crc[index[inner + 1]], size[index[inner + 1]])
    found = np.concatenate([crc[index], pairs]) % np.uint32(buckets)
    return found.astype(np.int64), np.concatenate([owner, owner[inner]]), np.diff(first)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: one number for each of the ``buckets``."""

    def count(batches):
        sums = np.zeros(buckets, np.int64)
        for _, raw, at in slices(batches):
            sums += np.bincount(features(raw, at, buckets)[0], minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["bucket", "n"])

    counted = spread(texts.select("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln ratio) of the smoothed shares of each bucket in the target and in the source."""
    s_all, t_all, buckets = float(source.sum()), float(target.sum()), len(source)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def noise(key: str, seed: int = 7) -> int:
    """floor(1000 times standard Gumbel noise) drawn from a hash of the key."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_weights(docs: DataFrame, gains: np.ndarray, seed: int = 7) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row of ``doc_id, text``."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def score(batches):
        for rows, raw, at in slices(batches):
            found, owner, n_words = features(raw, at, len(shared.value))
            n = np.bincount(owner, minlength=len(n_words))
            order = np.argsort(owner, kind="stable")
            total = totals(shared.value[found[order]], np.concatenate([[0], np.cumsum(n)]))
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            ids = rows.column("doc_id")
            own = np.array([noise("" if i is None else str(i), seed) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(v.astype(np.int64)) for v in (n_words, n, weight, weight + own)]],
                ["doc_id", "n_words", "n_features", "weight", "score"],
            )

    return spread(docs).mapInArrow(score, SCORED)


def first_rows(rows: DataFrame, keys: list[Column], count: int) -> Column:
    """Condition for the first ``count`` of ``rows`` in the ascending order of whole-number ``keys``.

    The value at which the count is reached is closed in on by jobs that count the rows up to several
    values at once; rows tied on it are told apart by the next key in the same way. Rows tied on
    all keys stay out unless all of them fit. No row leaves its executor.
    """
    if count <= 0:
        return F.lit(False)
    tied, chosen, left = F.lit(True), F.lit(False), count
    for key in keys:
        here = rows.where(tied).select(key.alias("k"))
        low, high, n = here.agg(F.min("k"), F.max("k"), F.count("k")).first()
        if n <= left:
            return chosen | tied
        # the least value with at least ``left`` rows up to it lies in low..high
        below = 0
        while low < high:
            step = max(1, (high - low + 1) // (PROBES + 1))
            tries = [v for v in range(low + step - 1, high, step)][:PROBES]
            found = here.agg(*[F.count(F.when(F.col("k") <= v, 1)).alias(f"n{i}") for i, v in enumerate(tries)]).first()
            for v, n in zip(tries, found):
                if n >= left:
                    high = v
                    break
                low, below = v + 1, n
        chosen, tied, left = chosen | (tied & (key < low)), tied & (key == low), left - below
    return chosen | tied if rows.where(tied).count() <= left else chosen


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, seed: int = 7,
    id_col="doc_id", text_col="text", target_col="text",
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row; ``rank`` (from 1) where drawn.

    Of the rows with ``least_words`` words, floor(percent / 100) of them with the highest scores are
    drawn, ties to the smaller key. A null text has no words, weight 0 and only the noise of its key; a
    null key has the noise of an empty one and comes last among ties. Repeated rows are scored and counted one by
    one. An empty target leaves the gains to the source alone. Other columns are not looked at.
    """
    plain = documents(docs, id_col, text_col)
    goal = target.select(F.coalesce(ref(target_col).cast("string"), F.lit("")).alias("text"))
    gains = bucket_gains(bucket_counts(plain, buckets), bucket_counts(goal, buckets))
    # the row number is fixed as it is written: rows alike in score and key can be told apart
    scored = stored(score_weights(plain, gains, seed).withColumn("_row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= least_words
    count = scored.where(able).count() * percent // 100
    keys = [-F.col("score"), F.coalesce("doc_id", F.lit(LARGEST)), F.col("_row")]
    chosen = able & first_rows(scored.where(able), keys, count)
    ranked = row_index(scored.where(chosen), keys, name="rank").withColumn("rank", F.col("rank") + 1)
    rest = scored.where(~chosen).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("_row")


def drawn_documents(docs: DataFrame, resampled: DataFrame, id_col="doc_id") -> DataFrame:
    """Rows of ``docs``, all columns, whose key was drawn. Null keys never match."""
    keys = resampled.where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(keys, ref(id_col) == F.col("_drawn"), "left_semi")
