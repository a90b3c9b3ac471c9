"""Keyword search over blocks of postings that know their best score.

A posting's impact is its BM25 score without the weight of the term. Postings of like impact form a
block, which carries the best of them. A search first scores the documents of the best blocks of each
query's strongest terms; the k-th of their scores is a floor. With the terms of a query in order of what they
can add at most, a document found first by one term scores no more than its impact there and the
most that all later terms can add. Blocks, and postings in them, that stay below the floor by this bound are
skipped, so that frequent words pair few documents with a query. What remains is scored in full.

Scores are made document by document: the postings of a document meet in one task, which adds up its scores for
all queries as an array and keeps the best of each query. Pairs of queries and documents are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import ref, word_tokens
from tablewise.plans.nearest import SCORE_DIGITS, top_per_query
from tablewise.plans.shape import stored

K1, B = 1.5, 0.75
#: Impact lies between 0 and K1 + 1; so many levels of it make blocks.
LEVELS = 48
#: Postings of one block (about) where a word is in every document.
BLOCK_POSTINGS = 4096
#: Folders of the stored blocks; a term lies in one.
BUCKETS = 64
#: Strongest terms of a query whose best postings set the floor, and postings of a block that are tried, for each hit wanted.
SEED_TERMS, SEED_POSTINGS = 6, 4
#: Parts of a score are added as whole numbers of this fraction.
FIXED_POINT = 1e12
#: Query terms that travel with the tasks, at most; more of them are joined as rows.
BROADCAST_TERMS = 1 << 20
#: Postings a task looks at together, bytes of their scores, and products of a posting and a query.
BLOCK_ROWS, SCORE_BYTES, PRODUCTS = 1 << 17, 1 << 25, 1 << 21
#: Scores are rounded before they are compared, so bounds keep this distance.
SLACK = 10.0 ** -(SCORE_DIGITS - 1)


@dataclass
class KeywordIndex:
    """Postings one by one (``doc_id, term, tf, doc_len``), the same in blocks, and the terms."""

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    documents: int
    average: float


def _impact(tf, length, average: float):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _parts(postings: DataFrame, average: float) -> tuple[DataFrame, DataFrame]:
    """Blocks and terms. A term of few postings is one block of level 0; others have blocks by level, dealt by document."""
    impact = _impact(F.col("tf"), F.col("doc_len"), average)
    rows = postings.select("term", "doc_id", impact.alias("impact"))
    level = F.floor(F.col("impact") * (LEVELS / (K1 + 1))).cast("int")
    many = F.col("df") > BLOCK_POSTINGS
    terms = rows.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("best"), F.max(level).alias("level"))
    terms = stored(terms.withColumn("level", F.when(many, F.col("level")).otherwise(0)))
    frequent = terms.where(many).select("term", "df")
    # each has more than BLOCK_POSTINGS postings; a number proven small travels
    frequent = F.broadcast(frequent) if frequent.count() <= BROADCAST_TERMS else frequent
    salt = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("df") / BLOCK_POSTINGS)).cast("int")
    dealt = rows.join(frequent, "term", "left").select(
        "term", F.when(many, level).otherwise(0).alias("level"), F.when(many, salt).otherwise(0).alias("salt"), "impact", "doc_id"
    )
    # dealt first, so that lists are gathered once
    blocks = dealt.repartition("term", "level", "salt").groupBy("term", "level", "salt").agg(
        F.max("impact").alias("best"), F.sort_array(F.collect_list(F.struct("impact", "doc_id")), False).alias("held")
    )
    return blocks.withColumn("bucket", _bucket(F.col("term"))), terms


def build_index(postings: DataFrame, documents: int) -> KeywordIndex:
    """Index of the rows of :func:`tablewise.operators.retrieve.bm25_index`, kept for the session."""
    kept = stored(postings)
    total = kept.agg(F.sum("tf")).first()[0] or 0
    average = total / documents if total else 1.0
    blocks, terms = _parts(kept, average)
    return KeywordIndex(kept, stored(blocks), terms, documents, average)


def write_index(index: KeywordIndex, folder: str) -> None:
    """Store an index: blocks in a folder for each bucket of terms, in order of terms."""
    index.postings.write.parquet(f"{folder}/postings")
    index.blocks.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/blocks")
    index.terms.write.parquet(f"{folder}/terms")
    spark = index.terms.sparkSession
    spark.createDataFrame([(index.documents, index.average)], "documents long, average double").coalesce(1).write.parquet(f"{folder}/size")


def open_index(spark, folder: str) -> KeywordIndex:
    size = spark.read.parquet(f"{folder}/size").first()
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    return KeywordIndex(read("postings"), read("blocks"), read("terms"), size["documents"], size["average"])


class _Asked:
    """The terms of all queries as arrays: ``queries`` and ``weights`` of term t lie from ``starts[t]``."""

    def __init__(self, rows: list, numbers: dict[str, int], queries: dict):
        term = np.array([numbers[r["term"]] for r in rows], dtype=np.int64)
        order = np.argsort(term, kind="stable")
        self.starts = np.searchsorted(term[order], np.arange(len(numbers) + 1))
        self.queries = np.array([queries[r["query_id"]] for r in rows], dtype=np.int64)[order]
        self.weights = np.array([r["qtf"] * r["idf"] for r in rows], dtype=np.float64)[order]
        self.size = len(queries)

    def add(self, scores: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """Add what the postings give to each query, in fixed point."""
        flat, each = scores.reshape(-1), self.starts[term + 1] - self.starts[term]
        ends = np.cumsum(each)
        i = 0
        while i < len(doc):
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + PRODUCTS, side="right")))
            n = each[i:j]
            at = np.arange(int(ends[j - 1] - done)) + np.repeat(self.starts[term[i:j]] - (ends[i:j] - n - done), n)
            part = np.rint(self.weights[at] * np.repeat(impact[i:j], n) * FIXED_POINT).astype(np.int64)
            np.add.at(flat, np.repeat(doc[i:j] * self.size, n) + self.queries[at], part)
            i = j


def _best_rows(scores: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and rounded score of the ``top_k`` best rows of each query that score over 0; the earlier of like rows."""
    unit = int(FIXED_POINT / 10**SCORE_DIGITS)
    rounded = (scores + unit // 2) // unit
    if len(rounded) > top_k:
        floor = np.partition(rounded, len(rounded) - top_k, axis=0)[len(rounded) - top_k]
        row, query = np.nonzero((rounded >= np.maximum(floor, 1)))
    else:
        row, query = np.nonzero(rounded > 0)
    value = rounded[row, query]
    order = np.lexsort((row, -value, query))
    query, row, value = query[order], row[order], value[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < top_k], row[place < top_k], value[place < top_k]


def best_documents(
    postings: DataFrame, average: float, asked: DataFrame, top_k: int, among: DataFrame | None = None
) -> DataFrame:
    """``query_id, item_id, score, rank``: the best documents of each query, of those ``among`` if it is given.

    ``asked`` has ``query_id, term, qtf, idf``. Postings of asked terms are dealt and sorted by document, once.
    Sums are of whole numbers, so the order of rows does not matter.
    """
    asked = asked.where("idf IS NOT NULL").select("query_id", "term", "qtf", "idf")
    id_type = postings.schema["doc_id"].dataType
    fields = [T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("item_id", id_type)]
    if asked.count() > BROADCAST_TERMS:
        return top_per_query(_joined_scores(postings, average, asked, among), top_k)
    spark = postings.sparkSession
    rows = asked.collect()  # at most BROADCAST_TERMS
    numbers = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    queries = {q: i for i, q in enumerate(dict.fromkeys(r["query_id"] for r in rows))}
    table = _Asked(rows, numbers, queries)
    named = F.broadcast(spark.createDataFrame(list(numbers.items()), "term string, no int"))
    found = postings.join(named, "term").select("doc_id", "no", F.col("tf").cast("double").alias("tf"), F.col("doc_len").cast("double").alias("doc_len"))
    if among is not None:  # a mark is a posting of no term
        marks = among.select("doc_id", F.lit(-1).alias("no"), F.lit(0.0).alias("tf"), F.lit(0.0).alias("doc_len"))
        found = found.union(marks)
    marked = among is not None
    names = list(queries)
    step = max(1, SCORE_BYTES // (8 * max(1, len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, scores in _documents(batches, table, average, marked, step):
            query, row, value = _best_rows(scores, top_k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int32()), ids.take(pa.array(row)), pa.array(value, pa.int64())], ["q", "item_id", "score"]
            )

    dealt = found.repartition("doc_id").sortWithinPartitions("doc_id")
    schema = T.StructType([T.StructField("q", T.IntegerType()), fields[1], T.StructField("score", T.LongType())])
    first = top_per_query(dealt.mapInArrow(run, schema).withColumnRenamed("q", "query_id"), top_k).withColumnRenamed("query_id", "q")
    keys = spark.createDataFrame([(i, q) for i, q in enumerate(names)], T.StructType([T.StructField("q", T.IntegerType()), fields[0]]))
    # one row per query, of proven size
    return first.join(F.broadcast(keys), "q").select(
        "query_id", "item_id", F.round(F.col("score") / 10**SCORE_DIGITS, SCORE_DIGITS).alias("score"), "rank"
    )


def _documents(batches, table: _Asked, average: float, marked: bool, step: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Keys and scores of whole documents, at most ``step`` at once, from postings sorted by document. The last document of
    a block goes on in the next one."""
    last = None

    def scored(rows: pa.Table):
        nonlocal last
        key = rows["doc_id"].combine_chunks()
        coded = key.dictionary_encode(null_encoding="encode")
        doc, ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        no, tf, length = (rows[c].to_numpy() for c in ("no", "tf", "doc_len"))
        with np.errstate(invalid="ignore", divide="ignore"):
            impact = _impact(tf, length, average)
        at = np.searchsorted(doc, np.arange(0, len(ids) + step, step))
        for n, (i, j) in enumerate(zip(at[:-1], at[1:])):
            some = ids.slice(n * step, step)
            scores = np.zeros((len(some), table.size), np.int64)
            wanted = np.full(len(some), not marked)
            here, real = doc[i:j] - n * step, no[i:j] >= 0
            wanted[here[~real]] = True
            table.add(scores, here[real], no[i:j][real].astype(np.int64), impact[i:j][real])
            if last is not None:
                if last[0].equals(some.slice(0, 1)):
                    scores[0] += last[1]
                    wanted[0] |= last[2]
                elif last[2]:
                    yield last[0], last[1][None, :]
            last = some.slice(len(some) - 1), scores[-1].copy(), wanted[-1]
            full = np.flatnonzero(wanted[:-1])
            if len(full):
                yield some.take(pa.array(full)), scores[full]

    held, count = [], 0
    for b in batches:
        held.append(b)
        count += len(b)
        if count >= BLOCK_ROWS:
            yield from scored(pa.Table.from_batches(held))
            held, count = [], 0
    if count:
        yield from scored(pa.Table.from_batches(held))
    if last is not None and last[2]:
        yield last[0], last[1][None, :]


def _joined_scores(postings: DataFrame, average: float, asked: DataFrame, among: DataFrame | None) -> DataFrame:
    """Scores over 0 of all pairs that share a term, for query sets too large to travel."""
    docs = postings if among is None else postings.join(among, postings["doc_id"].eqNullSafe(among["doc_id"]), "left_semi")
    part = F.col("idf") * _impact(F.col("tf"), F.col("doc_len"), average)
    return (
        docs.join(asked, "term")
        .groupBy("query_id", F.col("doc_id").alias("item_id"))
        .agg(F.sum(F.round(F.col("qtf") * part * FIXED_POINT).cast("long")).alias("score"))
        .withColumn("score", F.round(F.col("score") / FIXED_POINT, SCORE_DIGITS))
        .where(F.col("score") > 0)
    )


def _weighted(index: KeywordIndex, queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """``query_id, term, qtf, idf, w, most, rest, place``: what each term can add, and all after it."""
    asked = (
        queries.select(ref(query_id).alias("query_id"), F.explode(word_tokens(ref(query_text))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )
    df = F.col("df")
    known = asked.join(index.terms, "term").withColumn("idf", F.ln((index.documents - df + 0.5) / (df + 0.5) + 1))
    known = known.withColumn("w", F.col("qtf") * F.col("idf")).withColumn("most", F.col("w") * F.col("best"))
    order = Window.partitionBy("query_id").orderBy(F.col("most").desc(), "term")
    rest = F.coalesce(F.sum("most").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    return known.select("query_id", "term", "qtf", "idf", "w", "level", rest.alias("rest"), F.row_number().over(order).alias("place"))


def _needed(index: KeywordIndex, weighted: DataFrame, top_k: int) -> tuple[DataFrame, DataFrame]:
    """``query_id, term, bucket, w, least``: what a posting must add to be looked at; and the documents that were tried for it."""
    strong = weighted.where(F.col("place") <= SEED_TERMS).select("term", "level").distinct()
    number = SEED_POSTINGS * top_k
    tried = index.blocks.join(strong, ["term", "level"]).select("term", F.explode(F.slice("held", 1, number)).alias("p"))
    order = Window.partitionBy("term").orderBy(F.col("p.impact").desc(), "p.doc_id")
    tried = tried.withColumn("r", F.row_number().over(order)).where(F.col("r") <= number)
    seeds = stored(tried.select("p.doc_id").distinct())
    best = best_documents(index.postings, index.average, weighted, top_k, seeds)
    floor = best.where(F.col("rank") == top_k).select("query_id", (F.col("score") - SLACK).alias("floor"))
    needed = weighted.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    needed = needed.select("query_id", "term", _bucket(F.col("term")).alias("bucket"), "w", (F.col("floor") - F.col("rest")).alias("least"))
    return stored(needed), seeds


def candidate_pairs(index: KeywordIndex, weighted: DataFrame, top_k: int) -> DataFrame:
    """``query_id, doc_id`` of every document that may be among the first ``top_k`` of a query."""
    needed, _ = _needed(index, weighted, top_k)
    kept = index.blocks.join(needed, ["bucket", "term"]).where(F.col("w") * F.col("best") >= F.col("least"))
    good = F.filter("held", lambda p: F.col("w") * p["impact"] >= F.col("least"))
    return kept.select("query_id", F.explode(good).alias("p")).select("query_id", "p.doc_id").distinct()


def candidate_documents(index: KeywordIndex, weighted: DataFrame, top_k: int) -> DataFrame:
    """``doc_id`` of every document that may be among the first ``top_k`` of any query."""
    needed, seeds = _needed(index, weighted, top_k)
    # a block is opened once for all queries that have its term
    least = needed.groupBy("bucket", "term").agg(F.min(F.col("least") / F.col("w")).alias("least"))
    kept = index.blocks.join(least, ["bucket", "term"]).where(F.col("best") >= F.col("least"))
    good = F.filter("held", lambda p: p["impact"] >= F.col("least"))
    return kept.select(F.explode(good).alias("p")).select("p.doc_id").union(seeds).distinct()


def search_blocks(index: KeywordIndex, queries: DataFrame, top_k: int, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """``query_id, item_id, score, rank`` for all queries at once; the same rows as scoring every document that
    shares a word. Repeated query terms add up. A document that one query needs is scored for all of them."""
    weighted = stored(_weighted(index, queries, query_id, query_text))
    return best_documents(index.postings, index.average, weighted, top_k, candidate_documents(index, weighted, top_k))


def search_cost(index: KeywordIndex, queries: DataFrame, top_k: int, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """One row: pairs of queries and documents that the bounds leave, and that share a word."""
    weighted = stored(_weighted(index, queries, query_id, query_text))
    scored = candidate_pairs(index, weighted, top_k).agg(F.count("*").alias("pairs_scored"))
    shared = index.postings.join(weighted.select("query_id", "term"), "term").select("query_id", "doc_id").distinct()
    return scored.crossJoin(shared.agg(F.count("*").alias("pairs_sharing_a_word")))  # one row each
