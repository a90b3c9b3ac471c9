"""Best-fit decreasing packing of token pieces into windows of fixed size.

Every document is first cut into full windows and a rest. Pieces of one length are alike, so best-fit
decreasing needs no more than how many there are of each length (at most ``window`` numbers): a
segment tree over the remaining capacity finds the tightest open windows, and a run of alike windows
takes a run of alike pieces in one step. The result is a short list of rules; Spark then numbers the
pieces of each length and reads off window and offset, for any number of pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.batches import documents, slices
from tablewise.llm.tokens import encoder, with_end
from tablewise.plans.shape import spread, stored


class CapacityTree:
    """Segment tree over capacities 0 to ``top``: the least capacity of at least x that is in use."""

    def __init__(self, top: int):
        self.leaves = 1 << int(top).bit_length()
        self.used = [0] * (2 * self.leaves)

    def set(self, capacity: int, used: bool) -> None:
        node = self.leaves + capacity
        self.used[node] = int(used)
        while node > 1:
            node //= 2
            self.used[node] = self.used[2 * node] | self.used[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        node = self.leaves + least
        if self.used[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.used[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.used[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_rules(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rules (length, first rank, end rank, first window, pieces per window, offset of the first).

    Pieces are taken longest first; each goes to the open window with the least room that holds it,
    and only if there is none a new window is opened. A window that is the tightest stays so until
    the length no longer fits, so it takes as many pieces of that length as it has room for.
    """
    tree, open_runs, rules, windows = CapacityTree(window), {}, [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_runs.setdefault(capacity, []).append((first, n))
            tree.set(capacity, True)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        if not 0 < length <= window:
            raise ValueError(f"a piece of {length} does not fit {window}")
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                fresh = -(-left // (window // length))
                put(window, windows, fresh)
                windows += fresh
                continue
            first, n = open_runs[capacity].pop()
            if not open_runs[capacity]:
                tree.set(capacity, False)
            each, offset = capacity // length, window - capacity
            full = min(n, left // each)
            if full:
                rules.append((length, rank, rank + full * each, first, each, offset))
                put(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                rules.append((length, rank, rank + left, first + full, left, offset))
                put(capacity - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            put(capacity, first + full, n - full)
    return rules


PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, part int, rank_in_part long"


def _pieces(path: str, end: int, window: int):
    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for rows, raw, at in slices(batches):
            ids, offsets = with_end(*encoder(path).encode(raw, at), end)
            tokens = np.diff(offsets)
            n = -(-tokens // window)
            doc = np.repeat(np.arange(len(tokens)), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
            length = np.minimum(window, tokens[doc] - start)
            # the how-manieth piece of its length in this task
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))[: len(ranked)]
            sizes = np.diff(np.append(heads, len(ranked)))
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.repeat(heads, sizes) + seen[ranked]
            seen[ranked[heads]] += sizes
            begin = (offsets[:-1][doc] + start) * 4
            # cuts follow each other without gaps, so their ids are one buffer with offsets
            data = pa.Array.from_buffers(
                pa.binary(),
                len(doc),
                [None, pa.py_buffer(np.append(begin, 4 * len(ids)).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").take(pa.array(doc)),
                    pa.array(start),
                    pa.array(length),
                    data,
                    pa.array(tokens[doc]),
                    pa.array(np.full(len(doc), part, np.int32)),
                    pa.array(rank),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "part", "rank_in_part"],
            )

    return run


def cut_pieces(docs: DataFrame, tokenizer: str, end: int, window: int, id_col="doc_id", text_col="text") -> DataFrame:
    """Pieces of every document with their ids (little-endian u32) and their rank among the pieces
    of equal length in the same task. An empty or null text is one piece, its end id."""
    plain = spread(documents(docs, id_col, text_col))
    return plain.mapInArrow(_pieces(tokenizer, end, window), PIECE_SCHEMA)


def place(pieces: DataFrame, window: int) -> DataFrame:
    """Add ``sequence_id, offset`` to a *stored* table of pieces (``length, part, rank_in_part``)."""
    spark = pieces.sparkSession
    per_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = stored(
        per_part.select("length", "part", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    # At most ``window`` lengths reach the driver, and a bounded list of rules goes back.
    counts = {int(r["length"]): int(r["n"]) for r in begins.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rules = spark.createDataFrame(
        best_fit_rules(counts, window) or [],
        "length long, first_rank long, end_rank long, first_window long, each long, base long",
    )
    by_length = rules.groupBy("length").agg(
        F.collect_list(F.struct("first_rank", "end_rank", "first_window", "each", "base")).alias("_rules")
    )
    ranked = pieces.join(begins.drop("_n"), ["length", "part"]).withColumn(
        "_rank", F.col("_before") + F.col("rank_in_part")
    )
    found = ranked.join(F.broadcast(by_length), "length").withColumn(
        "_rule", F.filter("_rules", lambda r: (r.first_rank <= F.col("_rank")) & (F.col("_rank") < r.end_rank))[0]
    )
    within = F.col("_rank") - F.col("_rule.first_rank")
    return found.select(
        *[c for c in pieces.columns if c not in ("part", "rank_in_part")],
        (F.col("_rule.first_window") + F.floor(within / F.col("_rule.each"))).cast("long").alias("sequence_id"),
        (F.col("_rule.base") + (within % F.col("_rule.each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, end: int = 1, window: int = 2048, keep_ids: bool = True, id_col="doc_id", text_col="text"
) -> DataFrame:
    """Pack every document: ``doc_id, start, length, [ids,] ids_crc32, doc_tokens, sequence_id, offset``.

    Rows with equal or null keys are packed as documents of their own. ``keep_ids=False`` leaves only
    the checksum of each piece's ids.
    """
    pieces = cut_pieces(docs, tokenizer, end, window, id_col, text_col).withColumn("ids_crc32", F.crc32("ids"))
    placed = place(stored(pieces if keep_ids else pieces.drop("ids")), window)
    columns = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.select(*[c for c in columns if c in placed.columns])
