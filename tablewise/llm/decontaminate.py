"""Benchmark decontamination with SimHash windows of the size of each item.

Every window of a document that has as many words as a benchmark item may be a copy of it. A window
with a weighted shingle similarity of t shares at least 2t / (1 + t) of its shingles with the item, so
runs of known shingles tell which windows are worth a fingerprint. Fingerprints are looked up in a
multi-index: eight blocks of eight bits, each listing the items whose block is within radius // 8 bits,
finds every item within the radius. What it finds is verified exactly.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.batches import LOWER, WHITE, coded, documents, pieces, slices, spread_indices
from tablewise.llm.simhash import majority, shingle_hashes
from tablewise.plans.shape import spread

WIDTH = 5
THRESHOLD = 0.8
#: Two thirds more than the 14 bits by which windows of similarity 0.8 differ at two deviations.
RADIUS = 23
#: Benchmark texts that one pass over the documents looks for.
BLOCK_BYTES = 4 << 20
MATCH_SCHEMA = "doc_id long, item_id long, first_word int, n_words int, hamming int, similarity double"


class Items:
    """Benchmark items of one pass: vocabulary, shingles and the multi-index, by item length."""

    def __init__(self, rows: list[tuple[int, str]], width: int, threshold: float, radius: int):
        self.width, self.threshold, self.radius = width, threshold, radius
        self.vocabulary: dict[bytes, int] = {}
        self.by_length: dict[int, list[tuple[int, int, Counter]]] = defaultdict(list)
        grams: dict[int, set] = defaultdict(set)
        of_length: dict[int, set] = defaultdict(set)
        for item_id, text in rows:
            words = (text or "").encode().lower().split()
            if not words:
                continue
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            k = min(width, len(words))
            shingles = [tuple(codes[i : i + k]) for i in range(len(codes) - k + 1)]
            grams[k].update(shingles)
            of_length[len(words)].update(shingles)
            self.by_length[len(words)].append((item_id, majority(shingle_hashes(words, width)), Counter(shingles)))
        self.keys = {k: np.unique(self.mix(np.array(sorted(g), np.uint64).T)) for k, g in grams.items()}
        # which shingles the items of each length have
        self.known = {
            length: np.isin(self.keys[min(width, length)], self.mix(np.array(sorted(g), np.uint64).T))
            for length, g in of_length.items()
        }
        near = [[v ^ m for m in self._flips(radius // 8)] for v in range(256)]
        self.index: dict[int, list[list[list[int]]]] = {}
        for length, items in self.by_length.items():
            tables = [[[] for _ in range(256)] for _ in range(8)]
            for n, (_, print_, _) in enumerate(items):
                for block in range(8):
                    for value in near[print_ >> 8 * block & 255]:
                        tables[block][value].append(n)
            self.index[length] = tables
        self.seen: dict[bytes, list] = {}

    @staticmethod
    def _flips(radius: int) -> list[int]:
        return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(8), r)]

    @staticmethod
    def mix(columns) -> np.ndarray:
        """One number for each row of word codes; equal rows have equal numbers."""
        key = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            key = (key ^ c) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key

    def least_shared(self, length: int) -> int:
        n = length - min(self.width, length) + 1
        return math.ceil(2 * self.threshold * n / (1 + self.threshold) - 1e-9)

    def verify(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(item, differing bits, similarity) of the items that a window of words is a copy of."""
        text = b" ".join(words)
        if text in self.seen:
            return self.seen[text]
        length = len(words)
        print_ = majority(shingle_hashes(words, self.width))
        tables, items = self.index[length], self.by_length[length]
        maybe = {n for block in range(8) for n in tables[block][print_ >> 8 * block & 255]}
        codes = [self.vocabulary.get(w, 0) for w in words]
        k = min(self.width, length)
        own = Counter(tuple(codes[i : i + k]) for i in range(length - k + 1))
        out, total = [], length - k + 1
        for n in sorted(maybe):
            item_id, other, shingles = items[n]
            differ = (print_ ^ other).bit_count()
            if differ > self.radius:
                continue
            shared = sum(min(c, own[s]) for s, c in shingles.items())
            similarity = shared / (2 * total - shared)
            if similarity >= self.threshold:
                out.append((item_id, differ, similarity))
        if len(self.seen) > 20_000:
            self.seen.clear()
        self.seen[text] = out
        return out

    def _hits(self, codes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a known shingle of k words begins, and its index."""
        n = len(codes) - k + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = codes[:n] > 0
        for j in range(1, k):
            known &= codes[j : n + j] > 0
        at = np.flatnonzero(known)
        at = at[doc[at] == doc[at + k - 1]]
        keys = self.mix([codes[at + j].astype(np.uint64) for j in range(k)])
        spot = np.minimum(np.searchsorted(self.keys[k], keys), len(self.keys[k]) - 1)
        there = self.keys[k][spot] == keys
        return at[there], spot[there]

    def matches(self, raw: np.ndarray, at: np.ndarray):
        """Yield (row, item, first word, words, differing bits, similarity): the best window of each
        row and item, the first one among equals."""
        if not self.by_length:
            return
        words, first = pieces(LOWER[raw], at, WHITE)
        index, distinct = coded(words)
        if not len(index):
            return
        known = np.array([self.vocabulary.get(w, 0) for w in distinct.to_pylist()], np.int64)
        codes = known[index]
        doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
        hits = {k: self._hits(codes, doc, k) for k in self.keys}
        best: dict[tuple[int, int], tuple] = {}
        for length in sorted(self.by_length):
            k, least = min(self.width, length), self.least_shared(length)
            n = length - k + 1
            place, which = hits[k]
            place = place[self.known[length][which]]
            if len(place) < least:
                continue
            # windows that begin so that ``least`` hits in a row lie inside
            low, high = place[least - 1 :] - n + 1, place[: len(place) - least + 1]
            fits = low <= high
            start = np.unique(spread_indices(low[fits], (high - low)[fits] + 1))
            start = start[(start >= 0) & (start + length <= len(doc))]
            start = start[doc[start] == doc[start + length - 1]]
            for s in start.tolist():
                row = int(doc[s])
                for item, differ, similarity in self.verify(words.slice(s, length).to_pylist()):
                    found = (-similarity, int(s - first[row]), length, differ)
                    if (row, item) not in best or found < best[row, item]:
                        best[row, item] = found
        for (row, item), (similarity, begin, length, differ) in sorted(best.items()):
            yield row, item, begin, length, differ, -similarity


def item_blocks(benchmark: DataFrame, width: int, threshold: float, radius: int, id_col: str, text_col: str):
    """The benchmark as blocks of bounded size, one pass over the documents for each."""
    items = documents(benchmark, id_col, text_col)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for block in range(blocks):
        here = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) == block)
        yield Items([tuple(r) for r in here.collect()], width, threshold, radius)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, width=WIDTH, threshold=THRESHOLD, radius=RADIUS, id_col="doc_id",
    text_col="text", item_col="item_id", item_text_col="text",
) -> DataFrame:
    """``doc_id, item_id, first_word, n_words, hamming, similarity``: the best window per row and item.

    Words are cut at white space and compared in ASCII lower case. Items or texts without words match
    nothing; an item of fewer than ``width`` words is one shingle. Repeated rows are found each; a
    null key stays null.
    """
    plain, out = spread(documents(docs, id_col, text_col)), None
    for items in item_blocks(benchmark, width, threshold, radius, item_col, item_text_col):

        def run(batches, items=items):
            for rows, raw, at in slices(batches):
                found = list(items.matches(raw, at))
                if not found:
                    continue
                row, item, begin, length, differ, similarity = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id").take(pa.array(row)),
                        pa.array(item, pa.int64()),
                        pa.array(begin, pa.int32()),
                        pa.array(length, pa.int32()),
                        pa.array(differ, pa.int32()),
                        pa.array(similarity, pa.float64()),
                    ],
                    ["doc_id", "item_id", "first_word", "n_words", "hamming", "similarity"],
                )

        found = plain.mapInArrow(run, MATCH_SCHEMA)
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, width=WIDTH, threshold=THRESHOLD, radius=RADIUS, text_col="text",
    item_col="item_id", item_text_col="text",
) -> DataFrame:
    """The rows of ``docs`` that hold no copy of an item, with all their columns."""
    for items in item_blocks(benchmark, width, threshold, radius, item_col, item_text_col):

        def run(batches, items=items):
            for rows, raw, at in slices(batches, text_col):
                bad = np.zeros(rows.num_rows, bool)
                bad[[m[0] for m in items.matches(raw, at)]] = True
                yield rows.filter(pa.array(~bad))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
