"""Regression forests grown from sums over equal binned inputs: rows are read once, whatever the number of trees and levels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.plans.ensembles import FittedArrays
from tablewise.plans.jobs import list_matrix

#: As in Spark's trees: bins of an input, and rows whose values propose where bins end.
BINS, EDGE_ROWS = 32, 10_000
#: Cells (different rows of bins) of a forest that is grown from sums; a task holds three sums for each of them and each tree.
CELLS = 4_096
#: Rows that draw their counts at once.
DRAW_ROWS = 1 << 16


def bin_edges(sample: np.ndarray) -> list[np.ndarray]:
    """Thresholds of every input, halfway between values: all of them where values are few, else at even shares of rows."""
    edges = []
    for column in sample.T:
        values, counts = np.unique(column, return_counts=True)
        middle = (values[:-1] + values[1:]) / 2
        if len(middle) >= BINS:
            ends = np.searchsorted(np.cumsum(counts), len(column) / BINS * np.arange(1, BINS))
            middle = middle[np.unique(np.minimum(ends, len(middle) - 1))]
        edges.append(middle)
    return edges


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.searchsorted(e, x[:, i])  # a value on a threshold goes left
    return out


def grow(cells: np.ndarray, sums: np.ndarray, depth: int, leaf: int, rng: np.random.Generator) -> list[tuple]:
    """(feature, bin, left, right, mean) of every node of a tree, level by level; ``sums``: rows, label and squared label of each
    cell. Leaves point to themselves."""
    nodes: list[list] = []
    width, n_inputs = BINS, cells.shape[1]
    live = [np.flatnonzero(sums[0] > 0)]
    nodes.append([0, 0, 0, 0, 0.0])
    first = 0
    for level in range(depth + 1):
        following: list[np.ndarray] = []
        for k, rows in enumerate(live):
            at = first + k
            n, s, q = sums[:, rows].sum(1)
            nodes[at] = [0, 0, at, at, s / n if n else 0.0]
            spread = q - s * s / n if n else 0.0
            if level == depth or len(rows) < 2 or spread <= 1e-12 * q:
                continue
            tried = np.sort(rng.choice(n_inputs, math.ceil(n_inputs / 3), replace=False))
            flat = (cells[np.ix_(rows, tried)] + width * np.arange(len(tried))).ravel()
            low_n, low_s = (
                np.bincount(flat, np.repeat(w[rows], len(tried)), width * len(tried)).reshape(len(tried), width).cumsum(1) for w in sums[:2]
            )
            high_n, high_s = n - low_n, s - low_s
            fits = (low_n >= leaf) & (high_n >= leaf)
            gain = np.where(fits, low_s**2 / np.maximum(low_n, 1) + high_s**2 / np.maximum(high_n, 1) - s * s / n, -1.0)
            best = int(gain.argmax())
            if gain.flat[best] <= 1e-12 * spread:
                continue
            feature, bin_ = int(tried[best // width]), best % width
            left = cells[rows, feature] <= bin_
            child = first + len(live) + len(following)
            nodes[at] = [feature, bin_, child, child + 1, s / n]
            following += [rows[left], rows[~left]]
        first += len(live)
        nodes += [[0, 0, 0, 0, 0.0] for _ in following]
        live = following
    return [tuple(x) for x in nodes]


def regression_forest(rows: DataFrame, n: int, trees: int, depth: int, leaf: int, seed: int) -> FittedArrays | None:
    """A forest over ``_label, _features``: every tree learns from a Poisson(1) number of copies of each row and tries a random
    third of the inputs at each split. None where the rows lie in more than ``CELLS`` cells.

    Tasks draw each row's copies once for each tree and add them up by cell; a tree is grown from the sums of its cells.
    """
    spark = rows.sparkSession
    x = rows.select(vector_to_array("_features").alias("_x"), "_label")
    share = min(1.0, max(EDGE_ROWS, BINS * BINS) / max(n, 1))
    sample = x.sample(share, seed).select("_x").toArrow().column("_x").combine_chunks()
    if not len(sample):
        return None
    edges = bin_edges(list_matrix(sample))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            found = {r.tobytes() for r in np.unique(binned(list_matrix(batch.column("_x")), edges), axis=0)} - seen
            seen |= found
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], ["cell"])
            if len(seen) > CELLS:  # too many already
                return

    found = x.select("_x").mapInArrow(places, "cell binary").distinct().limit(CELLS + 1).collect()
    if len(found) > CELLS:
        return None
    keys = sorted(bytes(r["cell"]) for r in found)
    cells = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1).astype(np.int64)
    mean = float(x.agg(F.avg("_label")).first()[0])  # sums stay small

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {k: i for i, k in enumerate(keys)}
        total = np.zeros((trees, 3, len(keys)))
        rngs = [np.random.default_rng([seed, t, TaskContext.get().partitionId()]) for t in range(trees)]
        for batch in batches:
            every, labels = list_matrix(batch.column("_x")), batch.column("_label").to_numpy(zero_copy_only=False) - mean
            for begin in range(0, len(labels), DRAW_ROWS):
                y = labels[begin : begin + DRAW_ROWS]
                own, inverse = np.unique(binned(every[begin : begin + DRAW_ROWS], edges), axis=0, return_inverse=True)
                at = np.array([place[r.tobytes()] for r in own])[inverse.reshape(-1)]
                for t in range(trees):
                    copies = rngs[t].poisson(1.0, len(y)).astype(float)
                    for j, w in enumerate((copies, copies * y, copies * y * y)):
                        total[t, j] += np.bincount(at, w, len(keys))
        for t in range(trees):
            yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "sums": pa.array([total[t].ravel()], pa.list_(pa.float64()))})

    def tree(table: pa.Table) -> pa.Table:
        t = table.column("tree")[0].as_py()
        whole = list_matrix(table.column("sums").combine_chunks()).sum(0).reshape(3, -1)
        nodes = grow(cells, whole, depth, leaf, np.random.default_rng([seed, t]))
        feature, bin_, left, right, value = zip(*nodes)
        limit = [float(edges[f][b]) if left[i] != i else 0.0 for i, (f, b) in enumerate(zip(feature, bin_))]
        names = ["tree", "feature", "threshold", "left", "right", "value"]
        return pa.table([pa.array([t] * len(nodes), pa.int32()), *map(pa.array, (feature, limit, left, right, value))], names)

    grown = (
        x.mapInArrow(sums, "tree int, sums array<double>").groupBy("tree")
        .applyInArrow(tree, "tree int, feature long, threshold double, left long, right long, value double")
    )
    parts = {}
    for r in grown.collect():  # a fitted model; the rows of a tree stay in order
        parts.setdefault(r["tree"], []).append(r)
    sizes = [len(parts[t]) for t in range(trees)]
    first = np.cumsum([0, *sizes[:-1]])
    joined = [r for t in range(trees) for r in parts[t]]
    base = np.repeat(first, sizes)
    column = lambda name, kind: np.array([r[name] for r in joined], kind)
    return FittedArrays(
        "value", 1, first=first, feature=column("feature", np.int64), threshold=column("threshold", np.float64),
        left=base + column("left", np.int64), right=base + column("right", np.int64),
        value=(column("value", np.float64) + mean)[:, None] / trees,
    )
