"""Fitted linear and tree models as plain arrays, for scoring many variants of a row inside one task."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tablewise.plans.shape import remove_path, shared_folder

#: Rows times trees that are walked at once.
WALK_CELLS = 1 << 20


@dataclass
class FittedArrays:
    """A sum of linear terms or of trees, and how the sum becomes a prediction.

    ``link``: ``value`` (the sum itself), ``votes`` (shares of the sums), ``logistic`` and ``boosted``
    (one margin), ``softmax`` (one margin a class) or ``one_by_one`` (one boosted margin a class).
    Tree nodes lie in one table; ``first`` has the root of each tree, leaves point to themselves.
    """

    link: str
    outputs: int
    weights: np.ndarray | None = None
    intercept: np.ndarray | None = None
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def uses(self, entries: Sequence[int]) -> np.ndarray:
        """Numbers of the trees that split on any of the entries."""
        inner = np.flatnonzero(self.left != np.arange(len(self.left)))
        hit = inner[np.isin(self.feature[inner], list(entries))]
        return np.unique(np.searchsorted(self.first, hit, "right") - 1)

    def reached(self, x: np.ndarray, trees: np.ndarray | None = None, depth: int | None = None) -> np.ndarray:
        """Node that each row reaches in each tree (row, tree), at most ``depth`` splits down."""
        roots = self.first if trees is None else self.first[trees]
        out = np.empty((len(x), len(roots)), np.int64)
        step = max(1, WALK_CELLS // max(1, len(roots)))
        for begin in range(0, len(x), step):
            part = x[begin : begin + step]
            node = np.tile(roots, len(part))
            row = np.repeat(np.arange(len(part)), len(roots))
            live, level = np.flatnonzero(self.left[node] != node), 0
            while len(live) and (depth is None or level < depth):
                at = node[live]
                low = part[row[live], self.feature[at]] <= self.threshold[at]
                node[live] = at = np.where(low, self.left[at], self.right[at])
                live, level = live[self.left[at] != at], level + 1
            out[begin : begin + step] = node.reshape(len(part), len(roots))
        return out

    def raw(self, x: np.ndarray, trees: np.ndarray | None = None) -> np.ndarray:
        """Sums (row, output); with ``trees`` of those alone."""
        if self.weights is not None:
            return x @ self.weights + self.intercept
        if trees is not None and not len(trees):
            return np.zeros((len(x), self.outputs))
        out = np.empty((len(x), self.outputs))
        step = max(1, WALK_CELLS // max(1, len(self.first) if trees is None else len(trees)))
        for begin in range(0, len(x), step):
            out[begin : begin + step] = self.value[self.reached(x[begin : begin + step], trees)].sum(1)
        return out

    def change(self, x: np.ndarray, new: np.ndarray, entries: Sequence[int], trees: np.ndarray) -> np.ndarray:
        """How the sums change when some entries of ``x`` become those of ``new``; ``trees`` = ``uses(entries)``."""
        if self.weights is not None:
            at = list(entries)
            return (new[:, at] - x[:, at]) @ self.weights[at]
        return self.raw(new, trees) - self.raw(x, trees)

    def probabilities(self, raw: np.ndarray) -> np.ndarray:
        if self.link == "votes":
            whole = raw.sum(1, keepdims=True)
            return np.divide(raw, whole, out=np.zeros_like(raw), where=whole != 0)
        if self.link == "softmax":
            power = np.exp(raw - raw.max(1, keepdims=True))
            return power / power.sum(1, keepdims=True)
        one = 1 / (1 + np.exp(-raw * (1 if self.link == "logistic" else 2)))
        if self.link == "one_by_one":
            return one / one.sum(1, keepdims=True)
        return np.concatenate([1 - one, one], 1)


def _nodes(model):
    """(tree, node, prediction, counts, left, right, feature, threshold) of every node, in order.

    The model's own files are read back: a model lies on the driver as a whole anyway.
    """
    # threads of side-by-side fits have no active session of their own
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    path = f"{shared_folder(spark)}/tablewise-model-{uuid.uuid4().hex}"
    model.write().save(path)
    table = spark.read.parquet(f"{path}/data")
    if "nodeData" in table.columns:
        table = table.select("treeID", "nodeData.*")
    else:
        table = table.withColumn("treeID", F.lit(0))
    rows = table.select(
        "treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild", "split.featureIndex",
        F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"), "split.numCategories",
    ).orderBy("treeID", "id").toPandas()
    remove_path(spark, path)
    if (rows["numCategories"] >= 0).any():
        raise ValueError("splits on categories are not known here")
    return rows


def _trees(rows, values: np.ndarray, link: str) -> FittedArrays:
    tree, node = rows["treeID"].to_numpy(np.int64), rows["id"].to_numpy(np.int64)
    first = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
    base = first[np.searchsorted(tree[first], tree)]
    if not np.array_equal(base + node, np.arange(len(tree))):
        raise ValueError("nodes are not numbered from 0")
    left, right = rows["leftChild"].to_numpy(np.int64), rows["rightChild"].to_numpy(np.int64)
    here, leaf = np.arange(len(tree)), rows["leftChild"].to_numpy(np.int64) < 0
    return FittedArrays(
        link, values.shape[1], first=first, feature=np.where(leaf, 0, rows["featureIndex"].to_numpy(np.int64)),
        threshold=np.where(leaf, 0.0, rows["threshold"].to_numpy(np.float64)),
        left=np.where(leaf, here, base + left), right=np.where(leaf, here, base + right), value=values,
    )


def _shares(rows) -> np.ndarray:
    counts = np.stack(rows["impurityStats"].to_numpy())
    whole = counts.sum(1, keepdims=True)
    return np.divide(counts, whole, out=np.zeros_like(counts), where=whole != 0)


def arrays_of(model) -> FittedArrays | None:
    """Arrays of a fitted Spark model; None for a model of another kind."""
    kind = type(model).__name__
    if kind == "LinearRegressionModel":
        return FittedArrays("value", 1, model.coefficients.toArray()[:, None], np.array([model.intercept]))
    if kind == "LogisticRegressionModel":
        weights, intercept = model.coefficientMatrix.toArray().T, model.interceptVector.toArray()
        return FittedArrays("logistic" if weights.shape[1] == 1 else "softmax", weights.shape[1], weights, intercept)
    if kind in ("DecisionTreeRegressionModel", "RandomForestRegressionModel"):
        rows = _nodes(model)
        return _trees(rows, rows["prediction"].to_numpy(np.float64)[:, None] / rows["treeID"].nunique(), "value")
    if kind in ("DecisionTreeClassificationModel", "RandomForestClassificationModel"):
        rows = _nodes(model)
        return _trees(rows, _shares(rows), "votes")
    if kind in ("GBTRegressionModel", "GBTClassificationModel"):
        rows = _nodes(model)
        weights = np.array(model.treeWeights)[rows["treeID"].to_numpy(np.int64)]
        values = (rows["prediction"].to_numpy(np.float64) * weights)[:, None]
        return _trees(rows, values, "value" if kind == "GBTRegressionModel" else "boosted")
    if kind == "OneVsRestModel":
        parts = [arrays_of(m) for m in model.models]
        if any(p is None or p.link != "boosted" for p in parts):
            return None
        shift = np.cumsum([0, *[len(p.left) for p in parts]])
        columns = [np.zeros((len(p.value), len(parts))) for p in parts]
        for k, p in enumerate(parts):
            columns[k][:, k] = p.value[:, 0]
        join = lambda name, add=False: np.concatenate([getattr(p, name) + (s if add else 0) for p, s in zip(parts, shift)])
        return FittedArrays(
            "one_by_one", len(parts), first=join("first", True), feature=join("feature"), threshold=join("threshold"),
            left=join("left", True), right=join("right", True), value=np.concatenate(columns),
        )
    return None
