"""Supervised training on Spark ML: preprocessing as SQL expressions, then an estimator."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import as_double, as_text, half_up, kinds, ref, require_between, require_columns
from tablewise.operators import drift, evaluate, features, scoring
from tablewise.operators.neighbours import Neighbours
from tablewise.plans.ensembles import FittedArrays, arrays_of
from tablewise.plans.forests import regression_forest
from tablewise.plans.jobs import list_matrix, side_by_side
from tablewise.plans.nearest import nearest
from tablewise.plans.ordering import row_index
from tablewise.plans.shape import discard, stored

# Fixed rules.
LAG_MIN_ROWS = 50
INTERACTION_MIN_COLS, INTERACTION_MIN_ROWS = 3, 200
AUTO_MIN_ROWS, TUNE_MIN_ROWS, CALIBRATE_MIN_ROWS = 30, 50, 100
TUNE_DRAWS, TUNE_FOLDS, CALIBRATE_FOLDS, AUTO_FOLDS = 10, 3, 3, 3
SMOTE_MIN_MINORITY, SMOTE_NEIGHBOURS = 6, 5
# Rows of a partition that candidates are fitted on, at least, and partitions for each core, at most.
FIT_ROWS, FIT_TASKS = 20_000, 3
# Places in trees (rows times trees) that a fit remembers; beyond it, rows walk from the root at every level.
CACHED_PLACES = 1 << 27
# Imbalance that a model family bears: those that take no class weights bear less.
SMOTE_RATIO = 10
SMOTE_LIMITS = {"gradient_boosting": 5, "knn": 5}
KNN_K = 5
IMPORTANCE_TOP = 15
TEXT_DIMS = 64
SEED = 42
FAMILIES = ("random_forest", "gradient_boosting", "decision_tree", "knn", "xgboost", "lightgbm")
BOOSTED = ("gradient_boosting", "xgboost", "lightgbm")
AUTO = {
    "classification": ("logistic_regression", "random_forest", "gradient_boosting"),
    "regression": ("ridge_regression", "random_forest", "gradient_boosting"),
}
GRIDS = {
    # A depth of 30 is Spark's deepest and stands for trees without a limit.
    "random_forest": {"trees": [100, 200, 300], "depth": [6, 12, 20, 30], "leaf": [1, 2, 4]},
    "gradient_boosting": {"trees": [100, 200], "depth": [3, 5, 7], "step": [0.05, 0.1, 0.2]},
}


@dataclass
class Trained:
    """A fitted pipeline and everything stored beside it."""

    pipeline: PipelineModel
    task_type: str
    model_type: str
    target_col: str
    feature_cols: list[str]
    labels: list[str] = field(default_factory=list)
    model_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    dataset_id: str | None = None
    created_at: float = field(default_factory=time.time)
    log_target: bool = False
    lag_config: dict | None = None
    optimal_threshold: float | None = None
    conformal_halfwidth: float | None = None
    conformal_q: float | None = None
    platt: list[float] | None = None
    evaluation: dict = field(default_factory=dict)
    baselines: list[dict] = field(default_factory=list)
    comparison: dict = field(default_factory=dict)
    training_stats: list[dict] = field(default_factory=list)
    fingerprint: list[dict] = field(default_factory=list)
    leakage: list[dict] = field(default_factory=list)
    feature_names: list[str] = field(default_factory=list)
    terms: list[dict] = field(default_factory=list)  # columns, scale and parts of each input
    best_params: dict | None = None
    cross_validation: dict | None = None
    is_champion: bool = False

    def meta(self) -> dict:
        return {k: v for k, v in asdict_without_pipeline(self).items()}


def asdict_without_pipeline(t: Trained) -> dict:
    held, t.pipeline = t.pipeline, None
    try:
        return {k: v for k, v in asdict(t).items() if k != "pipeline"}
    finally:
        t.pipeline = held


# ---- splitting ----


def split_train_test(
    df: DataFrame,
    key: Sequence[str],
    test_size: float = 0.2,
    stratify: str | None = None,
    time_col: str | None = None,
    name: str = "is_test",
) -> DataFrame:
    """Adds a flag: a hashed share (of every class), or the last share by time.

    Exact sizes come from global positions, so no class passes through one task.
    """
    require_between("test_size", test_size, 0.01, 0.99)
    if time_col:
        ranked = row_index(df, [time_col, *key], name="_i")
        n = ranked.count()
        return ranked.withColumn(name, F.col("_i") >= int(n * (1 - test_size))).drop("_i")
    mixed = F.xxhash64(*[ref(k) for k in key], F.lit(SEED))
    rows = df.withColumn("_h", mixed)
    if stratify is None:
        n = df.count()
        return row_index(rows, ["_h", *key], name="_i").withColumn(name, F.col("_i") < math.ceil(n * test_size)).drop("_h", "_i")
    rows = rows.withColumn("_class", as_text(df, stratify))
    sizes = rows.groupBy("_class").agg(F.count("*").alias("_n"))
    ranked = row_index(rows, ["_h", *key], ["_class"], name="_i").join(sizes, "_class")
    return ranked.withColumn(name, F.col("_i") < F.round(F.col("_n") * test_size)).drop("_h", "_i", "_class", "_n")


def fold_column(key: Sequence[str], folds: int) -> Column:
    return F.pmod(F.xxhash64(*[ref(k) for k in key], F.lit(SEED + 1)), F.lit(folds)).cast("int")


def fold_splits(
    df: DataFrame, key: Sequence[str], folds: int, time_col: str | None = None
) -> list[tuple[DataFrame, DataFrame]]:
    """(train, held out) pairs: hashed folds, or expanding windows over time."""
    if time_col:
        ranked = row_index(df, [time_col, *key], name="_i")
        n = ranked.count()
        size = n // (folds + 1)
        starts = [n - (folds - k) * size for k in range(folds)]
        i = F.col("_i")
        return [(ranked.where(i < s).drop("_i"), ranked.where((i >= s) & (i < s + size)).drop("_i")) for s in starts]
    marked = df.withColumn("_fold", fold_column(key, folds))
    return [(marked.where(F.col("_fold") != k).drop("_fold"), marked.where(F.col("_fold") == k).drop("_fold")) for k in range(folds)]


# ---- preprocessing ----


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Term:
    """One model input: its SQL with the fitted constants written in, the raw columns it comes from, and, where it is a
    scaled number or a product of two inputs, the numbers needed to make it anew."""

    sql: str
    columns: tuple[str, ...]
    scale: tuple[float, float, float] | None = None  # fill, mean, deviation
    parts: tuple[str, str] | None = None


def feature_terms(df: DataFrame, roles: dict[str, str], target: str | None, interactions: bool = False) -> dict[str, Term]:
    """Every model input by name."""
    kind = kinds(df)
    by_role: dict[str, list[str]] = {}
    for c, r in roles.items():
        by_role.setdefault(r, []).append(c)
    out: dict[str, Term] = {}

    def number(c: str) -> str:
        inner = f"CAST({_quoted(c)} AS INT)" if kind[c] == "boolean" else _quoted(c)
        return f"nanvl(CAST({inner} AS DOUBLE), CAST(NULL AS DOUBLE))"

    nums, cats = by_role.get("numeric", []), by_role.get("one_hot", [])
    fitted = {r["column"]: r for r in features.fit_impute_scale(df, nums, cats).collect()} if nums or cats else {}
    for c in nums:
        fill, mean, std = (float(x) for x in (fitted[c]["fill"], fitted[c]["mean"], fitted[c]["std"] or 1.0))
        out[c] = Term(f"(coalesce({number(c)}, {fill!r}D) - {mean!r}D) / {std!r}D", (c,), (fill, mean, std))
    if cats:
        for c, levels in features.fit_one_hot(df, cats).items():
            fill = fitted[c]["fill_text"] if c in fitted and fitted[c]["fill_text"] is not None else ""
            for v in levels:
                same = f"coalesce(CAST({_quoted(c)} AS STRING), {_literal(fill)}) = {_literal(v)}"
                out[f"{c}_{v}"] = Term(f"CASE WHEN {same} THEN 1.0D ELSE 0.0D END", (c,))
    for c in by_role.get("target_encoded", []):
        y = as_double(df, target)
        stats = df.where(y.isNotNull()).groupBy(as_text(df, c).alias("v")).agg(F.avg(y).alias("m"), F.count(y).alias("n"), F.var_pop(y).alias("w"))
        whole = df.agg(F.avg(y).alias("m"), F.var_pop(y).alias("v")).first()
        pairs = []
        for r in stats.where("v IS NOT NULL").collect():  # at most TARGET_LEVELS categories
            spread = r["n"] * (whole["v"] or 0.0)
            w = spread / (spread + (r["w"] or 0.0)) if spread else 1.0
            pairs.append(f"{_literal(r['v'])}, {float(w * r['m'] + (1 - w) * whole['m'])!r}D")
        lookup = f"map({', '.join(pairs)})" if pairs else "CAST(map() AS MAP<STRING, DOUBLE>)"
        out[f"{c}__target"] = Term(f"coalesce(try_element_at({lookup}, CAST({_quoted(c)} AS STRING)), {float(whole['m'])!r}D)", (c,))
    dates = by_role.get("datetime", [])
    if dates:
        for c, with_hour in features.fit_datetime_features(df, dates).items():
            ts = _quoted(c) if kind[c] == "datetime" else f"try_to_timestamp({_quoted(c)})"
            parts = {
                "year": f"year({ts})", "month": f"month({ts})", "day": f"day({ts})", "dayofweek": f"weekday({ts})",
                "is_weekend": f"CAST(weekday({ts}) >= 5 AS INT)",
            }
            if with_hour:
                parts["hour"] = f"hour({ts})"
            out.update({f"{c}__{p}": Term(f"CAST(coalesce({e}, 0) AS DOUBLE)", (c,)) for p, e in parts.items()})
    if interactions and len(nums) >= 2:
        for r in features.fit_interactions(df, nums).collect():  # one row per pair of columns
            left, right = r["left"], r["right"]
            out[f"{left} {right}"] = Term(f"({out[left].sql}) * ({out[right].sql})", (left, right), parts=(left, right))
    return out


def preprocessor(rows: DataFrame, terms: dict[str, Term], texts: Sequence[str] = ()) -> tuple[list, dict[str, Term]]:
    """Transformer stages from raw columns to ``_features``, and the terms of all its entries.

    A text column adds the dense vector that ``features.text_vectors`` learns from it; a missing
    text counts as empty.
    """
    inputs = [f"_f{i}" for i in range(len(terms))]
    filled = [f"coalesce(CAST({_quoted(c)} AS STRING), '') AS _text{i}" for i, c in enumerate(texts)]
    body = ", ".join(["*", *[f"{t.sql} AS {n}" for n, t in zip(inputs, terms.values())], *filled])
    stages: list = [SQLTransformer(statement=f"SELECT {body} FROM __THIS__")]
    every = dict(terms)
    if texts:
        ready = stages[0].transform(rows)
        for i, c in enumerate(texts):
            stages.extend(features.text_vectors(ready, f"_text{i}", dims=TEXT_DIMS, name=f"_vector{i}").stages)
            inputs.append(f"_vector{i}")
            every.update({f"{c}__text_{j}": Term("", (c,)) for j in range(TEXT_DIMS)})
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="keep")], every


# ---- estimators ----


def resolve_model_type(name: str) -> str:
    """Family name; task suffixes are dropped and absent boosting libraries map to Spark's."""
    base = name
    for suffix in ("_classifier", "_regressor"):
        base = base.removesuffix(suffix)
    return "gradient_boosting" if base in BOOSTED else base


def estimator(task: str, model_type: str, n: int, n_labels: int = 2, weighted: bool = False, params: dict | None = None):
    """Spark ML estimator equivalent to the named model.

    Regularisation follows from matching objectives: ridge alpha is n * regParam, lasso alpha
    is regParam, and the logistic C is 1 / (n * regParam).
    """
    p = params or {}
    family = resolve_model_type(model_type)
    common = {"featuresCol": "_features", "labelCol": "_label", "predictionCol": "_prediction"}
    cached = {"cacheNodeIds": n * p.get("trees", 200) <= CACHED_PLACES}  # the trees are the same either way
    if task == "classification":
        if weighted and family != "gradient_boosting":
            common["weightCol"] = "_weight"
        if family == "gradient_boosting" and n_labels > 2:
            columns = {"featuresCol": "_features", "labelCol": "_label", "predictionCol": "_prediction"}
            one = GBTClassifier(maxIter=p.get("trees", 100), maxDepth=p.get("depth", 3), stepSize=p.get("step", 0.1), seed=SEED, **columns)
            return OneVsRest(classifier=one.setRawPredictionCol("_raw"), rawPredictionCol="_raw", **columns)
        prob = {"probabilityCol": "_probability", "rawPredictionCol": "_raw"}
        makers: dict[str, Callable] = {
            "logistic_regression": lambda: LogisticRegression(regParam=1.0 / max(n, 1), standardization=False, maxIter=100, **common, **prob),
            "random_forest": lambda: RandomForestClassifier(
                numTrees=p.get("trees", 200), maxDepth=p.get("depth", 12), minInstancesPerNode=p.get("leaf", 1), seed=SEED, **cached, **common, **prob
            ),
            "gradient_boosting": lambda: GBTClassifier(
                maxIter=p.get("trees", 100), maxDepth=p.get("depth", 3), stepSize=p.get("step", 0.1), seed=SEED, **common
            ).setProbabilityCol("_probability").setRawPredictionCol("_raw"),
            "decision_tree": lambda: DecisionTreeClassifier(maxDepth=8, seed=SEED, **common, **prob),
            "knn": lambda: Neighbours(task, n_labels, p.get("k", KNN_K)),
        }
    else:
        linear = {**common, "standardization": False}
        makers = {
            "linear_regression": lambda: LinearRegression(**linear),
            "ridge_regression": lambda: LinearRegression(regParam=1.0 / max(n, 1), **linear),
            "lasso_regression": lambda: LinearRegression(regParam=1.0, elasticNetParam=1.0, **linear),
            "random_forest": lambda: RandomForestRegressor(
                numTrees=p.get("trees", 200), maxDepth=p.get("depth", 12), minInstancesPerNode=p.get("leaf", 1), seed=SEED, **cached, **common
            ),
            "gradient_boosting": lambda: GBTRegressor(maxIter=p.get("trees", 100), maxDepth=p.get("depth", 3), stepSize=p.get("step", 0.1), seed=SEED, **common),
            "decision_tree": lambda: DecisionTreeRegressor(maxDepth=8, seed=SEED, **common),
            "knn": lambda: Neighbours(task, k=p.get("k", KNN_K)),
        }
    if family not in makers:
        raise ValueError(f"model_type must be one of {sorted(makers)} for {task}")
    return makers[family]()


def smote(rows: DataFrame, label: str, vector: str, key: Sequence[str], minority: str, k: int = SMOTE_NEIGHBOURS) -> DataFrame:
    """Minority rows interpolated towards one of their k nearest minority rows until classes balance.

    Returns only the synthetic rows: ``label, vector``.
    """
    counts = {r["l"]: r["n"] for r in rows.groupBy(ref(label).cast("string").alias("l")).agg(F.count("*").alias("n")).collect()}
    have = counts[minority]
    need = max(counts.values()) - have
    few = rows.where(ref(label).cast("string") == minority)
    few = row_index(few.withColumn("_h", F.xxhash64(*[ref(c) for c in key])), ["_h", *key], name="_id")
    k = min(k, have - 1)
    near = nearest(few, few, k, "_id", vector, "_id", vector, metric="euclidean", skip_self=True)
    copies = F.lit(need // have) + (F.col("_id") < need % have).cast("int")
    drawn = (
        few.select("_id", ref(label).alias(label), ref(vector).alias("_v"), copies.alias("_m"))
        .where(F.col("_m") > 0)
        .select("_id", label, "_v", F.explode(F.sequence(F.lit(1), F.col("_m"))).alias("_copy"))
        .withColumn("rank", (F.pmod(F.xxhash64("_id", "_copy"), F.lit(k)) + 1).cast("int"))
        .withColumn("_u", F.pmod(F.xxhash64("_copy", "_id", F.lit(SEED)), F.lit(1_000_003)) / F.lit(1_000_003.0))
    )
    picked = drawn.join(near.select(F.col("query_id").alias("_id"), "item_id", "rank"), ["_id", "rank"])
    other = few.select(F.col("_id").alias("item_id"), ref(vector).alias("_w"))
    return picked.join(other, "item_id").select(
        label, F.zip_with("_v", "_w", lambda a, b: a + F.col("_u") * (b - a)).alias(vector)
    )


def knn_predict(
    train: DataFrame, test: DataFrame, label: str, vector: str, train_id: str, test_id: str, task: str = "classification", k: int = KNN_K
) -> DataFrame:
    """Vote (smallest label on ties) or mean of the k nearest training rows."""
    hits = nearest(train, test, k, train_id, vector, test_id, vector, metric="euclidean")
    known = hits.join(train.select(ref(train_id).alias("item_id"), ref(label).alias("_y")), "item_id")
    if task == "regression":
        return known.groupBy("query_id").agg(F.avg("_y").alias("prediction"))
    votes = known.groupBy("query_id", ref("_y").cast("string").alias("_l")).agg(F.count("*").alias("_n"))
    return votes.groupBy("query_id").agg(F.min_by("_l", F.struct(-F.col("_n"), F.col("_l"))).alias("prediction"))


# ---- fitting ----


def _labelled(df: DataFrame, task: str, target: str, labels: Sequence[str]) -> DataFrame:
    if task == "classification":
        index = F.array_position(F.array(*[F.lit(v) for v in labels]), as_text(df, target)) - 1
        return df.withColumn("_label", index.cast("double")).where("_label >= 0")
    return df.withColumn("_label", as_double(df, target)).where("_label IS NOT NULL")


@dataclass
class Prepared:
    """Fitted preprocessing and what a model learns from: ``_label``, ``_features`` and, for classes, ``_weight``."""

    stages: list
    terms: dict[str, Term]
    ready: DataFrame
    n: int


def prepare(
    train: DataFrame,
    target: str,
    roles: dict[str, str],
    task: str,
    labels: Sequence[str],
    key: Sequence[str],
    interactions: bool = False,
    use_smote: tuple[bool, int] = (False, SMOTE_NEIGHBOURS),
) -> Prepared:
    rows = _labelled(train, task, target, labels)
    terms = feature_terms(train if task == "regression" else rows, roles, target if task == "regression" else "_label", interactions)
    stages, every = preprocessor(rows, terms, [c for c, r in roles.items() if r == "text"])
    ready = rows
    for s in stages:
        ready = s.transform(ready)
    encoded = [c for c, r in roles.items() if r == "target_encoded"]
    if encoded:  # the model learns from cross-fitted encodings, scoring uses the full ones
        y = target if task == "regression" else "_label"
        for c in encoded:
            i = list(terms).index(f"{c}__target")
            ready = features.target_encode(ready.drop(f"_f{i}"), c, y, fold_column(key, 5), name=f"_f{i}")
        ready = stages[-1].transform(ready.drop("_features"))
    if task == "classification":
        weights = {r["label"]: r["weight"] for r in scoring.class_weights(ready, "_label").collect()}
        lookup = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
        ready = ready.withColumn("_weight", lookup[F.col("_label").cast("string")])
    if use_smote[0]:
        flat = ready.select("_label", *[ref(k) for k in key], vector_to_array("_features").alias("_v"))
        counts = {r["l"]: r["n"] for r in flat.groupBy(F.col("_label").cast("string").alias("l")).agg(F.count("*").alias("n")).collect()}
        minority = min(counts, key=lambda v: (counts[v], v))
        made = smote(flat, "_label", "_v", key, minority, use_smote[1])
        ready = flat.select("_label", "_v").unionByName(made).select("_label", array_to_vector("_v").alias("_features"), F.lit(1.0).alias("_weight"))
    return Prepared(stages, every, ready, ready.count())


def fit_prepared(p: Prepared, task: str, model_type: str, labels: Sequence[str], params: dict | None = None):
    return estimator(task, model_type, p.n, len(labels), task == "classification", params).fit(p.ready)


def fit_pipeline(
    train: DataFrame,
    target: str,
    roles: dict[str, str],
    task: str,
    model_type: str,
    labels: Sequence[str],
    key: Sequence[str],
    interactions: bool = False,
    use_smote: tuple[bool, int] = (False, SMOTE_NEIGHBOURS),
    params: dict | None = None,
) -> tuple[PipelineModel, dict[str, Term]]:
    """Fit preprocessing and model on ``train``; returns the pipeline and its inputs."""
    p = prepare(train, target, roles, task, labels, key, interactions, use_smote)
    return PipelineModel(stages=[*p.stages, fit_prepared(p, task, model_type, labels, params)]), p.terms


def _raw_scores(pipeline: PipelineModel, df: DataFrame, task: str) -> DataFrame:
    out = pipeline.transform(df)
    keep = [ref(c) for c in df.columns]
    if task == "classification":
        if "_probability" not in out.columns:  # one booster a class: their chances, shared out
            chances = F.transform(vector_to_array("_raw"), lambda m: 1 / (1 + F.exp(-2 * m)))
            total = F.aggregate(chances, F.lit(0.0), lambda a, v: a + v)
            return out.select(*keep, F.transform(chances, lambda v: v / total).alias("_p"))
        return out.select(*keep, vector_to_array("_probability").alias("_p"))
    return out.select(*keep, F.col("_prediction").alias("_p"))


def predict(model: Trained, df: DataFrame) -> DataFrame:
    """Adds ``prediction``; classifiers also get ``probability`` (array in label order)."""
    out = _raw_scores(model.pipeline, df, model.task_type)
    if model.task_type == "regression":
        value = F.expm1("_p") if model.log_target else F.col("_p")
        return out.withColumn("prediction", value).drop("_p")
    p = F.col("_p")
    if model.platt:
        a, b = model.platt
        one = 1 / (1 + F.exp(-(F.lit(a) * p[1] + F.lit(b))))
        p = F.array(1 - one, one)
    labels = F.array(*[F.lit(v) for v in model.labels])
    out = out.withColumn("probability", p).drop("_p")
    best = F.array_position("probability", F.array_max("probability"))
    return out.withColumn("prediction", F.element_at(labels, best.cast("int")))


def model_arrays(model: Trained) -> FittedArrays | None:
    """The fitted model as arrays, read once; None where it has no such form or its inputs are not known."""
    if "_arrays" not in model.__dict__:
        model._arrays = arrays_of(model.pipeline.stages[-1]) if model.terms else None
    return model._arrays


class ArrayScorer:
    """Scores of input vectors inside a task, and of the vectors that differ from them in one raw column."""

    def __init__(self, model: Trained):
        self.arrays, self.names = model_arrays(model), list(model.feature_names)
        self.log_target, self.platt = model.log_target, model.platt
        self.regression = model.task_type == "regression"
        place = {n: i for i, n in enumerate(self.names)}
        self.products = [(i, *(place[x] for x in t["parts"])) for i, t in enumerate(model.terms) if t["parts"]]
        self.entries: dict[str, list[int]] = {}
        for i, t in enumerate(model.terms):
            for c in t["columns"]:
                self.entries.setdefault(c, []).append(i)
        self.trees = {c: self.arrays.uses(e) if self.arrays.weights is None else None for c, e in self.entries.items()}

    def mixed(self, x: np.ndarray, other: np.ndarray, column: str) -> np.ndarray:
        """``x`` with the inputs made of one raw column taken from ``other``, products made anew."""
        new = x.copy()
        own = self.entries.get(column, [])
        new[:, own] = other[:, own]
        for i, left, right in self.products:
            if i in own:
                new[:, i] = new[:, left] * new[:, right]
        return new

    def changed(self, x: np.ndarray, new: np.ndarray, raw: np.ndarray, column: str) -> np.ndarray:
        """Sums of ``new``, given those of ``x``: only what uses the column is evaluated."""
        own = self.entries.get(column, [])
        return raw + self.arrays.change(x, new, own, self.trees[column]) if own else raw

    def chances(self, raw: np.ndarray) -> np.ndarray:
        p = self.arrays.probabilities(raw)
        if self.platt:
            one = 1 / (1 + np.exp(-(self.platt[0] * p[:, 1] + self.platt[1])))
            p = np.stack([1 - one, one], 1)
        return p

    def value(self, raw: np.ndarray) -> np.ndarray:
        """The prediction, the chance of the second of two classes, or the largest chance."""
        if self.regression:
            return np.expm1(raw[:, 0]) if self.log_target else raw[:, 0]
        p = self.chances(raw)
        return p[:, 1] if p.shape[1] == 2 else p.max(1)


def model_vectors(model: Trained, df: DataFrame, keep: Sequence[Column]) -> DataFrame:
    """``keep..., _x``: the model's inputs as one array a row."""
    for s in model.pipeline.stages[:-1]:
        df = s.transform(df)
    return df.select(*keep, vector_to_array("_features").alias("_x"))


def _score(pipeline: PipelineModel, held: DataFrame, task: str, target: str, labels: Sequence[str], log_target: bool) -> float:
    """Weighted F1, or minus MAPE."""
    probe = Trained(pipeline, task, "", target, [], list(labels), log_target=log_target)
    return _prediction_score(predict(probe, held), target, task, log_target)


def _prediction_score(out: DataFrame, target: str, task: str, log_target: bool) -> float:
    if task == "classification":
        row = evaluate.classification_metrics(out, target, "prediction").first()
        return float(row["f1_weighted"]) if row else 0.0
    actual = F.expm1(as_double(out, target)) if log_target else as_double(out, target)
    row = evaluate.regression_metrics(out.withColumn("_actual", actual), "_actual", "prediction").first()
    return -float(row["mape"]) if row and row["mape"] is not None else -math.inf


@dataclass
class Fold:
    """One fold with its preprocessing fitted: both sides are stored tables that every candidate reads."""

    train: Prepared
    held: DataFrame


def prepared_folds(
    df: DataFrame, target: str, roles: dict[str, str], task: str, key: Sequence[str], folds: int, labels: Sequence[str] = (),
    time_col: str | None = None,
) -> list[Fold]:
    """Folds (expanding windows when a time column is given) with preprocessing fitted once for each."""

    def one(split):
        train, held = split
        p = prepare(train, target, roles, task, labels, key)
        narrow = p.ready.select("_label", "_features", *(["_weight"] if task == "classification" else []))
        # every partition sends the statistics of every node that grows, so small tables keep to few;
        # large ones use all cores, however few files they come from
        cores = df.sparkSession.sparkContext.defaultParallelism
        p.ready = stored(narrow.coalesce(1) if p.n <= FIT_ROWS else narrow.repartition(min(math.ceil(p.n / FIT_ROWS), FIT_TASKS * cores)))
        for s in p.stages:
            held = s.transform(held)
        return Fold(p, stored(held.select(ref(target), "_features")))

    return side_by_side(one, fold_splits(df, key, folds, time_col))


def close_folds(folds: Sequence[Fold]) -> None:
    for f in folds:
        discard(f.train.ready, f.held)


def _summed_forest(fold: Fold, task: str, model_type: str, params: dict | None) -> FittedArrays | None:
    """A regression forest over more rows than one partition's, grown from sums; None for other models and for inputs too varied."""
    if task != "regression" or resolve_model_type(model_type) != "random_forest" or fold.train.n <= FIT_ROWS:
        return None
    p = params or {}
    return regression_forest(fold.train.ready, fold.train.n, p.get("trees", 200), p.get("depth", 12), p.get("leaf", 1), SEED)


def _fold_score(fold: Fold, task: str, model_type: str, target: str, labels: Sequence[str], log_target: bool, params: dict | None) -> float:
    forest = _summed_forest(fold, task, model_type, params)
    if forest is not None:
        return _array_scores(forest, fold, task, model_type, target, labels, log_target, [params or {}])[0]
    model = fit_prepared(fold.train, task, model_type, labels, params)
    return _score(PipelineModel(stages=[model]), fold.held, task, target, labels, log_target)


def cross_validate(
    df: DataFrame,
    target: str,
    roles: dict[str, str],
    task: str,
    model_type: str,
    key: Sequence[str],
    folds: int = 5,
    labels: Sequence[str] = (),
    time_col: str | None = None,
    log_target: bool = False,
    params: dict | None = None,
) -> dict:
    """Mean, deviation and scores over the folds (expanding windows when a time column is given)."""
    ready = prepared_folds(df, target, roles, task, key, folds, labels, time_col)
    scores = side_by_side(lambda f: _fold_score(f, task, model_type, target, labels, log_target, params), ready)
    close_folds(ready)
    return {
        "folds": folds,
        "scoring": "f1_weighted" if task == "classification" else "neg_mean_absolute_percentage_error",
        "mean": half_up(float(np.mean(scores)), 4),
        "std": half_up(float(np.std(scores)), 4),
        "scores": [half_up(s, 4) for s in scores],
    }


def auto_select_model(
    df: DataFrame, target: str, roles: dict[str, str], task: str, key: Sequence[str], labels: Sequence[str] = (),
    log_target: bool = False, params: dict | None = None,
) -> str:
    """Best of the candidate families by three-fold score, all inputs in the race.

    ``params`` (trees, depth, ...) sets the size of the tree models. The folds are shared.
    """
    folds = prepared_folds(df, target, roles, task, key, AUTO_FOLDS, labels)
    jobs = [(m, f) for m in AUTO[task] for f in folds]
    scores = side_by_side(lambda job: _fold_score(job[1], task, job[0], target, labels, log_target, params), jobs)
    close_folds(folds)
    means = {m: half_up(float(np.mean([s for (of, _), s in zip(jobs, scores) if of == m])), 4) for m in AUTO[task]}
    return max(means, key=lambda m: means[m])


def drawn_settings(model_type: str, draws: int = TUNE_DRAWS, grid: dict | None = None) -> list[dict]:
    """The settings that a search tries: a random draw from the grid, none for untuned models."""
    grid = grid or GRIDS.get(resolve_model_type(model_type))
    if not grid:
        return []
    rng = np.random.default_rng(SEED)
    names = list(grid)
    every = [dict(zip(names, combo)) for combo in np.array(np.meshgrid(*grid.values())).T.reshape(-1, len(names)).tolist()]
    every = [{k: int(v) if k != "step" else float(v) for k, v in s.items()} for s in every]
    return [every[i] for i in rng.choice(len(every), size=min(draws, len(every)), replace=False)]


def _grown_together(model_type: str, settings: Sequence[dict]) -> list[tuple[dict, list[dict]]]:
    """Settings that one fit answers, with the parameters of that fit. A forest's first trees are a smaller forest,
    its nodes down to a depth a shallower one; a booster's first trees are the booster stopped early."""
    forest = resolve_model_type(model_type) == "random_forest"
    groups: dict[tuple, list[dict]] = {}
    for s in settings:
        same = {k: v for k, v in s.items() if k != "trees" and not (forest and k == "depth")}
        groups.setdefault(tuple(sorted(same.items())), []).append(s)
    return [({k: max(s[k] for s in group) for k in group[0]}, group) for group in groups.values()]


def _setting_scores(fold: Fold, task: str, model_type: str, target: str, labels, log_target: bool, whole: dict, settings: list[dict]) -> list[float]:
    """Score of every setting on one fold, from one fit of ``whole``."""
    arrays = _summed_forest(fold, task, model_type, whole)
    if arrays is None:
        arrays = arrays_of(fit_prepared(fold.train, task, model_type, labels, whole))
    return _array_scores(arrays, fold, task, model_type, target, labels, log_target, settings)


def _array_scores(
    arrays: FittedArrays, fold: Fold, task: str, model_type: str, target: str, labels, log_target: bool, settings: list[dict]
) -> list[float]:
    """Score on the held-out rows of every setting that the trees answer."""
    forest = resolve_model_type(model_type) == "random_forest"
    shared = fold.held.sparkSession.sparkContext.broadcast(arrays)  # a fitted model
    size = len(arrays.first) // (1 if arrays.link != "one_by_one" else arrays.outputs)  # trees of a class

    def predictions(x: np.ndarray) -> np.ndarray:
        a, out = shared.value, []
        for s in settings:
            n = min(s.get("trees", size), size)
            trees = np.concatenate([np.arange(n) + k * size for k in range(len(a.first) // size)])
            if forest:
                raw = a.value[a.reached(x, trees, s.get("depth"))].sum(1) * (size / n if a.link == "value" else 1)
            else:
                raw = a.raw(x, trees)
            out.append(raw[:, 0] if a.link == "value" else a.probabilities(raw).argmax(1).astype(float))
        return np.stack(out, 1)

    def run(batches):
        for batch in batches:
            found = predictions(list_matrix(batch.column("_x")))
            at = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.ListArray.from_arrays(at, pa.array(found.reshape(-1)))], ["_y", "_p"])

    y = ref(target)
    rows = fold.held.select(y.alias("_y"), vector_to_array("_features").alias("_x"))
    kind = fold.held.schema[target].dataType.simpleString()
    found = stored(rows.mapInArrow(run, f"_y {kind}, _p array<double>"))
    scores = []
    for i in range(len(settings)):
        value = F.col("_p")[i]
        if task == "classification":
            value = F.element_at(F.array(*[F.lit(v) for v in labels]), value.cast("int") + 1)
        elif log_target:
            value = F.expm1(value)
        scores.append(_prediction_score(found.select("_y", value.alias("prediction")), "_y", task, log_target))
    discard(found)
    shared.unpersist()
    return scores


def tune(
    df: DataFrame, target: str, roles: dict[str, str], task: str, model_type: str, key: Sequence[str], labels: Sequence[str] = (),
    log_target: bool = False, draws: int = TUNE_DRAWS, grid: dict | None = None,
) -> dict | None:
    """Best of a random draw of parameter settings over three folds; None for untuned models."""
    trials = search_settings(df, target, roles, task, model_type, key, labels, log_target, draws, grid)
    return max(trials, key=lambda t: t[1])[0] if trials else None


def search_settings(
    df: DataFrame, target: str, roles: dict[str, str], task: str, model_type: str, key: Sequence[str], labels: Sequence[str] = (),
    log_target: bool = False, draws: int = TUNE_DRAWS, grid: dict | None = None,
) -> list[tuple[dict, float]]:
    """Settings and their mean scores over three shared folds, in the order drawn.

    Forests are grown once for each least leaf size, boosters once for each depth and step: the settings
    that differ in the number of trees (and, in forests, the depth) are read off one fit.
    """
    settings = drawn_settings(model_type, draws, grid)
    if not settings:
        return []
    folds = prepared_folds(df, target, roles, task, key, TUNE_FOLDS, labels)
    # the longest fits first
    groups = sorted(_grown_together(model_type, settings), key=lambda g: -g[0].get("trees", 1) * g[0].get("depth", 1))
    jobs = [(whole, group, f) for whole, group in groups for f in folds]
    found = side_by_side(lambda j: _setting_scores(j[2], task, model_type, target, labels, log_target, j[0], j[1]), jobs)
    close_folds(folds)
    scores: dict[int, list[float]] = {}
    for (_, group, _), values in zip(jobs, found):
        for s, v in zip(group, values):
            scores.setdefault(id(s), []).append(v)
    return [(s, half_up(float(np.mean(scores[id(s)])), 4)) for s in settings]


def platt_calibrate(df: DataFrame, target: str, roles: dict[str, str], model_type: str, key: Sequence[str], labels: Sequence[str]) -> list[float]:
    """Slope and intercept of a logistic curve over out-of-fold scores of a binary model."""
    rows = None
    for train, held in fold_splits(df, key, CALIBRATE_FOLDS):
        pipeline, _ = fit_pipeline(train, target, roles, "classification", model_type, labels, key)
        out = _labelled(_raw_scores(pipeline, held, "classification"), "classification", target, labels)
        part = out.select("_label", array_to_vector(F.array(F.col("_p")[1])).alias("_features"))
        rows = part if rows is None else rows.unionByName(part)
    curve = LogisticRegression(featuresCol="_features", labelCol="_label", standardization=False).fit(rows)
    return [float(curve.coefficients[0]), float(curve.intercept)]


def should_use_smote(task: str, model_type: str, counts: dict[str, int]) -> tuple[bool, int]:
    """Whether to add synthetic rows, and how many neighbours each is drawn from."""
    sizes = sorted(counts.values())
    if task != "classification" or len(sizes) != 2 or sizes[0] < SMOTE_MIN_MINORITY:
        return False, SMOTE_NEIGHBOURS
    limit = SMOTE_LIMITS.get(resolve_model_type(model_type), SMOTE_RATIO)
    return sizes[1] > limit * sizes[0], min(SMOTE_NEIGHBOURS, sizes[0] - 1)


def feature_importance(model: Trained, top_n: int = IMPORTANCE_TOP) -> list[tuple[str, float]]:
    last = model.pipeline.stages[-1]
    if hasattr(last, "featureImportances"):
        weights = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix"):
        weights = np.abs(last.coefficientMatrix.toArray()[0])
    elif hasattr(last, "coefficients"):
        weights = np.abs(last.coefficients.toArray())
    else:
        return []
    pairs = sorted(zip(model.feature_names, (float(w) for w in weights)), key=lambda p: -abs(p[1]))
    return pairs[:top_n]


def train_supervised_model(
    df: DataFrame,
    target_col: str,
    key: Sequence[str],
    feature_cols: Sequence[str] | None = None,
    task_hint: str = "auto",
    model_type: str = "auto",
    test_size: float = 0.2,
    cv_folds: int = 0,
    tune_model: bool = False,
    calibrate: bool = True,
    dataset_id: str | None = None,
    lag_series: Sequence[str] = (),
) -> Trained:
    """From a table to a fitted, evaluated model.

    ``key`` identifies rows: hashed splits and folds depend on it alone, so they repeat on any
    cluster. ``cv_folds`` and ``tune_model`` add whole extra fits and are off unless asked for.
    """
    require_columns(df, target_col, *key)
    rows = df.where(as_text(df, target_col).isNotNull())
    chosen = [c for c in (feature_cols or df.columns) if c not in (target_col, *key)]
    # Some twenty aggregates read these columns; lost partitions are recomputed.
    narrow = rows.select(*[ref(c) for c in dict.fromkeys([*key, *lag_series, target_col, *chosen])]).persist()
    rows = narrow
    ids = {r["column"] for r in features.looks_like_id(rows, [c for c in chosen if kinds(df)[c] == "numeric"]).where("is_id").collect()}
    chosen = [c for c in chosen if c not in ids]
    task = features.infer_task_type(rows, target_col, task_hint)
    log_target = task == "regression" and features.should_log_transform(rows, [target_col]).first()["log_transform"]
    if log_target:
        rows = features.log_target(rows, target_col)
    counts: dict[str, int] = {}
    if task == "classification":
        counts = {r["v"]: r["n"] for r in rows.groupBy(as_text(rows, target_col).alias("v")).agg(F.count("*").alias("n")).collect()}
    labels = sorted(counts)
    roles = {r["feature"]: r["role"] for r in features.split_feature_types(rows, chosen).collect()}
    roles = {c: r for c, r in roles.items() if r != "dropped"}
    n = rows.count()
    dates, nums = [c for c, r in roles.items() if r == "datetime"], [c for c, r in roles.items() if r == "numeric"]
    lag_config = None
    if dates and nums and task == "regression" and n >= LAG_MIN_ROWS:
        lag_cols = nums
        rows = features.lag_features(rows, dates[0], lag_cols, partition_by=lag_series, key=key)
        made = [c for c in rows.columns if "__lag_" in c or "__roll_mean_" in c]
        roles.update({c: "numeric" for c in made})
        lag_config = {
            "sort_col": dates[0], "lag_cols": lag_cols, "lags": list(features.LAGS), "windows": list(features.WINDOWS),
            "series": list(lag_series),
        }
    kept = {r["feature"] for r in features.select_features(rows, list(roles)).where("kept").collect()}
    roles = {c: r for c, r in roles.items() if c in kept}
    if not roles:
        raise ValueError("no usable feature remains")
    leakage = [r.asDict() for r in features.detect_leakage(rows, list(roles), target_col).collect()]
    time_col = lag_config["sort_col"] if lag_config else None
    stratify = target_col if counts and min(counts.values()) >= 2 and len(counts) >= 2 else None
    marked = split_train_test(rows, key, test_size, stratify, time_col).persist()
    train, test = marked.where("NOT is_test").drop("is_test"), marked.where("is_test").drop("is_test")
    n_train = train.count()
    chosen_type = resolve_model_type(model_type)
    if chosen_type == "auto":
        small = "logistic_regression" if task == "classification" else "ridge_regression"
        chosen_type = auto_select_model(train, target_col, roles, task, key, labels, log_target) if n_train >= AUTO_MIN_ROWS else small
    use_smote = should_use_smote(task, chosen_type, counts)
    interactions = len([c for c, r in roles.items() if r == "numeric"]) >= INTERACTION_MIN_COLS and n >= INTERACTION_MIN_ROWS
    params = tune(train, target_col, roles, task, chosen_type, key, labels, log_target) if tune_model and n_train >= TUNE_MIN_ROWS else None
    pipeline, terms = fit_pipeline(train, target_col, roles, task, chosen_type, labels, key, interactions, use_smote, params)
    model = Trained(
        pipeline, task, chosen_type, target_col, list(roles), labels, dataset_id=dataset_id, log_target=log_target, lag_config=lag_config,
        feature_names=list(terms), terms=[asdict(t) | {"sql": ""} for t in terms.values()], best_params=params, leakage=leakage,
    )
    tree = chosen_type in ("random_forest", "gradient_boosting", "decision_tree")
    if calibrate and task == "classification" and len(labels) == 2 and tree and params is None and n_train >= CALIBRATE_MIN_ROWS:
        model.platt = platt_calibrate(train, target_col, roles, chosen_type, key, labels)
    if cv_folds >= 2:
        model.cross_validation = cross_validate(rows, target_col, roles, task, chosen_type, key, cv_folds, labels, time_col, log_target)
    _evaluate(model, train, test)
    cats = [c for c, r in roles.items() if r in ("one_hot", "target_encoded")]
    stats = drift.training_stats(train, [c for c, r in roles.items() if r == "numeric"], cats)
    model.training_stats = [r.asDict(recursive=True) for r in stats.collect()]
    model.fingerprint = [r.asDict() for r in drift.fingerprint(train, list(roles)).collect()]
    marked.unpersist()
    narrow.unpersist()
    return model


def _evaluate(model: Trained, train: DataFrame, test: DataFrame) -> None:
    target, task = model.target_col, model.task_type
    out = predict(model, test).persist()
    if task == "classification":
        model.evaluation = evaluate.classification_metrics(out, target, "prediction").first().asDict()
        base = scoring.classification_baselines(train, test, target)
        model.baselines = [r.asDict() for r in base.collect()]
        best = max(b["accuracy"] for b in model.baselines)
        model.comparison = scoring.compare_to_baseline(best, model.evaluation["accuracy"], "accuracy")
        truth = F.element_at("probability", F.array_position(F.array(*[F.lit(v) for v in model.labels]), as_text(out, target)).cast("int"))
        model.conformal_q = scoring.conformal_class_threshold(out, truth)
        if len(model.labels) == 2:
            binary = out.select((as_text(out, target) == model.labels[1]).cast("int").alias("y"), F.col("probability")[1].alias("p"))
            model.optimal_threshold = scoring.optimal_threshold(binary, "y", "p").first()["threshold"]
            model.evaluation["roc_auc"] = evaluate.roc_auc(binary, "y", "p").first()["roc_auc"]
    else:
        actual = F.expm1(as_double(out, target)) if model.log_target else as_double(out, target)
        pairs = out.select(actual.alias("actual"), "prediction")
        row = evaluate.regression_metrics(pairs, "actual", "prediction").first()
        model.evaluation = row.asDict() if row else {}
        model.baselines = [r.asDict() for r in scoring.regression_baselines(train, test, target, model.log_target).collect()]
        best = min((b["wmape"] for b in model.baselines if b["wmape"] is not None), default=None)
        model.comparison = scoring.compare_to_baseline(best, model.evaluation.get("wmape"), "wmape")
        model.conformal_halfwidth = scoring.conformal_halfwidth(pairs, "actual", "prediction")
    out.unpersist()


def evaluation_rows(spark, model: Trained) -> DataFrame:
    """Stored evaluation as ``metric, value``."""
    rows = [(k, float(v)) for k, v in model.evaluation.items() if isinstance(v, (int, float))]
    return spark.createDataFrame(rows, "metric string, value double")


def meta_json(model: Trained) -> str:
    return json.dumps(model.meta(), default=str)
