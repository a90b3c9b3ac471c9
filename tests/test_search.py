"""Fitted models as arrays, and searches over shared folds."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tablewise.operators import train
from tablewise.plans import forests
from tablewise.plans.ensembles import arrays_of


@pytest.fixture(scope="module")
def rows(spark):
    # three inputs, one of them text, with ties and nulls
    base = spark.range(400).select(
        F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(37)) / 3.0).alias("a"), F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(11)).cast("double")).alias("b"),
        F.element_at(F.array(*[F.lit(x) for x in ("red", "green", "blue")]), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)) + 1).cast("int")).alias("c"),
    )
    y = F.col("a") * 2 + F.coalesce("b", F.lit(4.0)) * F.when(F.col("c") == "red", 3).otherwise(-1)
    return base.select("*", y.alias("y"), (y > 20).cast("int").alias("two"), F.when(y > 30, "high").when(y > 10, "mid").otherwise("low").alias("three")).persist()


ROLES = {"a": "numeric", "b": "numeric", "c": "one_hot"}


@pytest.mark.parametrize(
    "task, target, kind",
    [
        ("regression", "y", "ridge_regression"), ("regression", "y", "decision_tree"), ("regression", "y", "random_forest"),
        ("regression", "y", "gradient_boosting"), ("classification", "two", "logistic_regression"), ("classification", "three", "logistic_regression"),
        ("classification", "three", "decision_tree"), ("classification", "three", "random_forest"), ("classification", "two", "gradient_boosting"),
        ("classification", "three", "gradient_boosting"),
    ],
)
def test_arrays_score_as_spark_does(rows, task, target, kind):
    labels = sorted({str(r[0]) for r in rows.select(target).distinct().collect()}) if task == "classification" else []
    pipeline, terms = train.fit_pipeline(rows, target, ROLES, task, kind, labels, ["id"], params={"trees": 12, "depth": 4})
    arrays = arrays_of(pipeline.stages[-1])
    ready = rows
    for s in pipeline.stages[:-1]:
        ready = s.transform(ready)
    scored = train._raw_scores(pipeline, rows.select("id", "a", "b", "c"), task).select("id", "_p")
    got = ready.select("id", vector_to_array("_features").alias("x")).join(scored, "id").orderBy("id").collect()
    x, want = np.array([r.x for r in got]), np.array([r._p for r in got])
    raw = arrays.raw(x)
    mine = raw[:, 0] if task == "regression" else arrays.probabilities(raw)
    assert np.abs(mine - want).max() < 1e-9
    # one input changed: the difference is as good as scoring anew
    entries = [i for i, t in enumerate(terms.values()) if "c" in t.columns]
    new = x.copy()
    new[:, entries] = x[::-1][:, entries]
    assert np.allclose(raw + arrays.change(x, new, entries, arrays.uses(entries)), arrays.raw(new), atol=1e-9)


def test_shared_fits_answer_smaller_settings(rows):
    """A setting's score equals that of its own forest's first trees, walked in Spark, and a stopped booster."""
    folds = train.prepared_folds(rows, "y", ROLES, "regression", ["id"], 2)
    whole = {"trees": 8, "depth": 6, "leaf": 2}
    settings = [{"trees": 3, "depth": 6, "leaf": 2}, {"trees": 8, "depth": 6, "leaf": 2}]
    got = train._setting_scores(folds[0], "regression", "random_forest", "y", [], False, whole, settings)
    model = train.fit_prepared(folds[0].train, "regression", "random_forest", [], whole)
    held = folds[0].held.withColumn("_id", F.monotonically_increasing_id()).persist()
    parts = [t.transform(held).select("_id", F.col("_prediction").alias("p")) for t in model.trees[:3]]
    mean = parts[0].union(parts[1]).union(parts[2]).groupBy("_id").agg(F.avg("p").alias("prediction"))
    want = train._prediction_score(held.join(mean, "_id"), "y", "regression", False)
    assert abs(got[0] - want) < 1e-9
    assert abs(got[1] - train._fold_score(folds[0], "regression", "random_forest", "y", [], False, whole)) < 1e-9
    boost = [{"trees": 4, "depth": 2, "step": 0.3}, {"trees": 9, "depth": 2, "step": 0.3}]
    got = train._setting_scores(folds[1], "regression", "gradient_boosting", "y", [], False, boost[1], boost)
    for s, score in zip(boost, got):
        assert abs(score - train._fold_score(folds[1], "regression", "gradient_boosting", "y", [], False, s)) < 1e-9
    train.close_folds(folds)


def test_search_takes_the_best_and_prepares_once_a_fold(rows, monkeypatch):
    calls = []
    real = train.prepare
    monkeypatch.setattr(train, "prepare", lambda *a, **k: calls.append(1) or real(*a, **k))
    grid = {"trees": [2, 5], "depth": [1, 4], "leaf": [1, 30]}
    trials = train.search_settings(rows, "three", ROLES, "classification", "random_forest", ["id"], ["high", "low", "mid"], grid=grid)
    assert len(trials) == 8 and len(calls) == train.TUNE_FOLDS
    best = train.tune(rows, "three", ROLES, "classification", "random_forest", ["id"], ["high", "low", "mid"], grid=grid)
    assert dict(map(lambda t: (tuple(t[0].items()), t[1]), trials))[tuple(best.items())] == max(s for _, s in trials)
    assert train.tune(rows, "y", ROLES, "regression", "ridge_regression", ["id"]) is None


def test_all_families_race_over_three_classes_and_text(rows):
    noted = rows.withColumn("note", F.when(F.col("three") == "high", "very dear thing").when(F.col("three") == "low", "cheap stuff here").otherwise("so so item"))
    best = train.auto_select_model(
        noted, "three", {"note": "text", "c": "one_hot"}, "classification", ["id"], ["high", "low", "mid"], params={"trees": 5, "depth": 2}
    )
    assert best in train.AUTO["classification"]
    model = train.train_supervised_model(rows.drop("y", "two"), "three", ["id"], model_type="gradient_boosting")
    assert model.evaluation["accuracy"] > 0.8


def test_large_folds_use_all_cores_and_their_forests_read_rows_once(spark, monkeypatch):
    i = F.col("id")
    wide = spark.range(6_000, numPartitions=1).select(
        "id", (i % 40).alias("a"), F.concat(F.lit("c"), (i * 7 % 5)).alias("c"), (100 + 3 * (i % 40) + 50 * (i * 7 % 5 == 2).cast("int") + i % 11).cast("double").alias("y")
    )
    roles = {"a": "numeric", "c": "one_hot"}
    monkeypatch.setattr(train, "FIT_ROWS", 500)
    folds = train.prepared_folds(wide, "y", roles, "regression", ["id"], 2)
    monkeypatch.setattr(train, "estimator", lambda *a, **k: 1 / 0)  # no pass over the rows for each level
    assert all(len(f.train.ready.inputFiles()) > 1 and f.train.ready.count() == f.train.n for f in folds)
    settings = [{"trees": 5, "depth": 2, "leaf": 1}, {"trees": 12, "depth": 8, "leaf": 1}]
    both = train._setting_scores(folds[0], "regression", "random_forest", "y", [], False, settings[1], settings)
    alone = [train._fold_score(folds[0], "regression", "random_forest", "y", [], False, s) for s in settings]
    assert np.allclose(both, alone, atol=1e-9)
    monkeypatch.undo()
    # as good as Spark's own forest, which draws other rows and inputs
    spark_own = train._fold_score(folds[0], "regression", "random_forest", "y", [], False, settings[1])
    assert abs(spark_own - alone[1]) < 0.03 and alone[0] < alone[1]
    train.close_folds(folds)


def test_forest_of_sums_splits_bagged_rows_as_a_plain_search_would(spark, monkeypatch):
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 4, (30, 3))
    copies = rng.poisson(1.0, 30).astype(float)
    y = rng.normal(size=30)
    nodes = forests.grow(cells, np.stack([copies, copies * y, copies * y * y]), 1, 2, np.random.default_rng(0))
    feature, bin_, left, right, mean = nodes[0]
    tried = np.random.default_rng(0).choice(3, 1, replace=False)[0]
    x, t = np.repeat(cells[:, tried], copies.astype(int)), np.repeat(y, copies.astype(int))
    cost = {b: sum(((p - p.mean()) ** 2).sum() for p in (t[x <= b], t[x > b])) for b in range(4) if min((x <= b).sum(), (x > b).sum()) >= 2}
    assert (feature, bin_, left, right) == (tried, min(cost, key=lambda b: cost[b]), 1, 2) and abs(mean - t.mean()) < 1e-12
    assert abs(nodes[1][4] - t[x <= bin_].mean()) < 1e-12 and abs(nodes[2][4] - t[x > bin_].mean()) < 1e-12
    # inputs too varied for sums are left to Spark's forest
    monkeypatch.setattr(forests, "CELLS", 10)
    rows = spark.range(200).select(F.col("id").cast("double").alias("_label"), array_to_vector(F.array(F.col("id").cast("double"))).alias("_features"))
    assert forests.regression_forest(rows, 200, 3, 4, 1, 42) is None
    monkeypatch.setattr(forests, "CELLS", 200)
    same = rows.select(F.lit(5.0).alias("_label"), "_features")
    found = forests.regression_forest(same, 200, 3, 4, 1, 42)
    assert len(found.first) == 3 and len(found.left) == 3 and np.allclose(found.raw(np.zeros((2, 1))), 5.0)
