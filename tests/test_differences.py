"""Scoring by difference against full scoring, and rollouts in one pass against step by step."""

import math

import pytest
from pyspark.sql import functions as F

from tablewise.operators import explain, forecast, train


@pytest.fixture(scope="module")
def rows(spark):
    base = spark.range(150).select(
        F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(37)) / 3.0).alias("a"),
        F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(11)).cast("double")).alias("b"),
        F.element_at(F.array(*[F.lit(x) for x in ("red", "green", "blue")]), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)) + 1).cast("int")).alias("c"),
    )
    y = F.col("a") * 2 + F.coalesce("b", F.lit(4.0)) * F.when(F.col("c") == "red", 3).otherwise(-1)
    out = base.select("*", (y + 40).alias("y"), F.when(F.col("id") % 10 == 3, None).when(y > 20, "yes").otherwise("no").alias("two"))
    return out.persist()


ROLES = {"a": "numeric", "b": "numeric", "c": "one_hot"}


def fitted(rows, task, target, kind, interactions=True):
    labels = ["no", "yes"] if task == "classification" else []
    known = rows.where(F.col(target).isNotNull())
    pipeline, terms = train.fit_pipeline(known, target, ROLES, task, kind, labels, ["id"], interactions, params={"trees": 6, "depth": 3})
    given = [train.asdict(t) | {"sql": ""} for t in terms.values()]
    return train.Trained(pipeline, task, kind, target, list(ROLES), labels, feature_names=list(terms), terms=given, platt=[2.0, -1.0] if labels else None)


def table(df, *keys):
    return {tuple(r[k] for k in keys): [v for n, v in r.asDict().items() if n not in keys] for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert all(x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[k], b[k])), (k, a[k], b[k])


@pytest.mark.parametrize(
    "task, target, kind",
    [("regression", "y", "ridge_regression"), ("regression", "y", "gradient_boosting"), ("classification", "two", "random_forest")],
)
def test_differences_equal_full_scoring(rows, task, target, kind):
    model = fitted(rows, task, target, kind)
    assert any(t["parts"] for t in model.terms)
    same(
        table(explain.permutation_importance(model, rows, ["id"], 3), "feature"),
        table(explain._drops(*explain._permuted_by_copies(model, rows, ["id"], 3)), "feature"),
    )
    few = rows.where("id < 20")
    same(
        table(explain.shapley_sampling(model, rows, ["id"], 4, few), "id", "feature"),
        table(explain._shapley_by_copies(model, rows, ["id"], 4, few), "id", "feature"),
    )
    grid = explain._grid(rows, list(ROLES), 5)
    full = explain._on_grid(model, rows, grid, []).groupBy("feature", "value", "text_value").agg(F.avg("score").alias("mean_prediction"))
    same(table(explain.partial_dependence(model, rows, points=5), "feature", "value", "text_value"), table(full, "feature", "value", "text_value"))


def test_shuffled_rows_do_not_grow_with_features(rows, monkeypatch):
    model = fitted(rows, "regression", "y", "ridge_regression")
    met, real = [], explain._with_donor
    monkeypatch.setattr(explain, "_with_donor", lambda *a: met.append(real(*a).count()) or real(*a))
    explain.permutation_importance(model, rows, ["id"], 3).collect()
    assert met == [3 * 150]


@pytest.mark.parametrize("kind", ["linear_regression", "gradient_boosting"])
def test_rollout_equals_steps(spark, kind, monkeypatch):
    days = spark.range(240).select(
        F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").alias("shop"),
        F.expr("date_add(DATE'2024-01-01', CAST(id DIV 3 AS INT))").alias("day"),
        (100 + 10 * F.sin(F.col("id") / 5.0) + F.col("id") / 4.0).alias("total"), (F.col("id") % 13).cast("long").alias("orders"),
    )
    model = train.train_supervised_model(days, "total", ["shop"], ["day", "orders"], model_type=kind, lag_series=["shop"])
    got = table(forecast.ml_rollout(model, days, 9), "shop", "step")
    plans = [len(forecast.ml_rollout(model, days, h)._jdf.queryExecution().optimizedPlan().toString()) for h in (2, 40)]
    assert abs(plans[0] - plans[1]) < 40
    monkeypatch.setattr(forecast, "model_arrays", lambda m: None)
    want = table(forecast.ml_rollout(model, days, 9), "shop", "step")
    assert len(got) == 27
    same(got, want)
