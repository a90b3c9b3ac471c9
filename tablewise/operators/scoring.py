"""What surrounds a model: baselines, class weights, thresholds, conformal widths, prediction sets."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import as_double, as_text, half_up, ref, require_columns
from tablewise.plans.quantiles import quantile_values

# Threshold sweep and conformal coverage.
THRESHOLDS = [float(x) for x in np.linspace(0.05, 0.95, 91)]
COVERAGE = 0.90
MIN_CALIBRATION_ROWS = 10


# ---- baselines ----


def regression_baselines(train: DataFrame, test: DataFrame, target: str, log_target: bool = False) -> DataFrame:
    """WMAPE and R2 on the test rows of always predicting the training mean or median."""
    y_train = as_double(train, target)
    mean = train.agg(F.avg(y_train).alias("m")).first()["m"]
    median = (quantile_values(train, target, [0.5]) or [None])[0]
    back = math.expm1 if log_target else float
    y = F.expm1(as_double(test, target)) if log_target else as_double(test, target)
    parts = []
    for name, value in (("mean", mean), ("median", median)):
        guess = F.lit(back(value))
        parts += [
            F.sum(F.abs(y - guess)).alias(f"{name}_abs"),
            F.sum((y - guess) * (y - guess)).alias(f"{name}_sq"),
        ]
    row = test.agg(F.sum(F.abs(y)).alias("w"), (F.var_pop(y) * F.count(y)).alias("t"), *parts).first()
    rows = [
        (
            name,
            half_up(row[f"{name}_abs"] / row["w"], 4) if row["w"] else None,
            half_up(1 - row[f"{name}_sq"] / max(row["t"], 1e-9), 4),
        )
        for name in ("mean", "median")
    ]
    return train.sparkSession.createDataFrame(rows, "strategy string, wmape double, r2 double")


def classification_baselines(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Accuracy and weighted F1 of the commonest class and of drawing classes at training rates.

    The stratified baseline is given by its expectation, which needs no random draw.
    """
    seen = train.groupBy(as_text(train, target).alias("label")).agg(F.count("*").alias("a")).where("label IS NOT NULL")
    held = test.groupBy(as_text(test, target).alias("label")).agg(F.count("*").alias("b")).where("label IS NOT NULL")
    rows = {r["label"]: (r["a"] or 0, r["b"] or 0) for r in seen.join(held, "label", "full").collect()}
    n, m = sum(a for a, _ in rows.values()), sum(b for _, b in rows.values())
    top = min((k for k in rows), key=lambda k: (-rows[k][0], k))
    hit = rows[top][1]
    f1_top = (2 * hit / (hit + m)) * hit / m if m else 0.0
    rate = {k: a / n for k, (a, _) in rows.items()}
    accuracy = sum(rate[k] * b / m for k, (_, b) in rows.items())
    f1 = 0.0
    for k, (_, b) in rows.items():
        expected_tp, predicted = rate[k] * b, rate[k] * m
        f1 += (2 * expected_tp / (predicted + b) if predicted + b else 0.0) * b / m
    out = [("most_frequent", half_up(hit / m, 4), half_up(f1_top, 4)), ("stratified", half_up(accuracy, 4), half_up(f1, 4))]
    return train.sparkSession.createDataFrame(out, "strategy string, accuracy double, f1_weighted double")


def compare_to_baseline(best_baseline: float | None, model_metric: float | None, primary: str) -> dict:
    """Delta and beats flag; accuracy rises, WMAPE falls."""
    if best_baseline is None or model_metric is None:
        return {"delta": None, "beats_baseline": None}
    up = primary == "accuracy"
    delta = model_metric - best_baseline if up else best_baseline - model_metric
    return {"delta": half_up(delta, 4), "beats_baseline": delta > 0}


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """``label, n, weight, imbalance_ratio``: balanced weights n / (k * n_c)."""
    counts = df.groupBy(as_text(df, target).alias("label")).agg(F.count("*").alias("n")).where(F.col("label").isNotNull())
    t = counts.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.max("n").alias("hi"), F.min("n").alias("lo")).first()
    if not t["k"]:
        raise ValueError("no labelled row")
    return counts.select(
        "label",
        "n",
        (F.lit(float(t["n"])) / (F.lit(t["k"]) * F.col("n"))).alias("weight"),
        F.lit(t["hi"] / t["lo"]).alias("imbalance_ratio"),
    )


# ---- thresholds and conformal calibration ----


def _passed(p: Column) -> Column:
    """How many of the 91 thresholds a probability reaches.

    Arithmetic finds the neighbourhood, comparing with the stored thresholds settles it.
    """
    steps = F.array(*[F.lit(t) for t in THRESHOLDS])
    n = len(THRESHOLDS)
    guess = F.greatest(F.lit(0), F.least(F.lit(n), F.floor((p - 0.05) * 100).cast("int") + 1))
    lower = F.when((guess > 0) & (F.try_element_at(steps, F.greatest(guess, F.lit(1))) > p), guess - 1).otherwise(guess)
    above = F.try_element_at(steps, F.least(lower + 1, F.lit(n)))
    return F.when((lower < n) & (above <= p), lower + 1).otherwise(lower)


def threshold_sweep(df: DataFrame, actual_col: str, probability_col: str, positive: str = "1") -> DataFrame:
    """``threshold, f1`` of all 91 thresholds.

    Rows fall into at most 92 score bands in one aggregate; the sweep is a cumulative sum over
    those bands.
    """
    require_columns(df, actual_col, probability_col)
    p = as_double(df, probability_col)
    actual = as_double(df, actual_col)
    is_pos = (actual == float(positive)) if _is_number(positive) else (as_text(df, actual_col) == positive)
    bands = (
        df.where(p.isNotNull() & as_text(df, actual_col).isNotNull())
        .groupBy(_passed(p).alias("band"))
        .agg(F.count_if(is_pos).alias("pos"), F.count_if(~is_pos).alias("neg"))
        .collect()
    )
    pos, neg = [0] * (len(THRESHOLDS) + 1), [0] * (len(THRESHOLDS) + 1)
    for b in bands:
        pos[b["band"]], neg[b["band"]] = b["pos"], b["neg"]
    total = sum(pos)
    rows = []
    for k, t in enumerate(THRESHOLDS, start=1):
        tp, fp = sum(pos[k:]), sum(neg[k:])
        bottom = tp + fp + total
        rows.append((t, 2 * tp / bottom if bottom and tp else 0.0))
    return df.sparkSession.createDataFrame(rows, "threshold double, f1 double")


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def optimal_threshold(df: DataFrame, actual_col: str, probability_col: str, positive: str = "1") -> DataFrame:
    """First threshold with the best F1, two digits; 0.5 when none scores."""
    sweep = threshold_sweep(df, actual_col, probability_col, positive)
    best = sweep.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("t"), F.max("f1").alias("f1"))
    return best.select(F.round(F.when(F.col("f1") > 0, F.col("t")).otherwise(0.5), 2).alias("threshold"), "f1")


def _conformal_level(n: int) -> float:
    return min(1.0, math.ceil((n + 1) * COVERAGE) / n)


def conformal_halfwidth(df: DataFrame, actual_col: str, prediction_col: str) -> float | None:
    """90 % split-conformal half width; None for fewer than ten rows."""
    gap = df.select(F.abs(as_double(df, actual_col) - as_double(df, prediction_col)).alias("gap")).where("gap IS NOT NULL")
    n = gap.count()
    return None if n < MIN_CALIBRATION_ROWS else (quantile_values(gap, "gap", [_conformal_level(n)]) or [None])[0]


def conformal_class_threshold(df: DataFrame, true_probability: Column) -> float | None:
    """The same quantile of one minus the probability given to the true class."""
    gap = df.select((1 - true_probability).alias("gap")).where("gap IS NOT NULL")
    n = gap.count()
    return None if n < MIN_CALIBRATION_ROWS else (quantile_values(gap, "gap", [_conformal_level(n)]) or [None])[0]


def prediction_intervals(df: DataFrame, prediction_col: str, halfwidth: float, log_target: bool = False) -> DataFrame:
    low = ref(prediction_col) - F.lit(halfwidth)
    return df.withColumns(
        {
            f"{prediction_col}_lower": F.greatest(low, F.lit(0.0)) if log_target else low,
            f"{prediction_col}_upper": ref(prediction_col) + F.lit(halfwidth),
        }
    )


def apply_threshold(
    df: DataFrame, probability_col: str, threshold: float, labels: tuple[str, str] = ("0", "1"), name: str = "prediction"
) -> DataFrame:
    return df.withColumn(name, F.when(ref(probability_col) >= threshold, labels[1]).otherwise(labels[0]))


def prediction_sets(df: DataFrame, class_cols: dict[str, str], q: float, name: str = "prediction_set") -> DataFrame:
    """Classes with probability at least ``1 - q``, sorted and joined by ``|``; never empty."""
    pairs = F.array(*[F.struct(ref(col).alias("p"), F.lit(cls).alias("cls")) for cls, col in class_cols.items()])
    kept = F.filter(pairs, lambda e: e["p"] >= 1 - q)
    names = F.array_sort(F.transform(kept, lambda e: e["cls"]))
    first_best = F.transform(
        F.filter(pairs, lambda e: e["p"] == F.greatest(*[ref(c) for c in class_cols.values()])), lambda e: e["cls"]
    )[0]
    members = F.when(F.size(names) > 0, names).otherwise(F.array(first_best))
    return df.withColumn(f"{name}_size", F.size(members)).withColumn(name, F.array_join(members, "|"))


def prediction_set_summary(df: DataFrame, name: str = "prediction_set") -> DataFrame:
    size = ref(f"{name}_size")
    return df.agg(F.avg(size).alias("average_size"), F.count_if(size == 1).alias("singletons"), F.count("*").alias("n"))

