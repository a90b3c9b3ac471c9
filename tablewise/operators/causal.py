"""Linear effect estimates with robust errors, and mediation, from moment sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import as_text, half_up, kinds, present, ref, require_columns
from tablewise.functions.distributions import t_tail
from tablewise.plans.moments import moment_matrix
from tablewise.plans.shape import one_row

MAX_LEVERAGE = 0.9999
MIN_ROWS = 10
LEVELS_IN_PLAN = 10_000


def _encoded(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Complete rows of the columns as doubles; text levels become their sorted position."""
    kind = kinds(df)
    rows = df.select(*[present(df, c).alias(c) for c in names]).dropna()
    for c in names:
        if kind[c] in ("numeric", "boolean"):
            rows = rows.withColumn(c, ref(c).cast("int").cast("double") if kind[c] == "boolean" else ref(c).cast("double"))
            continue
        text = rows.withColumn(c, as_text(rows, c))
        levels = text.select(ref(c)).distinct()
        found = [r[0] for r in levels.limit(LEVELS_IN_PLAN + 1).collect()]
        if len(found) <= LEVELS_IN_PLAN:
            codes = F.create_map(*[x for i, v in enumerate(sorted(found)) for x in (F.lit(v), F.lit(float(i)))])
            rows = text.withColumn(c, codes[ref(c)])
        else:
            from tablewise.plans.ordering import row_index

            coded = row_index(levels, [c], name="_code")
            rows = text.join(coded, c).drop(c).withColumnRenamed("_code", c).withColumn(c, ref(c).cast("double"))
    return rows


def _solve(n: int, means: np.ndarray, s: np.ndarray, xs: Sequence[int], y: int) -> tuple[np.ndarray, float]:
    """Slopes and intercept of y on the x columns from centred sums (least-norm if singular)."""
    sxx = s[np.ix_(xs, xs)]
    slopes = np.linalg.lstsq(sxx, s[xs, y], rcond=None)[0]
    return slopes, float(means[y] - slopes @ means[list(xs)])


def estimate_causal_effect(
    df: DataFrame, treatment_col: str, outcome_col: str, control_cols: Sequence[str] | None = None
) -> DataFrame:
    """Effect of the treatment on the outcome given the controls, one row.

    Two aggregates give the coefficients, a third sweeps the rows for the HC3 covariance:
    the leverage of a row is a column expression in the k x k inverse, so state stays O(k^2).
    """
    controls = list(control_cols or [])
    require_columns(df, treatment_col, outcome_col, *controls)
    spark = df.sparkSession
    xs = [treatment_col, *controls]
    data = _encoded(df, [*xs, outcome_col])
    n, means, s = moment_matrix(data, [*xs, outcome_col])
    k = len(xs) + 1
    if n < MIN_ROWS:
        raise ValueError("fewer than 10 complete rows")
    if n <= k:
        raise ValueError("more predictors than observations")
    ix, iy = list(range(len(xs))), len(xs)
    slopes, _ = _solve(n, means, s, ix, iy)
    try:
        inv = np.linalg.inv(s[np.ix_(ix, ix)])
    except np.linalg.LinAlgError:
        inv = np.linalg.pinv(s[np.ix_(ix, ix)])

    # Centred predictors are orthogonal to the intercept: leverage = 1/n + z' inv z.
    z = [ref(c) - F.lit(float(means[i])) for i, c in enumerate(xs)]
    leverage: Column = F.lit(1.0 / n)
    for i in ix:
        for j in ix:
            leverage = leverage + z[i] * z[j] * F.lit(float(inv[i, j]))
    resid = ref(outcome_col) - F.lit(float(means[iy]))
    for i in ix:
        resid = resid - z[i] * F.lit(float(slopes[i]))
    swept = data.select(
        *[z[i].alias(f"_z{i}") for i in ix],
        resid.alias("_e"),
        F.greatest(F.lit(0.0), F.least(leverage, F.lit(MAX_LEVERAGE))).alias("_h"),
        (ref(treatment_col)).alias("_t"),
        ref(outcome_col).alias("_y"),
    )
    weight = F.pow(F.col("_e") / (1 - F.col("_h")), 2)
    meat = [F.sum(weight * F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"w{i}_{j}") for i in ix for j in ix]
    row = swept.agg(
        *meat,
        F.sum(F.col("_e") * F.col("_e")).alias("sse"),
        F.min("_t").alias("t_lo"),
        F.max("_t").alias("t_hi"),
    ).first()
    w = np.array([[row[f"w{i}_{j}"] for j in ix] for i in ix], dtype=float)
    se = math.sqrt((inv @ w @ inv)[0, 0])
    ate = float(slopes[0])
    sst = float(s[iy, iy]) or 1.0
    t_stat = ate / max(se, 1e-12)
    p = t_tail(spark, t_stat, n - k)

    ends = swept.agg(
        F.count_if((F.col("_t") != row["t_lo"]) & (F.col("_t") != row["t_hi"])).alias("inner"),
        *[
            f.alias(f"{side}_{name}")
            for side, hit in (("lo", F.col("_t") == row["t_lo"]), ("hi", F.col("_t") == row["t_hi"]))
            for name, f in (("n", F.count_if(hit)), ("v", F.var_pop(F.when(hit, F.col("_y")))))
        ],
    ).first()
    binary = row["t_lo"] != row["t_hi"] and ends["inner"] == 0
    if binary:
        free = ends["lo_n"] + ends["hi_n"] - 2
        pooled = math.sqrt(((ends["lo_n"] - 1) * ends["lo_v"] + (ends["hi_n"] - 1) * ends["hi_v"]) / free)
        effect, metric = ate / (pooled or 1.0), "cohen_d"
    else:
        sd_t = math.sqrt(s[0, 0] / (n - 1))
        sd_y = math.sqrt(s[iy, iy] / n) or 1.0
        effect, metric = ate * sd_t / sd_y, "standardised_beta"
    size = abs(effect)
    magnitude = "large" if size > 0.8 else "medium" if size > 0.5 else "small" if size > 0.2 else "negligible"
    return one_row(
        spark,
        "treatment_col string, outcome_col string, control_cols string, n_observations bigint, treatment_is_binary boolean, "
        "ate double, std_error_hc3 double, ci_lower_95 double, ci_upper_95 double, t_statistic double, p_value double, "
        "significant_at_05 boolean, effect_size double, effect_metric string, effect_magnitude string, "
        "effect_direction string, r_squared double, e_value double, treatment_mean double, outcome_mean double",
        (
            treatment_col, outcome_col, ",".join(controls), n, binary, half_up(ate, 6), half_up(se, 6),
            half_up(ate - 1.96 * se, 6), half_up(ate + 1.96 * se, 6), half_up(t_stat, 4), half_up(p, 6),
            p is not None and p < 0.05, half_up(effect, 4), metric, magnitude, "positive" if ate > 0 else "negative",
            half_up(1 - row["sse"] / sst, 4), half_up(e_value(effect), 3), half_up(float(means[0]), 4), half_up(float(means[iy]), 4),
        ),
    )


def e_value(effect: float) -> float:
    """Risk ratio an unmeasured confounder needs; the effect maps to exp(0.91 |d|)."""
    ratio = math.exp(0.91 * abs(effect))
    return ratio + math.sqrt(ratio * (ratio - 1))


def mediation(df: DataFrame, treatment_col: str, outcome_col: str, mediation_col: str) -> DataFrame:
    """Direct and indirect paths from one moment matrix."""
    require_columns(df, treatment_col, outcome_col, mediation_col)
    data = _encoded(df, [treatment_col, mediation_col, outcome_col])
    n, means, s = moment_matrix(data, [treatment_col, mediation_col, outcome_col])
    if n < MIN_ROWS:
        raise ValueError("fewer than 10 complete rows")
    a = float(_solve(n, means, s, [0], 1)[0][0])
    direct, b = (float(x) for x in _solve(n, means, s, [0, 1], 2)[0])
    indirect = a * b
    total = direct + indirect
    return one_row(
        df.sparkSession,
        "mediator string, path_a double, path_b double, indirect_effect double, direct_effect double, total_effect double, "
        "mediation_pct double",
        (
            mediation_col, half_up(a, 4), half_up(b, 4), half_up(indirect, 4), half_up(direct, 4), half_up(total, 4),
            half_up(abs(indirect / total * 100), 1) if abs(total) > 1e-9 else 0.0,
        ),
    )
