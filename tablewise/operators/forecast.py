"""Forecasts: step detection, Holt smoothing of any number of series, and model rollouts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import as_double, ref, require_columns
from tablewise.operators.features import lag_features
from tablewise.operators.train import ArrayScorer, Trained, model_arrays, model_vectors, predict
from tablewise.operators.trend import as_timestamp
from tablewise.plans.jobs import list_matrix
from tablewise.plans.ordering import row_index
from tablewise.plans.shape import null_safe_join, steady

# Fixed search grid of the smoothing weights and other rules.
ALPHAS = (0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
BETAS = (0.05, 0.1, 0.2, 0.3, 0.5)
MIN_HOLT_ROWS = 4
DAY_MICROS = 86_400_000_000
BLOCK_ROWS = 50_000
CHECKPOINT_EVERY = 5
SEED_EXTRA = 5

_PAIRS = np.array([(a, b) for a in ALPHAS for b in BETAS])
_A, _B = _PAIRS[:, 0], _PAIRS[:, 1]


def infer_steps(df: DataFrame, ts: str, series: Sequence[str] = ()) -> DataFrame:
    """``series..., step_days, step``: the commonest gap (the smaller on ties) as a calendar step."""
    require_columns(df, ts, *series)
    rows = df.select(*[ref(s) for s in series], F.unix_micros(as_timestamp(df, ts)).alias("us")).where("us IS NOT NULL")
    gaps = lag_features(rows, "us", ["us"], [1], [], series, []).withColumn("gap", F.col("us") - F.col("us__lag_1"))
    counted = gaps.groupBy(*[ref(s) for s in series], "gap").agg(F.count("*").alias("n"))
    mode = F.min_by("gap", F.struct(-F.col("n"), F.col("gap")))
    days = F.floor(F.coalesce(mode, F.lit(DAY_MICROS)) / DAY_MICROS).cast("int")
    out = counted.groupBy(*[ref(s) for s in series]).agg(days.alias("step_days"))
    d = F.col("step_days")
    return out.withColumn("step", F.when(d <= 1, "1 day").when(d <= 7, "7 days").when(d <= 31, "1 month").otherwise("1 year"))


def _next(ts: Column, step: Column, times: Column) -> Column:
    """Timestamp ``times`` calendar steps later."""
    return (
        F.when(step == "1 day", ts + F.make_dt_interval(times))
        .when(step == "7 days", ts + F.make_dt_interval(times * 7))
        .when(step == "1 month", ts + F.make_ym_interval(F.lit(0), times))
        .otherwise(ts + F.make_ym_interval(times, F.lit(0)))
    )


# ---- Holt ----
# The state (level, trend) moves by s' = M s + c y with M and c fixed by (alpha, beta), so the
# steps of a block of values combine into one affine map. Blocks run in parallel, their maps
# are chained per series, and a second sweep adds up the errors. A series that holds most of
# the rows is thus spread over many tasks.


def _sweep(y: np.ndarray, level: np.ndarray, trend: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sse = np.zeros(len(_PAIRS))
    for v in y:
        ahead = level + trend
        sse += (v - ahead) ** 2
        new = _A * v + (1 - _A) * ahead
        trend = _B * (new - level) + (1 - _B) * trend
        level = new
    return level, trend, sse


def _powers(m: int) -> np.ndarray:
    step = np.stack([np.array([[1 - a, 1 - a], [-a * b, 1 - a * b]]) for a, b in _PAIRS])
    return np.linalg.matrix_power(step, m)


def holt_states(df: DataFrame, ts: str, value: str, series: Sequence[str] = (), key: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``series..., n, mean, level, trend, alpha, beta, sse`` of the best weights per series."""
    require_columns(df, ts, value, *series, *key)
    rows = df.select(*[ref(s) for s in series], as_timestamp(df, ts).alias("_ts"), as_double(df, value).alias("_y"), *[ref(k).alias(f"_k{i}") for i, k in enumerate(key)])
    rows = rows.where(F.col("_ts").isNotNull() & F.col("_y").isNotNull())
    if not series:
        rows = rows.withColumn("_s", F.lit(0))
    by = list(series) or ["_s"]
    order = ["_ts", *([f"_k{i}" for i in range(len(key))] or ["_y"])]
    indexed = row_index(rows, order, by, name="_i").withColumn("_b", F.floor(F.col("_i") / block_rows).cast("int"))
    indexed = indexed.select(*[ref(b) for b in by], "_b", "_i", "_y")
    base = [T.StructField(b, indexed.schema[b].dataType) for b in by]
    arr = T.ArrayType(T.DoubleType())

    def first_pass(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_i")
        y = block["_y"].to_numpy(dtype="float64")
        zero = np.zeros(len(_PAIRS))
        if block["_b"].iloc[0] == 0:
            level, trend, sse = _sweep(y[1:], zero + y[0], zero + (y[1] - y[0] if len(y) > 1 else 0.0))
        else:
            level, trend, _ = _sweep(y, zero, zero)
            sse = zero
        out = block.iloc[:1][[*by, "_b"]].copy()
        out["m"], out["total"] = len(y), float(y.sum())
        out["level"], out["trend"], out["sse"] = [level.tolist()], [trend.tolist()], [sse.tolist()]
        return out

    block_schema = T.StructType(
        [*base, T.StructField("_b", T.IntegerType()), T.StructField("m", T.LongType()), T.StructField("total", T.DoubleType()),
         T.StructField("level", arr), T.StructField("trend", arr), T.StructField("sse", arr)]
    )
    blocks = steady(indexed.groupBy(*by, "_b").applyInPandas(first_pass, block_schema))

    def chain(group: pd.DataFrame) -> pd.DataFrame:  # one row per block of the series
        group = group.sort_values("_b")
        level = trend = None
        starts = []
        for _, r in group.iterrows():
            shift_l, shift_t = np.array(r["level"]), np.array(r["trend"])
            if level is None:
                starts.append(([], []))
                level, trend = shift_l, shift_t
                continue
            starts.append((level.tolist(), trend.tolist()))
            p = _powers(int(r["m"]))
            level, trend = (
                p[:, 0, 0] * level + p[:, 0, 1] * trend + shift_l,
                p[:, 1, 0] * level + p[:, 1, 1] * trend + shift_t,
            )
        out = group[[*by, "_b"]].copy()
        out["l0"], out["t0"] = [s[0] for s in starts], [s[1] for s in starts]
        out["l1"], out["t1"] = [level.tolist()] * len(out), [trend.tolist()] * len(out)
        return out

    chain_schema = T.StructType([*base, T.StructField("_b", T.IntegerType()), *[T.StructField(c, arr) for c in ("l0", "t0", "l1", "t1")]])
    chained = steady(blocks.groupBy(*by).applyInPandas(chain, chain_schema))

    later = null_safe_join(indexed.where("_b > 0"), chained.select(*[ref(b) for b in by], "_b", "l0", "t0"), [*by, "_b"])

    def second_pass(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_i")
        first = block.iloc[0]
        _, _, sse = _sweep(block["_y"].to_numpy(dtype="float64"), np.array(first["l0"]), np.array(first["t0"]))
        out = block.iloc[:1][by].copy()
        out["sse"] = [sse.tolist()]
        return out

    errors = later.groupBy(*by, "_b").applyInPandas(second_pass, T.StructType([*base, T.StructField("sse", arr)]))
    sums = blocks.where("_b = 0").select(*[ref(b) for b in by], "sse").unionByName(errors)
    width = len(_PAIRS)
    total = sums.groupBy(*by).agg(F.array(*[F.sum(F.col("sse")[i]) for i in range(width)]).alias("sse"))
    sizes = blocks.groupBy(*by).agg(F.sum("m").alias("n"), (F.sum("total") / F.sum("m")).alias("mean"))
    ends = chained.where("_b = 0").select(*[ref(b) for b in by], "l1", "t1")
    joined = null_safe_join(null_safe_join(sizes, total, by), ends, by)
    best = F.array_position("sse", F.array_min("sse")).cast("int")
    pick = joined.withColumn("_k", best)

    def at(values: Sequence[float]) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("_k"))

    return pick.select(
        *[ref(s) for s in series], "n", "mean", F.element_at("l1", F.col("_k")).alias("level"), F.element_at("t1", F.col("_k")).alias("trend"),
        at(_A).alias("alpha"), at(_B).alias("beta"), F.element_at("sse", F.col("_k")).alias("sse"),
    )


def holt_forecast(
    df: DataFrame, ts: str, value: str, horizon: int, series: Sequence[str] = (), key: Sequence[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``series..., step, forecast``; fewer than four values repeat their mean."""
    states = holt_states(df, ts, value, series, key, block_rows)
    steps = states.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    ahead = F.col("level") + F.col("step") * F.col("trend")
    return steps.select(
        *[ref(s) for s in series], "step", F.when(F.col("n") < MIN_HOLT_ROWS, F.col("mean")).otherwise(ahead).alias("forecast")
    )


# ---- model rollout ----


def _tail(df: DataFrame, sort_col: str, series: Sequence[str], key: Sequence[str], keep: int) -> DataFrame:
    """Newest ``keep`` rows of each series, position 0 being the newest."""
    newest = [F.col("_when").desc(), *[ref(k).desc() for k in key]]
    dated = df.withColumn("_when", as_timestamp(df, sort_col)).where(F.col("_when").isNotNull())
    return row_index(dated, newest, series, name="_back").where(F.col("_back") < keep)


def ml_rollout(model: Trained, df: DataFrame, horizon: int, key: Sequence[str] = ()) -> DataFrame:
    """``series..., step, date, prediction``: each step scores the newest row of every series and
    appends the result as the next row (target and lag columns alike).

    The state is one row per series with its last few values. Inputs that need no prediction are made for all steps
    by the model's own preprocessing; one task then walks all steps of many series, so the plan does not grow
    with the horizon.
    """
    c = model.lag_config
    if model.task_type != "regression" or not c:
        raise ValueError("forecasting needs a regression model trained with lag features")
    series, sort_col, lags, windows = list(c.get("series") or []), c["sort_col"], c["lags"], c["windows"]
    lag_cols, target = c["lag_cols"], model.target_col
    require_columns(df, sort_col, target, *lag_cols, *series)
    need = max([*lags, *windows]) + 1
    tail = _tail(df, sort_col, series, key, need)
    raw = [f for f in model.feature_cols if f in df.columns and f != sort_col]
    carried = list(dict.fromkeys([*raw, target, *lag_cols]))
    steps = infer_steps(df, sort_col, series)
    grouped = tail.groupBy(*[ref(s) for s in series]).agg(
        F.max("_when").alias("_when"),
        *[F.max_by(ref(x), -F.col("_back")).alias(x) for x in carried],
        *[
            F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("p"), as_double(df, x).alias("v")))), lambda e: e["v"]).alias(f"_h_{x}")
            for x in lag_cols  # at most ``need`` values each
        ],
        F.count("*").alias("_n"),
    )
    state = grouped.where(F.col("_n") >= need)
    state = null_safe_join(state, steps, series) if series else state.join(F.broadcast(steps))  # one step row
    state = steady(state.drop("_n", "step_days").withColumnRenamed("step", "_step"))
    made = {}
    for x in lag_cols:
        h = F.col(f"_h_{x}")
        made.update({f"{x}__lag_{k}": F.element_at(h, -(k + 1)) for k in lags})
        for w in windows:
            past = F.slice(h, -(w + 1), w)
            made[f"{x}__roll_mean_{w}"] = F.aggregate(past, F.lit(0.0), lambda acc, v: acc + v) / w
    # dates do not depend on what is predicted: all of them are made first
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(horizon)), F.array("_when"),
        lambda seen, _: F.concat(seen, F.array(_next(F.element_at(seen, -1), F.col("_step"), F.lit(1)))),
    )
    repeated = [x for x in carried if x == target or x in lag_cols]
    simple = all(isinstance(state.schema[x].dataType, (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType)) for x in repeated)
    if model_arrays(model) is None or not simple:
        return _rollout_by_steps(model, df, state, horizon, made, series, sort_col, carried, repeated, lag_cols, need)
    walked = state.withColumn("_walk", walk).withColumn("_nth", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    walked = walked.withColumn("_when", F.element_at("_walk", F.col("_nth"))).withColumn("_on", F.to_date(F.element_at("_walk", F.col("_nth") + 1)))
    inputs = walked.drop("_walk").withColumns(made)
    if sort_col in model.feature_cols:
        inputs = inputs.withColumn(sort_col, F.col("_when").cast(df.schema[sort_col].dataType))
    past = F.array(*[F.col(f"_h_{x}") for x in lag_cols])
    rows = model_vectors(model, inputs, [*[ref(x) for x in series], F.col("_nth").alias("step"), F.col("_on").alias("date"), past.alias("_past")])
    return rows.mapInArrow(_rollout_task(model, horizon, series, repeated, state.schema), T.StructType(
        [*[rows.schema[x] for x in series], T.StructField("step", T.IntegerType()), T.StructField("date", T.DateType()), T.StructField("prediction", T.DoubleType())]
    ))


def _rollout_task(model: Trained, horizon: int, series: Sequence[str], repeated: Sequence[str], schema: T.StructType):
    """All steps of many series at once. The rows of a series lie side by side, one for each step, with inputs as far as
    they do not depend on predictions; the inputs that do are made anew from the values before each step."""
    c = model.lag_config
    lags, windows, lag_cols = c["lags"], c["windows"], c["lag_cols"]
    scorer = ArrayScorer(model)
    scale = {n: t["scale"] for n, t in zip(model.feature_names, model.terms)}
    place = {n: i for i, n in enumerate(model.feature_names)}
    whole = {x for x in repeated if isinstance(schema[x].dataType, (T.LongType, T.IntegerType, T.ShortType))}
    single = {x for x in repeated if isinstance(schema[x].dataType, T.FloatType)}

    def put(x, name, values):
        if name in place:
            fill, mean, std = scale[name]
            x[:, place[name]] = (np.where(np.isnan(values), fill, values) - mean) / std

    def roll(table: pa.Table) -> np.ndarray:
        n = table.num_rows // horizon
        inputs = list_matrix(table.column("_x").combine_chunks()).reshape(n, horizon, -1)
        past = table.column("_past").combine_chunks().take(pa.array(np.arange(n) * horizon))
        history = list_matrix(past.flatten()).reshape(n, len(lag_cols), -1)
        out, last = np.empty((n, horizon)), None
        for s in range(horizon):
            x = inputs[:, s].copy()
            for k, name in enumerate(lag_cols):
                for lag in lags:
                    put(x, f"{name}__lag_{lag}", history[:, k, -(lag + 1)])
                for w in windows:
                    end = history.shape[2] - 1
                    put(x, f"{name}__roll_mean_{w}", history[:, k, end - w : end].sum(1) / w)
            if last is not None:
                for name in repeated:
                    put(x, name, np.trunc(last) if name in whole else last.astype(np.float32).astype(float) if name in single else last)
            for i, left, right in scorer.products:
                x[:, i] = x[:, left] * x[:, right]
            last = out[:, s] = scorer.value(scorer.arrays.raw(x))
            history = np.concatenate([history[:, :, 1:], np.repeat(last[:, None, None], len(lag_cols), 1)], 2)
        return out.reshape(-1)

    def run(batches):
        held: list[pa.RecordBatch] = []
        names = [*series, "step", "date"]
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            full = table.num_rows // horizon * horizon
            if full:
                ready = table.slice(0, full).combine_chunks()
                columns = [ready.column(c).combine_chunks() for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(roll(ready))], [*names, "prediction"])
            held = table.slice(full).to_batches()

    return run


def _rollout_by_steps(model, df, state, horizon, made, series, sort_col, carried, repeated, lag_cols, need) -> DataFrame:
    """The same by the model's own pipeline, one scoring a step, for models without arrays."""
    out = None
    for s in range(1, horizon + 1):
        inputs = state.withColumns(made)
        if sort_col in model.feature_cols:
            inputs = inputs.withColumn(sort_col, F.col("_when").cast(df.schema[sort_col].dataType))
        after = predict(model, inputs).withColumn("_when", _next(F.col("_when"), F.col("_step"), F.lit(1)))
        state = after.select(
            *[ref(x) for x in series],
            "_when",
            "_step",
            *[(F.col("prediction").cast(state.schema[x].dataType) if x in repeated else ref(x)).alias(x) for x in carried],
            *[F.concat(F.slice(f"_h_{x}", 2, need), F.array("prediction")).alias(f"_h_{x}") for x in lag_cols],
            F.col("prediction").alias("_pred"),
        )
        state = steady(state) if s % CHECKPOINT_EVERY == 0 else state
        row = state.select(*[ref(x) for x in series], F.lit(s).alias("step"), F.to_date("_when").alias("date"), F.col("_pred").alias("prediction"))
        state = state.drop("_pred")
        out = row if out is None else out.unionByName(row)
    return out


def forecast_intervals(forecast: DataFrame, halfwidth: float, log_target: bool = False) -> DataFrame:
    """Band that widens with the root of the step."""
    wide = F.lit(halfwidth) * F.sqrt(F.col("step"))
    low = F.col("prediction") - wide
    return forecast.withColumns({"lower_90": F.greatest(low, F.lit(0.0)) if log_target else low, "upper_90": F.col("prediction") + wide})


def forecast_with_model(model: Trained, df: DataFrame, horizon: int = 30, key: Sequence[str] = ()) -> DataFrame:
    out = ml_rollout(model, df, horizon, key)
    return out if model.conformal_halfwidth is None else forecast_intervals(out, model.conformal_halfwidth, model.log_target)


def forecast_holdout(model: Trained, df: DataFrame, horizon: int, key: Sequence[str] = ()) -> DataFrame:
    """``series..., ml_mae, holt_mae, winner`` on the last ``horizon`` rows of each long enough series."""
    c = model.lag_config
    series, sort_col, target = list(c.get("series") or []), c["sort_col"], model.target_col
    needed = max([*c["lags"], *c["windows"]]) + SEED_EXTRA + 2 * horizon
    dated = df.withColumn("_when", as_timestamp(df, sort_col)).where(F.col("_when").isNotNull())
    ranked = row_index(dated, [F.col("_when").desc(), *[ref(k).desc() for k in key]], series, name="_back")
    sizes = ranked.groupBy(*[ref(s) for s in series]).agg(F.max("_back").alias("_last"))
    long_enough = sizes.where(F.col("_last") + 1 >= needed).drop("_last")
    usable = null_safe_join(ranked, long_enough, series, "left_semi") if series else ranked
    if not series and (sizes.first()["_last"] or 0) + 1 < needed:
        raise ValueError(f"need at least {needed} rows")
    past = usable.where(F.col("_back") >= horizon).select(*[ref(x) for x in df.columns])
    held = usable.where(F.col("_back") < horizon).select(
        *[ref(s) for s in series], (F.lit(horizon) - F.col("_back")).cast("int").alias("step"), as_double(df, target).alias("y")
    )
    ml = ml_rollout(model, past, horizon, key).select(*[ref(s) for s in series], "step", "prediction")
    holt = holt_forecast(past, sort_col, target, horizon, series, key).select(*[ref(s) for s in series], "step", "forecast")
    both = null_safe_join(null_safe_join(held, ml, [*series, "step"]), holt, [*series, "step"])
    maes = both.groupBy(*[ref(s) for s in series]).agg(
        F.round(F.avg(F.abs(F.col("y") - F.col("prediction"))), 4).alias("ml_mae"), F.round(F.avg(F.abs(F.col("y") - F.col("forecast"))), 4).alias("holt_mae")
    )
    return maes.withColumn("winner", F.when(F.col("ml_mae") <= F.col("holt_mae"), "ml").otherwise("holt"))
