"""Model explanation: permutation importance, Shapley values, dependence curves, what-if."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import as_double, as_text, kinds, limited, ref, require_columns
from tablewise.operators.evaluate import _per_label
from tablewise.operators.profile import categorical_summary
from tablewise.operators.train import ArrayScorer, Trained, model_arrays, model_vectors, predict
from tablewise.plans.jobs import list_matrix
from tablewise.plans.ordering import row_index
from tablewise.plans.quantiles import exact_quantiles
from tablewise.plans.shape import rows_from_aggregate, steady

# Fixed defaults.
REPEATS = 10
DRAWS = 20
GRID = 20
ICE_ROWS = 20
LOW, HIGH = 0.05, 0.95
SEED = 42


def scored(model: Trained, df: DataFrame, name: str = "_score") -> DataFrame:
    """Prediction as one number: the value, p of the second class, or the largest p."""
    out = predict(model, df)
    if model.task_type == "regression":
        return out.withColumnRenamed("prediction", name)
    p = F.col("probability")
    return out.withColumn(name, p[1] if len(model.labels) == 2 else F.array_max(p)).drop("prediction", "probability")


def _mixed(df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows numbered in a random but repeatable order; a cyclic shift of it is a permutation."""
    out = row_index(df.withColumn("_h", F.xxhash64(*[ref(k) for k in key], F.lit(SEED))), ["_h", *key], name="_i").drop("_h")
    return out, out.count()


def _shifts(n: int, count: int) -> list[int]:
    rng = np.random.default_rng(SEED)
    return [int(x) for x in rng.integers(1, max(n, 2), size=count)]


def _with_donor(rows: DataFrame, source: DataFrame, n: int, shifts: Sequence[int], cols: Sequence[str], draw: str) -> DataFrame:
    """One copy per draw, each with the feature values of another row as ``_d_<feature>``."""
    offsets = F.array(*[F.lit(s) for s in shifts])
    copies = rows.withColumn(draw, F.explode(F.sequence(F.lit(0), F.lit(len(shifts) - 1))))
    copies = copies.withColumn("_j", F.pmod(F.col("_i") + F.element_at(offsets, F.col(draw) + 1), F.lit(n)))
    donors = source.select(F.col("_i").alias("_j"), *[ref(c).alias(f"_d_{c}") for c in cols])
    return copies.join(donors, "_j").drop("_j")


def _lists(matrix: np.ndarray) -> pa.Array:
    at = pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32())
    return pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def _based(model: Trained, df: DataFrame, keep: Sequence[Column]) -> DataFrame:
    """``keep..., _x, _s``: input vectors with the sums that the model gives them."""
    shared = df.sparkSession.sparkContext.broadcast(ArrayScorer(model))  # a fitted model

    def run(batches):
        for batch in batches:
            raw = shared.value.arrays.raw(list_matrix(batch.column("_x"))) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(raw)], [*batch.schema.names, "_s"])

    rows = model_vectors(model, df, keep)
    schema = T.StructType([*rows.schema.fields, T.StructField("_s", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


def permutation_importance(model: Trained, df: DataFrame, key: Sequence[str], n_repeats: int = REPEATS) -> DataFrame:
    """Mean and deviation of the score drop (weighted F1 or R2) when a feature is shuffled.

    Every row meets one other row per repeat, whatever the number of features: a task swaps one feature at a
    time and adds up what changes in the stored score.
    """
    cols = model.feature_cols
    require_columns(df, *cols, model.target_col, *key)
    if model_arrays(model) is None:
        return _drops(*_permuted_by_copies(model, df, key, n_repeats))
    rows, n = _mixed(df.select(*[ref(c) for c in dict.fromkeys([*key, *cols, model.target_col])]), key)
    classes = model.task_type == "classification"
    target = as_text(rows, model.target_col) if classes else as_double(rows, model.target_col)
    based = steady(_based(model, rows, [F.col("_i"), target.alias("_y")]))
    copies = _with_donor(based, based, n, _shifts(n, n_repeats), ["_x"], "_r").select("_r", "_y", "_x", "_s", "_d__x")
    shared = df.sparkSession.sparkContext.broadcast((ArrayScorer(model), list(model.labels)))

    def cells(feature, repeat, y, raw, scorer, labels):
        """Sums of one batch: squared errors, or counts of actual and predicted."""
        if classes:
            code = y.dictionary_encode()
            known, names = code.indices.to_numpy(zero_copy_only=False), code.dictionary.to_pylist()
            guess, there = scorer.chances(raw).argmax(1), ~np.isnan(known.astype(float))
            key_ = ((repeat * (len(names) + 1) + np.where(there, known, len(names)).astype(np.int64)) * len(labels) + guess)[there]
            found, count = np.unique(key_, return_counts=True)
            for k, c in zip(found.tolist(), count.tolist()):
                rest, g = divmod(k, len(labels))
                r, a = divmod(rest, len(names) + 1)
                yield feature, r, names[a], labels[g], float(c)
        else:
            value = y.to_numpy(zero_copy_only=False).astype(float)
            error = (scorer.value(raw) - value) ** 2
            good = ~np.isnan(value)
            for r, e in enumerate(np.bincount(repeat[good], error[good], n_repeats).tolist()):
                yield feature, r, None, None, e

    kinds_ = "feature string, _r int, actual string, prediction string, n double"

    def emit(rows_):
        columns = list(zip(*rows_)) or [[]] * 5
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["feature", "_r", "actual", "prediction", "n"])

    def shuffled(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            scorer, labels = shared.value
            x, z, raw = (list_matrix(batch.column(c)) for c in ("_x", "_d__x", "_s"))
            repeat = batch.column("_r").to_numpy(zero_copy_only=False).astype(np.int64)
            out = []
            for c in cols:
                new = scorer.mixed(x, z, c)
                out += cells(c, repeat, batch.column("_y"), scorer.changed(x, new, raw, c), scorer, labels)
            yield emit(out)

    def plain(batches):
        for batch in batches:
            if batch.num_rows:
                scorer, labels = shared.value
                yield emit(list(cells("", np.zeros(batch.num_rows, np.int64), batch.column("_y"), list_matrix(batch.column("_s")), scorer, labels)))

    every = copies.mapInArrow(shuffled, kinds_).unionByName(based.select("_y", "_s").mapInArrow(plain, kinds_))
    every = every.withColumnRenamed("feature", "_feature")
    if classes:
        sums = every.groupBy("_feature", "_r", "actual", "prediction").agg(F.sum("n").cast("long").alias("n"))
        scores = _f1_scores(sums)
    else:
        whole = based.agg((F.var_pop("_y") * F.count("_y")).alias("_v"))
        sums = every.groupBy("_feature", "_r").agg(F.sum("n").alias("_e"))
        scores = sums.join(F.broadcast(whole)).select("_feature", "_r", (1 - F.col("_e") / F.nullif("_v", F.lit(0.0))).alias("s"))  # one row
        scores = scores.where("_feature <> '' OR _r = 0")
    return _drops(scores)


def _f1_scores(cells: DataFrame) -> DataFrame:
    by = ["_feature", "_r"]
    return _per_label(cells, by).groupBy(*by).agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("s"))


def _permuted_by_copies(model: Trained, df: DataFrame, key: Sequence[str], n_repeats: int) -> tuple[DataFrame]:
    """Scores of every shuffled copy by the model's own pipeline, for models that are no sum of terms or trees."""
    cols = model.feature_cols
    rows, n = _mixed(df.select(*[ref(c) for c in dict.fromkeys([*key, *cols, model.target_col])]), key)
    copies = _with_donor(rows, rows, n, _shifts(n, n_repeats), cols, "_r")
    names = F.array(*[F.lit(c) for c in cols])
    shuffled = copies.withColumn("_feature", F.explode(names)).withColumns(
        {c: F.when(F.col("_feature") == c, ref(f"_d_{c}")).otherwise(ref(c)) for c in cols}
    )
    keep = [*dict.fromkeys([*key, *cols, model.target_col])]
    base = rows.select(*[ref(c) for c in keep], F.lit("").alias("_feature"), F.lit(0).alias("_r"))
    every = shuffled.select(*[ref(c) for c in keep], "_feature", "_r").unionByName(base)
    out = predict(model, every)
    by = ["_feature", "_r"]
    if model.task_type == "classification":
        cells = (
            out.groupBy(*by, as_text(out, model.target_col).alias("actual"), "prediction")
            .agg(F.count("*").alias("n"))
            .where(F.col("actual").isNotNull())
        )
        return (_f1_scores(cells),)
    y = as_double(out, model.target_col)
    return (
        out.groupBy(*by).agg(
            (1 - F.sum(F.pow(F.col("prediction") - y, 2)) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("s")
        ),
    )


def _drops(scores: DataFrame) -> DataFrame:
    scores = steady(scores)  # one row for each feature and repeat, read twice
    whole = scores.where("_feature = ''").select(F.col("s").alias("_base"), F.lit(1).alias("_one"))
    drops = scores.where("_feature <> ''").withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one")  # one row
    return (
        drops.groupBy(F.col("_feature").alias("feature"))
        .agg(F.avg(F.col("_base") - F.col("s")).alias("importance_mean"), F.stddev_pop(F.col("_base") - F.col("s")).alias("importance_std"))
        .orderBy(F.col("importance_mean").desc(), "feature")
    )


# ---- linear models ----


def linear_importance(df: DataFrame, coefs: dict[str, float]) -> DataFrame:
    """``feature, mean_abs, mean_signed, std`` of coef * (x - mean) over all rows."""
    x = {c: as_double(df, c) for c in coefs}
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x.values())]).first()
    part = {c: F.lit(float(w)) * (x[c] - F.lit(means[f"m{i}"])) for i, (c, w) in enumerate(coefs.items())}
    agg = df.agg(
        *[F.avg(F.abs(v)).alias(f"a{i}") for i, v in enumerate(part.values())],
        *[F.avg(v).alias(f"s{i}") for i, v in enumerate(part.values())],
        *[F.stddev_pop(v).alias(f"d{i}") for i, v in enumerate(part.values())],
    )
    rows = rows_from_aggregate(
        agg,
        [
            F.struct(
                F.lit(c).alias("feature"), F.col(f"a{i}").alias("mean_abs"), F.col(f"s{i}").alias("mean_signed"), F.col(f"d{i}").alias("std")
            )
            for i, c in enumerate(coefs)
        ],
    )
    return rows.orderBy(F.col("mean_abs").desc(), "feature")


def linear_contributions(df: DataFrame, coefs: dict[str, float], key: Sequence[str]) -> DataFrame:
    """``key..., feature, contribution`` of every row."""
    x = {c: as_double(df, c) for c in coefs}
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x.values())]).first()
    parts = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), (F.lit(float(w)) * (x[c] - F.lit(means[f"m{i}"]))).alias("contribution"))
            for i, (c, w) in enumerate(coefs.items())
        ]
    )
    return df.select(*[ref(k) for k in key], F.explode(parts).alias("p")).select(*[ref(k) for k in key], "p.*")


def linear_shap(model: Trained, df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key..., feature, contribution`` of a linear or logistic model, on its own inputs."""
    last = model.pipeline.stages[-1]
    if hasattr(last, "coefficientMatrix"):
        weights = last.coefficientMatrix.toArray()[-1]
    elif hasattr(last, "coefficients"):
        weights = last.coefficients.toArray()
    else:
        raise ValueError("not a linear model")
    rows = df
    for s in model.pipeline.stages[:-1]:
        rows = s.transform(rows)
    rows = rows.select(*[ref(k) for k in key], vector_to_array("_features").alias("_v"))
    means = rows.agg(*[F.avg(F.col("_v")[i]).alias(f"m{i}") for i in range(len(weights))]).first()
    parts = F.array(
        *[
            F.struct(F.lit(name).alias("feature"), (F.lit(float(weights[i])) * (F.col("_v")[i] - F.lit(means[f"m{i}"]))).alias("contribution"))
            for i, name in enumerate(model.feature_names)
        ]
    )
    return rows.select(*[ref(k) for k in key], F.explode(parts).alias("p")).select(*[ref(k) for k in key], "p.*")


def summarise_contributions(contributions: DataFrame) -> DataFrame:
    v = F.col("contribution")
    return (
        contributions.groupBy("feature")
        .agg(F.avg(F.abs(v)).alias("mean_abs"), F.avg(v).alias("mean_signed"), F.stddev_pop(v).alias("std"))
        .orderBy(F.col("mean_abs").desc(), "feature")
    )


# ---- any model ----


def shapley_sampling(
    model: Trained, df: DataFrame, key: Sequence[str], draws: int = DRAWS, rows: DataFrame | None = None
) -> DataFrame:
    """``key..., feature, contribution``: Shapley values by sampled feature orders.

    In each draw another row of ``df`` turns into the row one feature at a time; what a step changes in the
    score counts for the feature it switched. ``rows`` limits what is explained, not the background. A row meets
    one other row per draw; the steps are walked inside the task.
    """
    cols = model.feature_cols
    if model_arrays(model) is None:
        return _shapley_by_copies(model, df, key, draws, rows)
    base, n = _mixed(df.select(*[ref(c) for c in dict.fromkeys([*key, *cols])]), key)
    base = steady(model_vectors(model, base, [F.col("_i"), *[ref(c) for c in key]]))
    target = base if rows is None else base.join(rows.select(*[ref(c) for c in key]).distinct(), list(key), "left_semi")
    rng = np.random.default_rng(SEED)
    orders = [[int(i) for i in rng.permutation(len(cols))] for _ in range(draws)]
    copies = _with_donor(target, base, n, _shifts(n, draws), ["_x"], "_draw")
    shared = df.sparkSession.sparkContext.broadcast(ArrayScorer(model))
    names = list(key)

    def run(batches):
        for batch in batches:
            scorer, parts = shared.value, np.zeros((batch.num_rows, len(cols)))
            if batch.num_rows:
                x, z = (list_matrix(batch.column(c)) for c in ("_x", "_d__x"))
                draw = batch.column("_draw").to_numpy(zero_copy_only=False)
            for d in np.unique(draw).tolist() if batch.num_rows else []:
                mine = np.flatnonzero(draw == d)
                now, own = z[mine], x[mine]
                raw = scorer.arrays.raw(now)
                before = scorer.value(raw)
                for i in orders[d]:
                    new = scorer.mixed(now, own, cols[i])
                    raw = scorer.changed(now, new, raw, cols[i])
                    after = scorer.value(raw)
                    parts[mine, i] = after - before
                    now, before = new, after
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], _lists(parts)], [*names, "_c"])

    schema = T.StructType([*[base.schema[c] for c in names], T.StructField("_c", T.ArrayType(T.DoubleType()))])
    found = copies.select(*[ref(c) for c in names], "_draw", "_x", "_d__x").mapInArrow(run, schema)
    sums = found.groupBy(*[ref(c) for c in names]).agg(*[(F.sum(F.col("_c")[i]) / draws).alias(f"_c{i}") for i in range(len(cols))])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_c{i}").alias("contribution")) for i, c in enumerate(cols)])
    return sums.select(*[ref(c) for c in names], F.explode(pairs).alias("s")).select(*[ref(c) for c in names], "s.*")


def _shapley_by_copies(model: Trained, df: DataFrame, key: Sequence[str], draws: int, rows: DataFrame | None) -> DataFrame:
    """The same with every hybrid as a row of one scoring pass by the model's own pipeline."""
    cols = model.feature_cols
    base, n = _mixed(df.select(*[ref(c) for c in dict.fromkeys([*key, *cols])]), key)
    target = base if rows is None else base.join(rows.select(*[ref(k) for k in key]).distinct(), list(key), "left_semi")
    k = len(cols)
    rng = np.random.default_rng(SEED)
    orders = [[int(i) for i in rng.permutation(k)] for _ in range(draws)]  # orders[d][place] = feature
    places = {c: [o.index(i) for o in orders] for i, c in enumerate(cols)}
    copies = _with_donor(target, base, n, _shifts(n, draws), cols, "_draw")
    copies = copies.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(k))))
    own = {c: F.element_at(F.array(*[F.lit(p) for p in places[c]]), F.col("_draw") + 1) < F.col("_step") for c in cols}
    hybrids = copies.withColumns({c: F.when(own[c], ref(c)).otherwise(ref(f"_d_{c}")) for c in cols})
    out = scored(model, hybrids.drop(*[f"_d_{c}" for c in cols]))
    flat = F.array(*[F.lit(cols[i]) for o in orders for i in o])
    at = F.col("_draw") * k + F.col("_step")
    gain = F.when(F.col("_step") > 0, F.struct(F.try_element_at(flat, F.greatest(at, F.lit(1))).alias("feature"), F.col("_score").alias("v")))
    loss = F.when(F.col("_step") < k, F.struct(F.try_element_at(flat, F.least(at + 1, F.lit(k * draws))).alias("feature"), (-F.col("_score")).alias("v")))
    sides = F.filter(F.array(gain, loss), lambda s: s.isNotNull())
    return (
        out.select(*[ref(c) for c in key], F.explode(sides).alias("s"))
        .groupBy(*[ref(c) for c in key], F.col("s.feature").alias("feature"))
        .agg((F.sum("s.v") / draws).alias("contribution"))
    )


def _grid(df: DataFrame, cols: Sequence[str], points: int) -> list[tuple[str, float | None, str | None]]:
    kind = kinds(df)
    nums = [c for c in cols if kind[c] == "numeric"]
    cats = [c for c in cols if kind[c] != "numeric"]
    out: list[tuple[str, float | None, str | None]] = []
    if nums:
        for r in exact_quantiles(df, nums, [LOW, HIGH]).collect():
            lo, hi = r["quantiles"]
            out += [(r["column"], float(x), None) for x in np.linspace(lo, hi, points)]
    if cats:
        out += [(r["name"], None, r["value"]) for r in categorical_summary(df, cats, top=GRID).collect()]
    return out


def _on_grid(model: Trained, df: DataFrame, grid: Sequence[tuple], keep: Sequence[str]) -> DataFrame:
    """Every row at every grid value of every feature, scored in one pass."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.lit(x).cast("double").alias("value"), F.lit(t).cast("string").alias("text_value"))
            for c, x, t in grid
        ]
    )
    copies = df.withColumn("_g", F.explode(cells))
    varied = dict.fromkeys(c for c, _, _ in grid)
    numeric = {c for c, x, _ in grid if x is not None}
    set_to = {
        c: F.when(F.col("_g.feature") == c, F.col("_g.value") if c in numeric else F.col("_g.text_value").cast(df.schema[c].dataType)).otherwise(
            ref(c).cast("double") if c in numeric else ref(c)
        )
        for c in varied
    }
    out = scored(model, copies.withColumns(set_to))
    return out.select(*[ref(k) for k in keep], "_g.feature", "_g.value", "_g.text_value", F.col("_score").alias("score"))


def partial_dependence(
    model: Trained, df: DataFrame, feature_cols: Sequence[str] | None = None, points: int = GRID, sample: float | None = None
) -> DataFrame:
    """``feature, value, text_value, mean_prediction`` over all rows.

    A task sets one feature after the other to its grid values and adds up the changed scores; no row is copied.
    """
    cols = list(feature_cols or [c for c in model.feature_cols if c in df.columns])
    require_columns(df, *cols)
    grid = _grid(df, cols, points)
    if model_arrays(model) is None:
        rows = _on_grid(model, limited(df, sample), grid, [])
        return rows.groupBy("feature", "value", "text_value").agg(F.avg("score").alias("mean_prediction"))
    spark, kind = df.sparkSession, kinds(df)
    cells = spark.createDataFrame([(i, *g) for i, g in enumerate(grid)], "_cell int, feature string, value double, text_value string")
    # the inputs of every grid value, from a table of one row a value; no more than the points of the features
    given = {
        c: F.when(F.col("feature") == c, F.col("value") if kind[c] == "numeric" else F.col("text_value").cast(df.schema[c].dataType))
        if c in cols
        else F.lit(None).cast(df.schema[c].dataType)
        for c in df.columns
    }
    inputs = cells.select("_cell", *[v.alias(c) for c, v in given.items()])
    wanted = {r["_cell"]: r["_x"] for r in model_vectors(model, inputs, [F.col("_cell")]).collect()}
    shared = spark.sparkContext.broadcast((ArrayScorer(model), [(c, np.array([wanted[i]])) for i, (c, _, _) in enumerate(grid)]))

    def run(batches):
        scorer, values = shared.value
        total, n = np.zeros(len(values)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = list_matrix(batch.column("_x"))
            raw, n = scorer.arrays.raw(x), n + len(x)
            for i, (c, z) in enumerate(values):
                new = scorer.mixed(x, np.broadcast_to(z, x.shape), c)
                total[i] += scorer.value(scorer.changed(x, new, raw, c)).sum()
        at = np.arange(len(values), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total), pa.array(np.full(len(values), n))], ["_cell", "_t", "_n"])

    sums = model_vectors(model, limited(df, sample), []).mapInArrow(run, "_cell int, _t double, _n long")
    means = sums.groupBy("_cell").agg((F.sum("_t") / F.nullif(F.sum("_n"), F.lit(0))).alias("mean_prediction")).where("mean_prediction IS NOT NULL")
    return means.join(F.broadcast(cells), "_cell").select("feature", "value", "text_value", "mean_prediction")


def ice_curves(model: Trained, df: DataFrame, feature_col: str, key: Sequence[str], n_rows: int = ICE_ROWS, points: int = GRID) -> DataFrame:
    """One curve per row for the first ``n_rows`` by key; the grid comes from all rows."""
    require_columns(df, feature_col, *key)
    rows = df.orderBy(*[ref(k) for k in key]).limit(n_rows)
    return _on_grid(model, rows, _grid(df, [feature_col], points), key)


def what_if(model: Trained, df: DataFrame, overrides: DataFrame, key: Sequence[str]) -> DataFrame:
    """Original and new prediction for every row that an override row names.

    ``overrides`` holds the key and any feature columns; NULL leaves a value as it is.
    """
    changed = [c for c in overrides.columns if c not in key]
    unknown = [c for c in changed if c not in model.feature_cols]
    if unknown:
        raise ValueError(f"not features of the model: {unknown}")
    named = overrides.select(*[ref(k) for k in key], *[ref(c).alias(f"_o_{c}") for c in changed])
    rows = df.join(named, list(key))
    both = rows.withColumn("_new", F.explode(F.array(F.lit(False), F.lit(True)))).withColumns(
        {c: F.when(F.col("_new"), F.coalesce(ref(f"_o_{c}"), ref(c))).otherwise(ref(c)) for c in changed}
    )
    out = predict(model, both.drop(*[f"_o_{c}" for c in changed]))
    label = model.task_type == "classification"

    def pick(c: Column, new: bool) -> Column:
        return F.max(F.when(F.col("_new") == new, c))

    keys = [ref(k) for k in key]
    if label:
        p = F.array_max("probability")
        wide = out.groupBy(*keys).agg(
            pick(F.col("prediction"), False).alias("original"), pick(F.col("prediction"), True).alias("changed"),
            (pick(p, True) - pick(p, False)).alias("delta"),
        )
        return wide.withColumn("class_changed", F.col("original") != F.col("changed"))
    wide = out.groupBy(*keys).agg(pick(F.col("prediction"), False).alias("original"), pick(F.col("prediction"), True).alias("changed"))
    return wide.withColumn("delta", F.col("changed") - F.col("original"))
