"""Feature checks and feature engineering."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import (
    adjusted_skewness,
    as_double,
    as_text,
    kinds,
    numeric_columns,
    pearson,
    present,
    ref,
    require_columns,
)
from tablewise.operators.trend import as_timestamp
from tablewise.plans.ordering import row_index
from tablewise.plans.quantiles import exact_quantiles
from tablewise.plans.shape import discard, long_form, null_safe_join, rows_from_aggregate, stored

# Fixed limits and thresholds.
MIN_STD = 1e-8
COLLINEAR = 0.95
ONE_HOT_LEVELS = 50
TARGET_LEVELS = 500
TARGET_UNIQUE_SHARE = 0.5
TEXT_WORDS = 3
PARSE_SHARE = 0.9
LOG_SKEW = 1.5
MAX_CLASSES = 20
LAGS, WINDOWS = (1, 7), (7,)
ID_NAME = re.compile(
    r"^(row[_\s]?(num(ber)?|id|index|no)|rownum|rowid|rowindex|record[_\s]?(num(ber)?|id|no)|line[_\s]?(num(ber)?|no)|"
    r"seq(uence)?[_\s]?num(ber)?)$",
    re.IGNORECASE,
)

BLOCK_ROWS = 100_000


# ---- checks ----


def select_features(df: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """``feature, kept, reason, partner``: near-constant and collinear columns are dropped.

    One aggregate measures everything; the greedy choice then runs over at most k x k numbers.
    """
    require_columns(df, *feature_cols)
    kind = kinds(df)
    cols = list(feature_cols)
    nums = [c for c in cols if kind[c] == "numeric"]
    rest = [c for c in cols if kind[c] != "numeric"]
    x = {c: as_double(df, c) for c in nums}
    pairs = list(combinations(nums, 2))
    parts = [F.stddev_samp(x[c]).alias(f"s{i}") for i, c in enumerate(nums)]
    parts += [F.count_distinct(as_text(df, c)).alias(f"u{i}") for i, c in enumerate(rest)]
    main = df.agg(*parts).first() if parts else None
    corr = {}
    for start in range(0, len(pairs), 200):
        batch = pairs[start : start + 200]
        row = df.agg(*[pearson(x[a], x[b]).alias(f"r{k}") for k, (a, b) in enumerate(batch)]).first()
        corr.update({p: row[f"r{k}"] for k, p in enumerate(batch)})
    std = {c: main[f"s{i}"] for i, c in enumerate(nums)}
    distinct = {c: main[f"u{i}"] for i, c in enumerate(rest)}
    fate: dict[str, tuple[str, str | None]] = {}
    for c in cols:
        if (c in std and std[c] is not None and std[c] < MIN_STD) or (c in distinct and distinct[c] <= 1):
            fate[c] = ("near_constant", None)
    alive = [c for c in nums if c not in fate]
    for a, b in combinations(alive, 2):
        r = corr[(a, b)]
        if a in fate or b in fate or r is None or not abs(r) > COLLINEAR:
            continue
        loser, winner = (b, a) if std[a] >= std[b] else (a, b)
        fate[loser] = ("collinear", winner)
    rows = [(c, c not in fate, *(fate.get(c) or (None, None))) for c in cols]
    return df.sparkSession.createDataFrame(rows, "feature string, kept boolean, reason string, partner string")


def split_feature_types(df: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """``feature, role``: datetime, numeric, one_hot, target_encoded, text or dropped."""
    require_columns(df, *feature_cols)
    kind = kinds(df)
    texts = [c for c in feature_cols if kind[c] == "categorical"]
    parts = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(texts):
        value = as_text(df, c)
        words = F.size(F.filter(F.split(value, r"\s+"), lambda w: w != ""))
        parts += [
            F.count(value).alias(f"n{i}"),
            F.count(as_timestamp(df, c)).alias(f"p{i}"),
            F.avg(F.when(value.isNotNull(), words)).alias(f"w{i}"),
        ]
    row = df.agg(*parts).first()
    unique = df.agg(*[F.count_distinct(as_text(df, c)).alias(f"u{i}") for i, c in enumerate(texts)]).first() if texts else {}
    roles = []
    for c in feature_cols:
        if kind[c] != "categorical":
            roles.append((c, "datetime" if kind[c] == "datetime" else "numeric"))
            continue
        i, n = texts.index(c), max(row["n"], 1)
        u = unique[f"u{i}"]
        if row[f"n{i}"] and row[f"p{i}"] / row[f"n{i}"] >= PARSE_SHARE:
            role = "datetime"
        elif u <= ONE_HOT_LEVELS:
            role = "one_hot"
        elif u <= TARGET_LEVELS and u / n <= TARGET_UNIQUE_SHARE:
            role = "target_encoded"
        else:
            role = "text" if (row[f"w{i}"] or 0) > TEXT_WORDS else "dropped"
        roles.append((c, role))
    return df.sparkSession.createDataFrame(roles, "feature string, role string")


def looks_like_id(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``column, is_id``: a row-number name, or gap-free unique integers."""
    cols = list(cols or numeric_columns(df))
    whole = [c for c in cols if isinstance(df.schema[c].dataType, T.IntegralType)]
    parts = [
        f.alias(f"{t}{i}")
        for i, c in enumerate(whole)
        for t, f in (("n", F.count(ref(c))), ("l", F.min(ref(c))), ("h", F.max(ref(c))))
    ]
    ends = df.agg(*parts).first() if whole else {}
    # Only a column whose range equals its count can be gap-free, so distinct values are
    # counted for those alone.
    dense = [c for i, c in enumerate(whole) if ends[f"n{i}"] > 1 and ends[f"h{i}"] - ends[f"l{i}"] == ends[f"n{i}"] - 1]
    unique = df.agg(*[F.count_distinct(ref(c)).alias(f"u{i}") for i, c in enumerate(dense)]).first() if dense else {}
    rows = []
    for c in cols:
        named = bool(ID_NAME.match(c.strip().lower().replace(" ", "_").replace("-", "_")))
        full = c in dense and unique[f"u{dense.index(c)}"] == ends[f"n{whole.index(c)}"]
        rows.append((c, named or full))
    return df.sparkSession.createDataFrame(rows, "column string, is_id boolean")


def should_log_transform(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, log_transform``: non-negative with adjusted skewness above 1.5."""
    x = [as_double(df, c) for c in cols]
    agg = df.agg(
        *[F.min(v).alias(f"l{i}") for i, v in enumerate(x)], *[adjusted_skewness(v).alias(f"s{i}") for i, v in enumerate(x)]
    )
    return rows_from_aggregate(
        agg,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.coalesce((F.col(f"l{i}") >= 0) & (F.col(f"s{i}") > LOG_SKEW), F.lit(False)).alias("log_transform"),
            )
            for i, c in enumerate(cols)
        ],
    )


def log_target(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.log1p(as_double(df, col)))


def invert_log_target(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.expm1(ref(col)))


def infer_task_type(df: DataFrame, target: str, task_hint: str = "auto") -> str:
    if task_hint != "auto":
        return task_hint
    x = as_double(df, target)
    row = df.agg(F.avg(x.isNotNull().cast("double")).alias("share"), F.count_distinct(x).alias("u")).first()
    return "regression" if (row["share"] or 0) >= PARSE_SHARE and row["u"] > MAX_CLASSES else "classification"


def task_types(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The same rule for several columns in one pass: ``column, task_type``."""
    x = [as_double(df, c) for c in cols]
    agg = df.agg(
        *[F.avg(v.isNotNull().cast("double")).alias(f"p{i}") for i, v in enumerate(x)],
        *[F.count_distinct(v).alias(f"u{i}") for i, v in enumerate(x)],
    )
    return rows_from_aggregate(
        agg,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.when((F.col(f"p{i}") >= PARSE_SHARE) & (F.col(f"u{i}") > MAX_CLASSES), "regression")
                .otherwise("classification")
                .alias("task_type"),
            )
            for i, c in enumerate(cols)
        ],
    )


def detect_leakage(
    df: DataFrame, feature_cols: Sequence[str], target_col: str, corr_high: float = 0.95, corr_medium: float = 0.85
) -> DataFrame:
    """``feature, risk, correlation, reason``: near-copies of the target, by value or by name."""
    require_columns(df, target_col, *feature_cols)
    nums = [c for c in feature_cols if kinds(df)[c] == "numeric"]
    target = as_double(df, target_col)
    parsed = df.agg(F.avg(target.isNotNull().cast("double")).alias("p")).first()["p"] or 0.0
    rows = df
    if parsed < 0.5:
        levels = df.select(as_text(df, target_col).alias("_level")).where(F.col("_level").isNotNull()).distinct()
        codes = row_index(levels, ["_level"], name="_code")
        rows = df.withColumn("_level", as_text(df, target_col)).join(codes, "_level", "left")
        target = F.coalesce(F.col("_code"), F.lit(-1)).cast("double")  # a missing category has code -1
    found = rows.agg(*[pearson(as_double(df, c), target).alias(f"r{i}") for i, c in enumerate(nums)]).first() if nums else {}
    out, flagged = [], set()
    for i, c in enumerate(nums):
        r = found[f"r{i}"]
        if r is None or r != r or abs(r) < corr_medium:
            continue
        out.append((c, "high" if abs(r) >= corr_high else "medium", round(abs(r), 3), "correlation"))
        flagged.add(c)
    plain = target_col.lower().replace("_", "").replace(" ", "")
    for c in feature_cols:
        name = c.lower().replace("_", "").replace(" ", "")
        if c not in flagged and ((len(plain) >= 4 and plain in name) or (len(name) >= 4 and name in plain)):
            out.append((c, "medium", None, "name_similarity"))
    out.sort(key=lambda w: (w[1] != "high", -(w[2] or 0)))
    return df.sparkSession.createDataFrame(out, "feature string, risk string, correlation double, reason string")


# ---- engineering ----


def lag_features(
    df: DataFrame,
    sort_col: str,
    lag_cols: Sequence[str],
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    partition_by: Sequence[str] = (),
    key: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Earlier values and means of the previous rows; rows lacking a lag are dropped.

    Rows get their global position (per series), positions are cut into blocks, and each block
    receives a copy of the last few rows of the block before. Every window then works within
    one block, so neither a single series nor the whole table passes through one task.
    """
    cols = [c for c in lag_cols if c in df.columns]
    require_columns(df, sort_col, *partition_by, *key)
    tie = [ref(k) for k in key] or [F.xxhash64(*[ref(c) for c in df.columns])]
    ordered = row_index(df, [sort_col, *tie], partition_by, name="_i")
    reach = max([*lags, *windows])
    size = max(block_rows, reach + 1)
    block = F.floor(F.col("_i") / size).cast("long")
    near_end = F.pmod(F.col("_i"), F.lit(size)) >= size - reach
    copies = F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))
    spread = ordered.withColumn("_own", block).withColumn("_block", F.explode(copies))
    over = Window.partitionBy(*[ref(p) for p in partition_by], "_block").orderBy("_i")
    made: dict[str, Column] = {}
    for c in cols:
        for k in lags:
            made[f"{c}__lag_{k}"] = F.lag(present(df, c), k).over(over)
        for w in windows:
            made[f"{c}__roll_mean_{w}"] = F.avg(as_double(df, c)).over(over.rowsBetween(-w, -1))
    out = spread.withColumns(made).where(F.col("_own") == F.col("_block")).drop("_i", "_own", "_block")
    strict = [n for n in made if "__lag_" in n]
    return out.dropna(subset=strict) if strict else out


def fit_datetime_features(df: DataFrame, cols: Sequence[str]) -> dict[str, bool]:
    """Whether the hour of each column carries information."""
    row = df.agg(*[F.max(F.hour(as_timestamp(df, c))).alias(f"h{i}") for i, c in enumerate(cols)]).first()
    return {c: bool(row[f"h{i}"]) for i, c in enumerate(cols)}


def datetime_features(df: DataFrame, fitted: dict[str, bool]) -> DataFrame:
    """Calendar parts (Monday is 0), missing dates as 0; hours only where fitted."""
    made = {}
    for c, with_hour in fitted.items():
        ts = as_timestamp(df, c)
        parts = {
            "year": F.year(ts),
            "month": F.month(ts),
            "day": F.dayofmonth(ts),
            "dayofweek": F.weekday(ts),
            "is_weekend": (F.weekday(ts) >= 5).cast("int"),
        }
        if with_hour:
            parts["hour"] = F.hour(ts)
        made.update({f"{c}__{p}": F.coalesce(v.cast("int"), F.lit(0)) for p, v in parts.items()})
    return df.withColumns(made)


def fit_impute_scale(df: DataFrame, numeric_cols: Sequence[str], categorical_cols: Sequence[str] = ()) -> DataFrame:
    """``column, fill, mean, std, fill_text``: median (or commonest value) and scale after filling."""
    out = None
    if numeric_cols:
        cols = list(numeric_cols)
        medians = {r["column"]: r["quantiles"] for r in exact_quantiles(df, cols, [0.5]).collect()}
        fill = {c: (medians.get(c) or [0.0])[0] for c in cols}
        x = {c: F.coalesce(as_double(df, c), F.lit(fill[c])) for c in cols}
        agg = df.agg(
            *[F.avg(x[c]).alias(f"a{i}") for i, c in enumerate(cols)], *[F.stddev_pop(x[c]).alias(f"s{i}") for i, c in enumerate(cols)]
        )
        out = rows_from_aggregate(
            agg,
            [
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(fill[c]).alias("fill"),
                    F.col(f"a{i}").alias("mean"),
                    F.col(f"s{i}").alias("std"),
                    F.lit(None).cast("string").alias("fill_text"),
                )
                for i, c in enumerate(cols)
            ],
        )
    if categorical_cols:
        counts = (
            long_form(df, {c: as_text(df, c) for c in categorical_cols})
            .where(F.col("value").isNotNull())
            .groupBy("column", "value")
            .agg(F.count("*").alias("n"))
        )
        order = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
        null = F.lit(None).cast("double")
        top = (
            counts.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= 1)
            .select("column", null.alias("fill"), null.alias("mean"), null.alias("std"), F.col("value").alias("fill_text"))
        )
        out = top if out is None else out.unionByName(top)
    if out is None:
        raise ValueError("no columns given")
    return out


def impute_scale(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """Fill and standardise the fitted columns (a zero deviation divides by one)."""
    made = {}
    for r in fitted.collect():  # one row per column
        c = r["column"]
        if r["fill_text"] is not None:
            made[c] = F.coalesce(as_text(df, c), F.lit(r["fill_text"]))
        elif r["fill"] is not None:
            made[c] = (F.coalesce(as_double(df, c), F.lit(r["fill"])) - F.lit(r["mean"])) / F.lit(r["std"] or 1.0)
    return df.withColumns(made)


def fit_one_hot(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Sorted levels per column; columns beyond 50 levels do not qualify."""
    tall = long_form(df, {c: as_text(df, c) for c in cols}).where(F.col("value").isNotNull()).distinct()
    order = Window.partitionBy("column").orderBy("value")
    few = tall.withColumn("k", F.row_number().over(order)).where(F.col("k") <= ONE_HOT_LEVELS + 1)
    levels: dict[str, list[str]] = {c: [] for c in cols}
    for r in few.orderBy("column", "k").collect():  # at most 51 rows per column
        levels[r["column"]].append(r["value"])
    wide = [c for c, v in levels.items() if len(v) > ONE_HOT_LEVELS]
    if wide:
        raise ValueError(f"more than {ONE_HOT_LEVELS} levels: {wide}")
    return levels


def one_hot(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """0/1 column per level; unknown and missing values give all zeros."""
    return df.withColumns(
        {f"{c}_{v}": F.coalesce((as_text(df, c) == F.lit(v)).cast("int"), F.lit(0)) for c, vs in levels.items() for v in vs}
    )


def target_encode(
    df: DataFrame, col: str, target: str, fold: Column, smooth: float | None = None, name: str | None = None
) -> DataFrame:
    """Cross-fitted target mean with shrinkage towards the mean of the other folds.

    Rows are reduced to sums per (fold, category) once; what the other folds say is the
    category total minus the own fold. ``smooth=None`` derives the weight from the variance
    within the category against the overall variance.
    """
    require_columns(df, col, target)
    rows = df.withColumn("_fold", fold).withColumn("_cat", as_text(df, col)).withColumn("_y", as_double(df, target))
    base = rows.where(F.col("_y").isNotNull()).groupBy("_fold", "_cat").agg(
        F.count("_y").alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q")
    )
    per_cat = base.groupBy("_cat").agg(*[F.sum(c).alias(f"c{c}") for c in "nsq"])
    per_fold = base.groupBy("_fold").agg(*[F.sum(c).alias(f"f{c}") for c in "nsq"])
    total = per_fold.agg(*[F.sum(f"f{c}").alias(c) for c in "nsq"]).first()
    folds = per_fold.select(
        "_fold", *[(F.lit(float(total[c] or 0.0)) - F.col(f"f{c}")).alias(f"o{c}") for c in "nsq"]
    )  # all other folds
    # Every (fold, category) pair that a row can ask for, not only those with a target.
    wanted = rows.select("_fold", "_cat").distinct()
    known = null_safe_join(null_safe_join(wanted, per_cat, ["_cat"], "left"), base, ["_fold", "_cat"], "left").join(folds, "_fold", "left")
    n, s, q = (F.coalesce(F.col(f"c{c}"), F.lit(0)) - F.coalesce(F.col(c), F.lit(0)) for c in "nsq")
    grand, spread = F.col("os") / F.col("on"), F.col("oq") / F.col("on") - F.pow(F.col("os") / F.col("on"), 2)
    mean = s / n
    if smooth is None:
        within = F.greatest(q / n - F.pow(s / n, 2), F.lit(0.0))
        weight = F.when(spread > 0, n * spread / (n * spread + within)).otherwise(1.0)
    else:
        weight = n / (n + F.lit(float(smooth)))
    encoded = F.when(n > 0, weight * mean + (1 - weight) * grand).otherwise(grand)
    lookup = known.select("_fold", "_cat", encoded.alias(name or f"{col}__target"))
    return null_safe_join(rows, lookup, ["_fold", "_cat"], "left").drop("_fold", "_cat", "_y")


def fit_interactions(
    df: DataFrame, numeric_cols: Sequence[str], max_inputs: int | None = None, max_products: int | None = None
) -> DataFrame:
    """``left, right, variance`` of the pairwise products that vary, largest variance first.

    ``max_inputs`` takes the first columns only, ``max_products`` keeps the products that vary most.
    """
    scale = {r["column"]: r for r in fit_impute_scale(df, numeric_cols).collect()}
    order = sorted(numeric_cols, key=lambda c: (not scale[c]["std"], list(numeric_cols).index(c)))[:max_inputs]
    z = {c: _scaled(df, scale[c]) for c in order}
    pairs = list(combinations(order, 2))
    agg = df.agg(*[F.var_pop(z[a] * z[b]).alias(f"v{k}") for k, (a, b) in enumerate(pairs)])
    rows = rows_from_aggregate(
        agg,
        [
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"v{k}").alias("variance"))
            for k, (a, b) in enumerate(pairs)
        ],
    )
    varied = rows.where(F.col("variance") > 0).orderBy(F.col("variance").desc(), "left", "right")
    return varied if max_products is None else varied.limit(max_products)


def _scaled(df: DataFrame, r) -> Column:
    return (F.coalesce(as_double(df, r["column"]), F.lit(r["fill"])) - F.lit(r["mean"])) / F.lit(r["std"] or 1.0)


def interaction_features(
    df: DataFrame, numeric_cols: Sequence[str], max_inputs: int | None = None, max_products: int | None = None
) -> DataFrame:
    """Products of scaled columns, named ``a b``; all pairs unless limits are given."""
    scale = {r["column"]: r for r in fit_impute_scale(df, numeric_cols).collect()}
    kept = fit_interactions(df, numeric_cols, max_inputs, max_products).collect()  # one row per pair of columns
    return df.withColumns({f"{r['left']} {r['right']}": _scaled(df, scale[r["left"]]) * _scaled(df, scale[r["right"]]) for r in kept})


def text_vectors(df: DataFrame, col: str, dims: int = 64, features: int = 1 << 10, name: str | None = None):
    """Fitted pipeline from text to ``dims`` dense numbers: hashed term weights, then projection.

    Returns a ``PipelineModel``; the sparse random-free projection is the leading principal
    components of the hashed terms, computed by Spark on reduced term groups.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import IDF, PCA, HashingTF, RegexTokenizer

    dims, out = min(dims, features), name or f"{col}__vector"
    words = RegexTokenizer(inputCol=col, outputCol=f"{out}_tokens", pattern="[a-z0-9]+", gaps=False, toLowercase=True)
    hashed = HashingTF(inputCol=words.getOutputCol(), outputCol=f"{out}_tf", numFeatures=features)
    # texts are split once; the fits below go over the term counts several times
    counts = stored(hashed.transform(words.transform(df.where(ref(col).isNotNull()))).select(f"{out}_tf"))
    weights = IDF(inputCol=f"{out}_tf", outputCol=f"{out}_tfidf").fit(counts)
    projection = PCA(inputCol=f"{out}_tfidf", outputCol=out, k=dims).fit(weights.transform(counts))
    discard(counts)
    return PipelineModel(stages=[words, hashed, weights, projection])
