"""Correlations, categorical associations and their findings."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import as_double, as_text, kinds, numeric_columns, present, ref, require_columns
from tablewise.plans.shape import long_form

# Fixed limits and thresholds.
MIN_CATEGORIES, MAX_CATEGORIES = 2, 20
MIN_OVERLAP = 0.5
STRONG_CORRELATION = 0.7
STRONG_ASSOCIATION = 0.5

SUMS_PER_AGGREGATE = 90


def correlation_pairs(df: DataFrame, numeric_cols: Sequence[str] | None = None, top_n: int | None = 20) -> DataFrame:
    """Pairwise-complete Pearson correlation of every unordered column pair."""
    cols = list(numeric_cols or numeric_columns(df))
    require_columns(df, *cols)
    spark = df.sparkSession
    schema = "column_a string, column_b string, correlation double, abs_correlation double, n_pairs bigint, low_overlap boolean"
    pairs = [tuple(sorted(p)) for p in combinations(cols, 2)]
    if not pairs:
        return spark.createDataFrame([], schema)
    # Pass 1: presence and means. Pass 2: plain sums of centred products, which stay in
    # generated code; columns without gaps share their sums among all their pairs.
    value = {c: as_double(df, c) for c in cols}
    first = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(value[c]).alias(f"c{i}") for i, c in enumerate(cols)],
        *[F.avg(value[c]).alias(f"m{i}") for i, c in enumerate(cols)],
    ).first()
    n = first["n"]
    full = {c: first[f"c{i}"] == n for i, c in enumerate(cols)}
    flat = df.select(
        *[F.coalesce(value[c] - F.lit(float(first[f"m{i}"] or 0.0)), F.lit(0.0)).alias(f"u{i}") for i, c in enumerate(cols)],
        *[value[c].isNotNull().cast("double").alias(f"p{i}") for i, c in enumerate(cols) if not full[c]],
    )
    at = {c: i for i, c in enumerate(cols)}

    def seen(c: str) -> Column:
        return F.lit(1.0) if full[c] else F.col(f"p{at[c]}")

    sums: dict[str, Column] = {}
    for a, b in pairs:
        i, j = at[a], at[b]
        x, y = F.col(f"u{i}"), F.col(f"u{j}")
        sums[f"xy_{i}_{j}"] = x * y
        for c, o in ((a, b), (b, a)):
            k, u = (at[c], "") if full[o] else (at[c], f"_{at[o]}")
            sums[f"s_{k}{u}"] = F.col(f"u{at[c]}") * seen(o)
            sums[f"q_{k}{u}"] = F.col(f"u{at[c]}") * F.col(f"u{at[c]}") * seen(o)
        sums[f"n_{i}_{j}"] = seen(a) * seen(b)
    names = list(sums)
    got: dict[str, float] = {}
    for start in range(0, len(names), SUMS_PER_AGGREGATE):
        batch = names[start : start + SUMS_PER_AGGREGATE]
        got.update(flat.agg(*[F.sum(sums[s]).alias(s) for s in batch]).first().asDict())
    rows = []
    for a, b in pairs:
        i, j = at[a], at[b]
        m = got[f"n_{i}_{j}"] or 0.0
        tail_a, tail_b = ("" if full[b] else f"_{j}"), ("" if full[a] else f"_{i}")
        if m < 2:
            continue
        sx, sy = got[f"s_{i}{tail_a}"], got[f"s_{j}{tail_b}"]
        xx, yy = got[f"q_{i}{tail_a}"] - sx * sx / m, got[f"q_{j}{tail_b}"] - sy * sy / m
        if xx <= 0 or yy <= 0:
            continue
        r = max(-1.0, min(1.0, (got[f"xy_{i}_{j}"] - sx * sy / m) / (xx**0.5 * yy**0.5)))
        rows.append((a, b, float(r), int(m), n))
    out = spark.createDataFrame(rows, "column_a string, column_b string, r double, n_pairs bigint, n bigint")
    out = out.where(F.col("r").isNotNull() & ~F.isnan("r")).select(
        "column_a",
        "column_b",
        F.round("r", 4).alias("correlation"),
        F.round(F.abs("r"), 4).alias("abs_correlation"),
        "n_pairs",
        (F.col("n_pairs") < F.col("n") * MIN_OVERLAP).alias("low_overlap"),
    )
    out = out.orderBy(F.col("abs_correlation").desc(), "column_a", "column_b")
    return out if top_n is None else out.limit(top_n)


def default_categorical_columns(df: DataFrame) -> list[str]:
    """First text or boolean columns with 2 to 20 distinct values."""
    cols = [c for c, k in kinds(df).items() if k in ("categorical", "boolean")]
    if not cols:
        return []
    # One bounded set per column would grow with the data, so distinct values are counted.
    row = df.agg(*[F.count_distinct(as_text(df, c)).alias(f"u{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if MIN_CATEGORIES <= row[f"u{i}"] <= MAX_CATEGORIES]


def categorical_associations(
    df: DataFrame,
    categorical_cols: Sequence[str] | None = None,
    numeric_cols: Sequence[str] | None = None,
    top_n: int | None = 20,
) -> DataFrame:
    """Correlation ratio of every (categorical, numeric) pair.

    Group count, mean and spread are combined on the map side per category; the ratio then
    needs only one row per category.
    """
    cats = list(categorical_cols or default_categorical_columns(df))
    nums = list(numeric_cols or numeric_columns(df))
    require_columns(df, *cats, *nums)
    if not cats or not nums:
        return df.sparkSession.createDataFrame([], "categorical_col string, numeric_col string, correlation_ratio double")
    narrow = df.select(
        *[as_text(df, c).alias(f"c{i}") for i, c in enumerate(cats)],
        *[as_double(df, n).alias(f"x{j}") for j, n in enumerate(nums)],
    )
    tall = long_form(narrow, {c: F.col(f"c{i}") for i, c in enumerate(cats)}, [f"x{j}" for j in range(len(nums))])
    groups = (
        tall.where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(
            *[F.count(f"x{j}").alias(f"n{j}") for j in range(len(nums))],
            *[F.avg(f"x{j}").alias(f"m{j}") for j in range(len(nums))],
            *[(F.var_pop(f"x{j}") * F.count(f"x{j}")).alias(f"w{j}") for j in range(len(nums))],
        )
    )
    by_pair = groups.select(
        "column",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("numeric_col"),
                        F.col(f"n{j}").alias("n"),
                        F.col(f"m{j}").alias("m"),
                        F.col(f"w{j}").alias("w"),
                    )
                    for j, n in enumerate(nums)
                ]
            )
        ).alias("g"),
    ).select(F.col("column").alias("categorical_col"), "g.*")
    pair = ["categorical_col", "numeric_col"]
    known = by_pair.where(F.col("n") > 0)
    grand = known.groupBy(*pair).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    stats = (
        known.join(F.broadcast(grand), pair)  # one row per column pair
        .groupBy(*pair)
        .agg(
            F.count("*").alias("k"),
            F.sum("n").alias("n"),
            F.sum("w").alias("within"),
            F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"),
        )
    )
    total = F.col("within") + F.col("between")
    out = (
        stats.where((F.col("k") >= 2) & (F.col("n") >= 3))
        .select(*pair, F.sqrt(F.col("between") / F.nullif(total, F.lit(0.0))).alias("eta"))
        .where(F.col("eta").isNotNull())
        .select(*pair, F.round("eta", 4).alias("correlation_ratio"))
        .orderBy(F.col("correlation_ratio").desc(), *pair)
    )
    return out if top_n is None else out.limit(top_n)


def correlation_ratio(df: DataFrame, category: str, value: str) -> DataFrame:
    """One pair, at any number of categories; no row when it is undefined."""
    return categorical_associations(df, [category], [value], top_n=None)


def relationship_findings(
    df: DataFrame,
    numeric_cols: Sequence[str] | None = None,
    categorical_cols: Sequence[str] | None = None,
    top_n: int = 20,
) -> DataFrame:
    """Strong correlations with enough overlap and strong associations."""
    pairs = correlation_pairs(df, numeric_cols, top_n)
    strong = pairs.where((F.col("abs_correlation") >= STRONG_CORRELATION) & ~F.col("low_overlap")).select(
        F.when(F.col("correlation") > 0, "positive_correlation").otherwise("negative_correlation").alias("finding"),
        "column_a",
        "column_b",
        F.col("correlation").alias("strength"),
    )
    assoc = categorical_associations(df, categorical_cols, numeric_cols, top_n)
    linked = assoc.where(F.col("correlation_ratio") >= STRONG_ASSOCIATION).select(
        F.lit("association").alias("finding"),
        F.col("categorical_col").alias("column_a"),
        F.col("numeric_col").alias("column_b"),
        F.col("correlation_ratio").alias("strength"),
    )
    return strong.unionByName(linked)


def group_means(df: DataFrame, category: str, value: str) -> DataFrame:
    require_columns(df, category, value)
    return (
        df.where(present(df, category).isNotNull())
        .groupBy(ref(category))
        .agg(F.avg(as_double(df, value)).alias(value))
        .orderBy(ref(category))
    )
