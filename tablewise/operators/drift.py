"""Training statistics, population stability, drift and lineage checks."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.columns import as_double, as_text, kinds, missing, require_columns
from tablewise.plans.quantiles import exact_quantiles
from tablewise.plans.shape import long_form, rows_from_aggregate

# Fixed limits and thresholds of drift checks.
MAX_CATEGORIES = 20
BINS = 10
PSI_MEDIUM, PSI_HIGH = 0.1, 0.25
MISSING_MEDIUM, MISSING_HIGH = 0.2, 0.4
NEW_MEDIUM, NEW_HIGH = 0.1, 0.3
SIGMA_MEDIUM, SIGMA_HIGH = 3.0, 5.0
LINEAGE_SIGMA = 2.0

STATS_SCHEMA = (
    "feature string, type string, mean double, std double, min double, max double, p5 double, p95 double, missing_rate double, "
    "quantile_bins array<double>, top_categories array<struct<value:string,share:double>>, n_unique bigint"
)
_DECILES = [i / BINS for i in range(BINS + 1)]


def training_stats(
    df: DataFrame, numeric_cols: Sequence[str] | None = None, categorical_cols: Sequence[str] | None = None
) -> DataFrame:
    """Per-feature summary to keep beside a model: moments and deciles, or the commonest values."""
    kind = kinds(df)
    nums = list(numeric_cols if numeric_cols is not None else [c for c, k in kind.items() if k == "numeric"])
    cats = list(categorical_cols if categorical_cols is not None else [c for c, k in kind.items() if k in ("categorical", "boolean")])
    require_columns(df, *nums, *cats)
    out = None
    if nums:
        x = [as_double(df, c) for c in nums]
        agg = df.agg(
            *[F.avg(v).alias(f"a{i}") for i, v in enumerate(x)],
            *[F.stddev_samp(v).alias(f"s{i}") for i, v in enumerate(x)],
            *[F.min(v).alias(f"l{i}") for i, v in enumerate(x)],
            *[F.max(v).alias(f"h{i}") for i, v in enumerate(x)],
            *[F.avg(missing(df, c).cast("double")).alias(f"m{i}") for i, c in enumerate(nums)],
        )
        rows = rows_from_aggregate(
            agg,
            [
                F.struct(
                    F.lit(c).alias("feature"),
                    F.col(f"a{i}").alias("mean"),
                    F.coalesce(f"s{i}", F.lit(0.0)).alias("std"),
                    F.col(f"l{i}").alias("min"),
                    F.col(f"h{i}").alias("max"),
                    F.col(f"m{i}").alias("missing_rate"),
                )
                for i, c in enumerate(nums)
            ],
        )
        q = exact_quantiles(df, nums, [*_DECILES, 0.05, 0.95]).withColumnRenamed("column", "feature")
        out = (
            rows.join(F.broadcast(q), "feature")  # one row per numeric feature
            .where(F.col("mean").isNotNull())
            .select(
                "feature", F.lit("numeric").alias("type"), "mean", "std", "min", "max",
                F.col("quantiles")[BINS + 1].alias("p5"), F.col("quantiles")[BINS + 2].alias("p95"), "missing_rate",
                F.slice("quantiles", 1, BINS + 1).alias("quantile_bins"),
                F.lit(None).cast("array<struct<value:string,share:double>>").alias("top_categories"),
                F.lit(None).cast("bigint").alias("n_unique"),
            )
        )
    if cats:
        texts = {c: as_text(df, c) for c in cats}
        total = float(max(df.count(), 1))
        counts = (
            long_form(df, {c: F.coalesce(v, F.lit("nan")) for c, v in texts.items()})
            .groupBy("column", "value")
            .agg(F.count("*").alias("n"))
        )
        order = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
        top = (
            counts.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= MAX_CATEGORIES)
            .groupBy("column")
            .agg(
                F.array_sort(F.collect_list(F.struct("rank", "value", F.round(F.col("n") / total, 4).alias("share")))).alias("t")
            )
            .select(
                F.col("column").alias("feature"),
                F.transform("t", lambda r: F.struct(r["value"].alias("value"), r["share"].alias("share"))).alias("top_categories"),
            )
        )
        agg = df.agg(
            *[F.count_distinct(v).alias(f"u{i}") for i, v in enumerate(texts.values())],
            *[F.avg(v.isNull().cast("double")).alias(f"m{i}") for i, v in enumerate(texts.values())],
        )
        base = rows_from_aggregate(
            agg,
            [
                F.struct(F.lit(c).alias("feature"), F.col(f"u{i}").alias("n_unique"), F.col(f"m{i}").alias("missing_rate"))
                for i, c in enumerate(cats)
            ],
        )
        null = F.lit(None).cast("double")
        rows = base.join(F.broadcast(top), "feature").select(
            "feature", F.lit("categorical").alias("type"), *[null.alias(c) for c in ("mean", "std", "min", "max", "p5", "p95")],
            "missing_rate", F.lit(None).cast("array<double>").alias("quantile_bins"), "top_categories", "n_unique",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _psi(counts: list[Column], total: Column) -> Column:
    expected = 1.0 / BINS
    psi = F.lit(0.0)
    for c in counts:
        share = F.greatest(c / total, F.lit(1e-6))
        psi = psi + (share - expected) * F.ln(share / expected)
    return F.round(psi, 5)


def _bin_counts(x: Column, edges: Sequence[float]) -> list[Column]:
    e = list(edges)
    e[0] -= 1e-9
    e[-1] += 1e-9
    return [F.count_if((x >= F.lit(e[i])) & (x < F.lit(e[i + 1]))) for i in range(len(e) - 1)]


def psi(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``feature, psi`` against the training deciles; rows outside all bins count in the total.

    The deciles are at most 100 x 11 finished numbers, so every bin becomes one conditional
    count of a single aggregate and nothing is shuffled.
    """
    known = [r for r in stats.where("quantile_bins IS NOT NULL").collect() if r["feature"] in df.columns]
    parts, structs = [], []
    for i, r in enumerate(known):
        x = as_double(df, r["feature"])
        bins = _bin_counts(x, r["quantile_bins"])
        parts += [F.count(x).alias(f"n{i}"), *[b.alias(f"b{i}_{j}") for j, b in enumerate(bins)]]
        value = _psi([F.col(f"b{i}_{j}") for j in range(len(bins))], F.col(f"n{i}"))
        structs.append(
            F.struct(F.lit(r["feature"]).alias("feature"), F.when(F.col(f"n{i}") > 0, value).otherwise(0.0).alias("psi"))
        )
    return rows_from_aggregate(df.agg(*parts), structs)


def _severity(medium: Column, high: Column) -> Column:
    return F.when(medium, F.when(high, "high").otherwise("medium")).otherwise("none")


def check_features(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Every checked feature with its shift measures and severity, from one aggregate."""
    known = [r for r in stats.collect() if r["feature"] in df.columns]
    null = F.lit(None).cast("double")
    parts, structs = [], []
    for i, r in enumerate(known):
        c = r["feature"]
        gap = F.avg(missing(df, c).cast("double"))
        parts.append(F.abs(gap - F.lit(r["missing_rate"])).alias(f"g{i}"))
        missing_gap = F.col(f"g{i}")
        if r["type"] == "numeric":
            x = as_double(df, c)
            parts += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"s{i}")]
            shift = F.abs(F.col(f"a{i}") - F.lit(r["mean"])) / max(r["std"], 1e-9)
            lo, hi = F.least(F.col(f"s{i}"), F.lit(r["std"])), F.greatest(F.col(f"s{i}"), F.lit(r["std"]))
            ratio = F.when(lo > 0, hi / F.greatest(lo, F.lit(1e-9))).otherwise(1.0)
            edges = r["quantile_bins"]
            if edges and len(edges) == BINS + 1:
                bins = _bin_counts(x, edges)
                parts += [b.alias(f"b{i}_{j}") for j, b in enumerate(bins)]
                p = _psi([F.col(f"b{i}_{j}") for j in range(len(bins))], F.col(f"n{i}"))
                severity = _severity(
                    (p >= PSI_MEDIUM) | (missing_gap > MISSING_MEDIUM), (p >= PSI_HIGH) | (missing_gap > MISSING_HIGH)
                )
            else:
                p = null
                severity = _severity(
                    (shift > SIGMA_MEDIUM) | (ratio > SIGMA_MEDIUM) | (missing_gap > MISSING_MEDIUM),
                    (shift > SIGMA_HIGH) | (ratio > SIGMA_HIGH) | (missing_gap > MISSING_HIGH),
                )
            new = null
            shift, ratio = F.round(shift, 2), F.round(ratio, 2)
        else:
            text = as_text(df, c)
            listed = [t["value"] for t in r["top_categories"]]
            parts += [F.count(text).alias(f"n{i}"), F.count_if(~text.isin(listed)).alias(f"w{i}")]
            rate = F.col(f"w{i}") / F.nullif(F.col(f"n{i}"), F.lit(0))
            severity = _severity(
                (rate > NEW_MEDIUM) | (missing_gap > MISSING_MEDIUM), (rate > NEW_HIGH) | (missing_gap > MISSING_HIGH)
            )
            p, shift, ratio, new = null, null, null, F.round(rate, 3)
        structs.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(r["type"]).alias("type"),
                shift.alias("mean_shift_std"),
                ratio.alias("std_ratio"),
                F.round(missing_gap, 3).alias("missing_rate_delta"),
                p.alias("psi"),
                new.alias("new_category_rate"),
                F.when(F.col(f"n{i}") > 0, severity).otherwise("none").alias("severity"),
            )
        )
    if not known:
        raise ValueError("no trained feature is present")
    return rows_from_aggregate(df.agg(*parts), structs)


def check_drift(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Only the drifted features, most severe first."""
    rows = check_features(df, stats).where(F.col("severity") != "none")
    return rows.orderBy(F.when(F.col("severity") == "high", 0).otherwise(1), "feature")


def drift_summary(df: DataFrame, stats: DataFrame) -> DataFrame:
    drifted = F.col("severity") != "none"
    return check_features(df, stats).agg(
        F.count_if(drifted).alias("n_drifted"),
        F.count("*").alias("n_features_checked"),
        F.round(F.count_if(drifted) / F.count("*"), 3).alias("drift_rate"),
        F.when(F.count_if(F.col("severity") == "high") > 0, "high")
        .when(F.count_if(drifted) > 0, "medium")
        .otherwise("none")
        .alias("overall_severity"),
    )


def column_hash(cols: Sequence[str]) -> str:
    return hashlib.md5("|".join(sorted(cols)).encode()).hexdigest()[:12]


def fingerprint(df: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """One row per feature: ``column, mean, std`` with the row count and the hash of the names."""
    cols = sorted(feature_cols)
    kind = kinds(df)
    nums = [c for c in cols if kind.get(c) == "numeric"]
    agg = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.avg(as_double(df, c)).alias(f"a{i}") for i, c in enumerate(nums)],
        *[F.stddev_samp(as_double(df, c)).alias(f"s{i}") for i, c in enumerate(nums)],
    )
    null = F.lit(None).cast("double")
    names = F.array(*[F.lit(c) for c in cols])
    structs = []
    for c in cols:
        i = nums.index(c) if c in nums else None
        structs.append(
            F.struct(
                F.lit(c).alias("column"),
                (null if i is None else F.round(F.col(f"a{i}"), 6)).alias("mean"),
                (
                    null
                    if i is None
                    else F.when(F.col(f"a{i}").isNotNull(), F.coalesce(F.round(F.col(f"s{i}"), 6), F.lit(0.0)))
                ).alias("std"),
                F.col("n_rows"),
                F.lit(len(cols)).alias("n_cols"),
                F.substring(F.md5(F.concat_ws("|", F.sort_array(names))), 1, 12).alias("column_hash"),
            )
        )
    return rows_from_aggregate(agg, structs)


def compare_fingerprints(df: DataFrame, feature_cols: Sequence[str], stored: DataFrame) -> DataFrame:
    """``column, status, shift``: added, removed, shifted (mean off by over two sigma) or ok."""
    current = fingerprint(df, feature_cols).select("column", F.col("mean").alias("_now"), F.lit(True).alias("_here"))
    then = stored.select("column", "mean", "std", F.lit(True).alias("_was"))
    shift = F.abs(F.col("_now") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))
    status = (
        F.when(F.col("_was").isNull(), "added")
        .when(F.col("_here").isNull(), "removed")
        .when(shift > LINEAGE_SIGMA, "shifted")
        .otherwise("ok")
    )
    return current.join(then, "column", "full").select("column", status.alias("status"), F.round(shift, 4).alias("shift"))


def validate_scoring_schema(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """``issue, column, expected, found`` for missing, extra and differently typed columns.

    ``expected`` maps feature to analysis kind (numeric, categorical, datetime, boolean).
    """
    found = kinds(df)
    rows = [("missing", c, k, None) for c, k in expected.items() if c not in found]
    rows += [("extra", c, None, k) for c, k in found.items() if c not in expected]
    rows += [("type_mismatch", c, k, found[c]) for c, k in expected.items() if c in found and found[c] != k]
    return df.sparkSession.createDataFrame(rows, "issue string, column string, expected string, found string")


def detect_drift(
    df: DataFrame, stats: DataFrame, expected: dict[str, str], stored_fingerprint: DataFrame | None = None
) -> DataFrame:
    """Schema, feature and lineage checks of a scoring table as ``section, item, detail, severity``."""
    schema = validate_scoring_schema(df, expected).select(
        F.lit("schema").alias("section"),
        F.col("column").alias("item"),
        F.col("issue").alias("detail"),
        F.when(F.col("issue") == "extra", "none").otherwise("high").alias("severity"),
    )
    drift = check_drift(df, stats).select(
        F.lit("drift").alias("section"),
        F.col("feature").alias("item"),
        F.concat_ws(" ", F.lit("psi"), F.col("psi").cast("string"), F.lit("new"), F.col("new_category_rate").cast("string")).alias(
            "detail"
        ),
        "severity",
    )
    out = schema.unionByName(drift)
    if stored_fingerprint is not None:
        present = [c for c in expected if c in df.columns]
        lineage = compare_fingerprints(df, present, stored_fingerprint).where(F.col("status") != "ok")
        out = out.unionByName(
            lineage.select(
                F.lit("lineage").alias("section"),
                F.col("column").alias("item"),
                F.col("status").alias("detail"),
                F.lit("medium").alias("severity"),
            )
        )
    return out

