"""Column profiles and data-quality scans over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import (
    FLOATING,
    adjusted_skewness,
    as_double,
    as_text,
    kinds,
    limited,
    missing,
    numeric_columns,
    present,
    ratio,
    ref,
    require_between,
    require_columns,
)
from tablewise.plans.quantiles import exact_quantiles, fits_one_task
from tablewise.plans.shape import is_plain_scan, long_form, rows_from_aggregate, short_splits, spread

# Fixed thresholds that findings must share with the tool they replace.
HIGH_MISSING = 0.5
HIGH_SKEW = 2.0
HIGH_CARDINALITY = 0.9
TOP_VALUES = 5
OUTLIER_Z = 3.0

SUMMARY_FIELDS = {
    "min": "DOUBLE", "max": "DOUBLE", "mean": "DOUBLE", "std": "DOUBLE", "skewness": "DOUBLE", "_q": "ARRAY<DOUBLE>",
    "min_time": "STRING", "max_time": "STRING", "range_days": "DOUBLE", "true_count": "BIGINT", "false_count": "BIGINT",
}

PROFILE_PROBS = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95}
QUALITY_PROBS = {**PROFILE_PROBS, "p99": 0.99}
DESCRIBE_PROBS = {"p25": 0.25, "p50": 0.50, "p75": 0.75}


def _null(dtype: str) -> Column:
    return F.lit(None).cast(dtype)


def _span_days(low: Column, high: Column) -> Column:
    return (F.unix_micros(high.cast("timestamp")) - F.unix_micros(low.cast("timestamp"))) / 86_400_000_000


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def distinct_counts(df: DataFrame) -> DataFrame:
    """``name, unique``: exact distinct non-missing values per column.

    A plain scan is read one column at a time, so every row that is hashed and shuffled holds
    one value. Anything else is computed once, its rows expanded by column.
    """
    names = df.columns
    texts = {T.ArrayType, T.MapType, T.StructType, T.VariantType}
    values = [as_text(df, c) if type(df.schema[c].dataType) in texts else present(df, c) for c in names]
    if is_plain_scan(df):
        out = None
        for c, value in zip(names, values):
            one = df.select(value.alias("v")).where("v IS NOT NULL").distinct().agg(F.count("v").alias("unique"))
            one = one.select(F.lit(c).alias("name"), "unique")
            out = one if out is None else out.unionByName(one)
        return out
    agg = df.agg(*[F.count_distinct(value).alias(f"u{i}") for i, value in enumerate(values)])
    return rows_from_aggregate(
        agg, [F.struct(F.lit(c).alias("name"), F.col(f"u{i}").alias("unique")) for i, c in enumerate(names)]
    )


def _summary(df: DataFrame, probs: dict[str, float]) -> DataFrame:
    """One row per column with every type-specific statistic; unused ones are NULL."""
    ks = kinds(df)
    numeric = numeric_columns(df)
    inline = not numeric or fits_one_task(df, len(numeric))
    plain = is_plain_scan(df)
    with short_splits(df, df.count() if plain else 0):
        unique = {r["name"]: r["unique"] for r in distinct_counts(df).collect()}  # one row per column
    # Short names first, then SQL text: one parse per statistic instead of many Column calls.
    values = {c: as_double(df, c) if ks[c] == "numeric" else present(df, c) for c in df.columns}
    narrow = df.select(*[v.alias(f"x{i}") if ks[c] != "categorical" else v.isNotNull().alias(f"x{i}") for i, (c, v) in enumerate(values.items())])
    if inline and numeric:
        narrow = spread(narrow)
    points = ", ".join(f"{p!r}D" for p in probs.values())
    parts, structs = ["count(1) AS n_rows"], []
    for i, c in enumerate(df.columns):
        kind, x = ks[c], f"x{i}"
        parts.append(f"count_if(NOT {x}) AS m{i}" if kind == "categorical" else f"count_if({x} IS NULL) AS m{i}")
        stats = {n: f"CAST(NULL AS {t})" for n, t in SUMMARY_FIELDS.items()}
        if kind == "numeric":
            n = f"CAST(count({x}) AS DOUBLE)"
            parts += [
                f"min({x}) AS lo{i}", f"max({x}) AS hi{i}", f"avg({x}) AS av{i}", f"stddev_samp({x}) AS sd{i}",
                f"CASE WHEN {n} > 2 THEN skewness({x}) * sqrt({n} * ({n} - 1)) / ({n} - 2) END AS sk{i}",
            ]
            stats.update({"min": f"lo{i}", "max": f"hi{i}", "mean": f"av{i}", "std": f"sd{i}", "skewness": f"sk{i}"})
            if inline:
                parts.append(f"percentile({x}, array({points})) AS q{i}")
                stats["_q"] = f"q{i}"
        elif kind == "datetime":
            parts += [f"min({x}) AS lo{i}", f"max({x}) AS hi{i}"]
            lo, hi = f"CAST(lo{i} AS TIMESTAMP)", f"CAST(hi{i} AS TIMESTAMP)"
            iso = "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
            stats.update(
                {"min_time": iso.format(lo), "max_time": iso.format(hi), "range_days": f"(unix_micros({hi}) - unix_micros({lo})) / 86400000000D"}
            )
        elif kind == "boolean":
            parts += [f"count_if({x}) AS t{i}", f"count_if(NOT {x}) AS f{i}"]
            stats.update({"true_count": f"t{i}", "false_count": f"f{i}"})
        body = ", ".join(f"{e} AS {n}" for n, e in stats.items())
        structs.append(
            f"struct({i} AS position, n_rows, m{i} AS missing, round(try_divide(m{i}, n_rows) * 100, 2) AS missing_pct, {body})"
        )
    cells = narrow.agg(*[F.expr(p) for p in parts]).select(F.expr(f"explode(array({', '.join(structs)}))").alias("_r")).select("_r.*")
    labels = [(i, c, df.schema[c].dataType.simpleString(), ks[c], unique.get(c)) for i, c in enumerate(df.columns)]
    names = df.sparkSession.createDataFrame(labels, "position int, name string, dtype string, kind string, unique bigint")
    rows = cells.join(F.broadcast(names), "position")  # one row per column
    if not inline and numeric:
        quantiles = exact_quantiles(df, numeric, list(probs.values())).withColumnRenamed("column", "name")
        rows = rows.drop("_q").join(F.broadcast(quantiles.withColumnRenamed("quantiles", "_q")), "name", "left")
    return rows.withColumns({p: F.col("_q")[k] for k, p in enumerate(probs)}).drop("_q")


def profile_dataset(df: DataFrame, sample: float | None = None) -> DataFrame:
    """Per column: dtype, missing, distinct and the statistics of its type."""
    return _summary(limited(df, sample), PROFILE_PROBS).select(
        "name", "dtype", "kind", "missing", "missing_pct", "unique", "min", "max", "mean", "std", "p25", "p50",
        "p75", "p95", "skewness", "min_time", "max_time", "range_days", "true_count", "false_count",
    )


def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    require_columns(df, *cols)
    return _summary(df.select(*[ref(c) for c in cols]), PROFILE_PROBS).select(
        "name", "min", "max", "mean", "std", "p25", "p50", "p75", "p95", "skewness"
    )


def datetime_summary(df: DataFrame) -> DataFrame:
    cols = [c for c, k in kinds(df).items() if k == "datetime"]
    narrow = df.select(*[ref(c) for c in cols])
    agg = narrow.agg(
        *[F.min(ref(c)).alias(f"lo{i}") for i, c in enumerate(cols)],
        *[F.max(ref(c)).alias(f"hi{i}") for i, c in enumerate(cols)],
    )
    return rows_from_aggregate(
        agg,
        [
            F.struct(
                F.lit(c).alias("name"),
                _iso(F.col(f"lo{i}")).alias("min_time"),
                _iso(F.col(f"hi{i}")).alias("max_time"),
                _span_days(F.col(f"lo{i}"), F.col(f"hi{i}")).alias("range_days"),
            )
            for i, c in enumerate(cols)
        ],
    )


def boolean_summary(df: DataFrame) -> DataFrame:
    cols = [c for c, k in kinds(df).items() if k == "boolean"]
    agg = df.agg(
        *[F.count_if(ref(c)).alias(f"t{i}") for i, c in enumerate(cols)],
        *[F.count_if(~ref(c)).alias(f"f{i}") for i, c in enumerate(cols)],
    )
    return rows_from_aggregate(
        agg,
        [
            F.struct(
                F.lit(c).alias("name"), F.col(f"t{i}").alias("true_count"), F.col(f"f{i}").alias("false_count")
            )
            for i, c in enumerate(cols)
        ],
    )


def categorical_summary(df: DataFrame, cols: Sequence[str] | None = None, top: int = TOP_VALUES) -> DataFrame:
    """Most frequent values per column: ``name, rank, value, count, pct`` of the non-missing."""
    cols = list(cols or [c for c, k in kinds(df).items() if k == "categorical"])
    require_columns(df, *cols)
    texts = {c: as_text(df, c) for c in cols}
    counts = (
        long_form(df, texts).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("count"))
    )
    totals = rows_from_aggregate(
        df.agg(*[F.count(texts[c]).alias(f"n{i}") for i, c in enumerate(cols)]),
        [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("_total")) for i, c in enumerate(cols)],
    )
    order = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value"))
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "column").select(
        F.col("column").alias("name"),
        "rank",
        "value",
        "count",
        F.round(ratio(F.col("count"), F.col("_total")) * 100, 2).alias("pct"),
    )


def _findings(rows: DataFrame, tests: list[tuple[str, Column, Column]]) -> DataFrame:
    """``position, column, finding, value`` for every test that holds."""
    hits = F.filter(
        F.array(
            *[
                F.when(cond, F.struct(F.lit(k).alias("seq"), F.lit(name).alias("finding"), value.alias("value")))
                for k, (name, cond, value) in enumerate(tests)
            ]
        ),
        lambda h: h.isNotNull(),
    )
    return rows.select("position", F.col("name").alias("column"), F.explode(hits).alias("_h")).select(
        "position", "column", "_h.finding", "_h.value"
    )


def profile_findings(df: DataFrame, sample: float | None = None) -> DataFrame:
    """Mostly missing, identifier-like, constant and highly skewed columns."""
    df = limited(df, sample)
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)]
    rows = _summary(df, PROFILE_PROBS)
    unique, n = F.col("unique"), F.col("n_rows")
    is_id = (unique == n) & (n > 1) & ~F.col("name").isin(floats)
    return _findings(
        rows,
        [
            ("mostly_missing", ratio(F.col("missing"), n) >= HIGH_MISSING, F.col("missing_pct")),
            ("identifier_like", is_id, unique.cast("double")),
            ("constant", ~is_id & (unique <= 1) & (n > 1), unique.cast("double")),
            ("highly_skewed", F.abs("skewness") >= HIGH_SKEW, F.col("skewness")),
        ],
    ).drop("position")


def data_quality_report(df: DataFrame, sample: float | None = None) -> DataFrame:
    """Like the profile, with p99; booleans count as categorical."""
    df = limited(df, sample)
    return _summary(df, QUALITY_PROBS).select(
        "name", "dtype", F.col("missing").alias("missing_count"), "missing_pct", "unique", "mean", "std", "min", "max",
        "p25", "p50", "p75", "p95", "p99", "skewness", "min_time", "max_time",
    )


def _quality_findings(df: DataFrame) -> DataFrame:
    rows = _summary(df, QUALITY_PROBS)
    n = F.col("n_rows")
    categorical = F.col("kind").isin("categorical", "boolean")
    return _findings(
        rows,
        [
            (
                "high_cardinality",
                categorical & (n > 0) & (ratio(F.col("unique"), n) >= HIGH_CARDINALITY),
                F.col("unique").cast("double"),
            ),
            ("mostly_missing", ratio(F.col("missing"), n) >= HIGH_MISSING, F.col("missing_pct")),
            ("highly_skewed", F.abs("skewness") >= HIGH_SKEW, F.col("skewness")),
        ],
    )


def quality_findings(df: DataFrame, sample: float | None = None) -> DataFrame:
    return _quality_findings(limited(df, sample)).drop("position")


def missingness_matrix(df: DataFrame, top_n: int = 20) -> DataFrame:
    """Missing fraction per column, most missing first."""
    agg = df.agg(*[F.avg(missing(df, c).cast("double")).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = rows_from_aggregate(
        agg,
        [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_pct")) for i, c in enumerate(df.columns)],
    )
    return rows.orderBy(F.col("missing_pct").desc(), "column").limit(top_n)


def overrepresented_categories(df: DataFrame, col: str, threshold: float = 0.5, top_k: int = 10) -> DataFrame:
    """Share of each value, NULL included; the ``top_k`` largest with a dominance flag."""
    require_columns(df, col)
    require_between("threshold", threshold, 0.0, 1.0)
    total = df.count()
    counts = df.groupBy(present(df, col).alias("value")).agg(F.count("*").alias("count"))
    share = F.col("count") / F.lit(float(max(total, 1)))
    return (
        counts.select(as_text(counts, "value").alias("value"), "count", share.alias("proportion"))
        .withColumn("dominant", F.col("proportion") >= threshold)
        .orderBy(F.col("count").desc(), F.col("value").asc_nulls_last())
        .limit(top_k)
    )


def skewed_features(
    df: DataFrame, threshold: float = 1.0, max_features: int = 50, sample: float | None = None
) -> DataFrame:
    df = limited(df, sample)
    cols = numeric_columns(df)
    agg = df.agg(*[adjusted_skewness(as_double(df, c)).alias(f"s{i}") for i, c in enumerate(cols)])
    rows = rows_from_aggregate(
        agg, [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("skewness")) for i, c in enumerate(cols)]
    )
    size = F.abs("skewness")
    return (
        rows.where(size >= threshold)
        .withColumn("severity", F.when(size >= HIGH_SKEW, "high").otherwise("moderate"))
        .orderBy(size.desc(), "column")
        .limit(max_features)
    )


def zscore_outlier_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows at least three sample standard deviations from the mean, per column."""
    cols = list(cols or numeric_columns(df))
    require_columns(df, *cols)
    values = [as_double(df, c) for c in cols]
    stats = df.agg(
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(values)],
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)],
        *[F.stddev_samp(v).alias(f"s{i}") for i, v in enumerate(values)],
    ).first()
    parts, structs = [], []
    for i, v in enumerate(values):
        n, m, s = stats[f"n{i}"], stats[f"m{i}"], stats[f"s{i}"]
        usable = n >= 3 and s is not None and s > 0
        count = F.count_if(F.abs(v - F.lit(m)) / F.lit(s) >= OUTLIER_Z) if usable else F.max(_null("bigint"))
        parts.append(count.alias(f"o{i}"))
        structs.append(F.struct(F.lit(cols[i]).alias("column"), F.col(f"o{i}").alias("outliers")))
    return rows_from_aggregate(df.agg(*parts), structs)


def column_hints(df: DataFrame) -> DataFrame:
    """Short description of each column: missing share, numeric range or the three top values."""
    rows = _summary(df, DESCRIBE_PROBS).select(
        "name", "dtype", F.round(ratio(F.col("missing"), F.col("n_rows")) * 100, 3).alias("missing_pct"), "min", "max"
    )
    text = [c for c, k in kinds(df).items() if k in ("categorical", "boolean")]
    if not text:
        return rows.withColumn("top_values", _null("string"))
    top = categorical_summary(df, text, top=3).groupBy("name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda r: r["value"]), "|").alias(
            "top_values"
        )
    )
    return rows.join(F.broadcast(top), "name", "left")
