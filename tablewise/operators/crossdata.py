"""Join-key discovery and correlations across two tables."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import as_double, as_text, kinds, missing, numeric_columns, ratio, ref, require_columns
from tablewise.plans.shape import long_form, rows_from_aggregate

# Fixed limits and thresholds of the key search.
MAX_RESULTS = 10
MIN_SIMILARITY = 0.5
MIN_OVERLAP = 0.1
RECOMMENDED_SIMILARITY, RECOMMENDED_OVERLAP = 0.6, 0.3
STRONG_CORRELATION = 0.7
MIN_JOINED_ROWS, MIN_PAIR_ROWS = 10, 5


def name_similarity(a: str, b: str) -> float:
    """Jaccard similarity of the lower-case alphanumeric tokens of two column names."""
    ta, tb = (set(re.findall("[a-z0-9]+", x.lower())) for x in (a, b))
    return len(ta & tb) / len(ta | tb) if ta and tb else 0.0


def name_similarities(names_a: DataFrame, names_b: DataFrame) -> DataFrame:
    """The same for two tables of names (column ``name``), as a join on shared tokens."""

    def tokens(df: DataFrame, side: str) -> DataFrame:
        found = F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9]+"), F.lit(0)))
        return df.select(F.col("name").alias(f"name_{side}"), F.size(found).alias(f"k_{side}"), F.explode(found).alias("tok"))

    shared = (
        tokens(names_a, "a")
        .join(tokens(names_b, "b"), "tok")
        .groupBy("name_a", "name_b", "k_a", "k_b")
        .agg(F.count("*").alias("common"))
    )
    return shared.select(
        "name_a",
        "name_b",
        (F.col("common") / (F.col("k_a") + F.col("k_b") - F.col("common"))).alias("similarity"),
    )


def is_potential_key(df: DataFrame) -> DataFrame:
    """``column, is_key``: more than half of the values distinct, and more than five."""
    cols = [c for c, k in kinds(df).items() if k != "boolean"]
    agg = df.agg(
        *[F.count_if(~missing(df, c)).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.count_distinct(as_text(df, c)).alias(f"u{i}") for i, c in enumerate(cols)],
    )
    return rows_from_aggregate(
        agg,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.coalesce(
                    (F.col(f"u{i}") / F.nullif(F.col(f"n{i}"), F.lit(0)) > 0.5) & (F.col(f"u{i}") > 5), F.lit(False)
                ).alias("is_key"),
            )
            for i, c in enumerate(cols)
        ],
    )


def join_key_candidates(df_a: DataFrame, df_b: DataFrame, limit: int | None = MAX_RESULTS) -> DataFrame:
    """Column pairs that could join two tables, best first; all of them with ``limit`` None.

    Only name-compatible pairs are compared. Each side is reduced to distinct (pair, value)
    rows before one join, so a value that fills a third of a table counts once.
    """
    pairs = []
    for a in df_a.columns:
        for b in df_b.columns:
            exact, score = a.lower() == b.lower(), name_similarity(a, b)
            if exact or score >= MIN_SIMILARITY:
                pairs.append((len(pairs), a, b, score, exact))
    schema = "pair int, col_a string, col_b string, similarity double, exact_name_match boolean"
    spark = df_a.sparkSession
    out_cols = ["col_a", "col_b", "name_similarity", "exact_name_match", "value_overlap", "recommended"]
    if not pairs:
        return spark.createDataFrame(
            [], "col_a string, col_b string, name_similarity double, exact_name_match boolean, value_overlap double, recommended boolean"
        )

    def distinct(df: DataFrame, side: int) -> DataFrame:
        values = {str(p[0]): as_text(df, p[side]) for p in pairs}
        return long_form(df, values).where(F.col("value").isNotNull()).distinct()

    a, b = distinct(df_a, 1), distinct(df_b, 2)
    sizes = a.groupBy("column").agg(F.count("*").alias("na")).join(b.groupBy("column").agg(F.count("*").alias("nb")), "column")
    common = a.join(b, ["column", "value"]).groupBy("column").agg(F.count("*").alias("both"))
    overlap = F.coalesce("both", F.lit(0)) / F.least("na", "nb")
    scored = (
        spark.createDataFrame(pairs, schema)
        .join(sizes, F.col("pair").cast("string") == sizes["column"])
        .drop("column")
        .join(common, F.col("pair").cast("string") == common["column"], "left")
        .withColumn("overlap", overlap)
        .where(F.col("exact_name_match") | (F.col("overlap") >= MIN_OVERLAP))
    )
    good = F.col("exact_name_match") | (
        (F.col("similarity") > RECOMMENDED_SIMILARITY) & (F.col("overlap") > RECOMMENDED_OVERLAP)
    )
    ranked = (
        scored.select(
            "pair",
            "col_a",
            "col_b",
            F.round("similarity", 3).alias("name_similarity"),
            "exact_name_match",
            F.round("overlap", 3).alias("value_overlap"),
            good.alias("recommended"),
        )
        .orderBy(F.col("exact_name_match").desc(), F.col("value_overlap").desc(), "pair")
    )
    return (ranked if limit is None else ranked.limit(limit)).select(*out_cols)


def cross_correlations(df_a: DataFrame, df_b: DataFrame, key_a: str, key_b: str, top_n: int = MAX_RESULTS) -> DataFrame:
    """Strong correlations between numeric columns of the two sides of an inner join.

    Rows with equal keys on both sides multiply, so each side is first reduced to sums per
    key; every moment of the joined rows follows from those sums and no joined row is made.
    """
    require_columns(df_a, key_a)
    require_columns(df_b, key_b)
    num_a = [c for c in numeric_columns(df_a) if c != key_a]
    num_b = [c for c in numeric_columns(df_b) if c != key_b]
    spark = df_a.sparkSession
    schema = "col_a string, col_b string, pearson_r double, abs_r double, n_matched bigint"
    if not num_a or not num_b:
        return spark.createDataFrame([], schema)

    def reduced(df: DataFrame, key: str, cols: list[str], tag: str) -> DataFrame:
        x = [as_double(df, c) for c in cols]
        centre = df.agg(*[F.avg(v).alias(f"c{i}") for i, v in enumerate(x)]).first()
        x = [v - F.lit(centre[f"c{i}"] or 0.0) for i, v in enumerate(x)]
        parts = [F.count("*").alias(f"{tag}rows")]
        for i, v in enumerate(x):
            parts += [
                F.count(v).cast("double").alias(f"{tag}n{i}"),
                F.coalesce(F.sum(v), F.lit(0.0)).alias(f"{tag}s{i}"),
                F.coalesce(F.sum(v * v), F.lit(0.0)).alias(f"{tag}q{i}"),
            ]
        return df.where(~missing(df, key)).groupBy(as_text(df, key).alias("_key")).agg(*parts)

    joined = reduced(df_a, key_a, num_a, "a").join(reduced(df_b, key_b, num_b, "b"), "_key")
    parts = [F.sum(F.col("arows") * F.col("brows")).alias("rows")]
    for i in range(len(num_a)):
        for j in range(len(num_b)):
            an, as_, aq = (F.col(f"a{m}{i}") for m in "nsq")
            bn, bs, bq = (F.col(f"b{m}{j}") for m in "nsq")
            for tag, e in (
                ("n", an * bn), ("x", as_ * bn), ("y", an * bs), ("xx", aq * bn), ("yy", an * bq), ("xy", as_ * bs),
            ):
                parts.append(F.sum(e).alias(f"{tag}{i}_{j}"))
    structs = []
    for i, a in enumerate(num_a):
        for j, b in enumerate(num_b):
            n, x, y, xx, yy, xy = (F.col(f"{t}{i}_{j}") for t in ("n", "x", "y", "xx", "yy", "xy"))
            mean_x, mean_y = ratio(x, n), ratio(y, n)
            top = xy - mean_x * y
            bottom = F.sqrt(F.greatest(xx - mean_x * x, F.lit(0.0)) * F.greatest(yy - mean_y * y, F.lit(0.0)))
            structs.append(
                F.struct(
                    F.lit(a).alias("col_a"),
                    F.lit(b).alias("col_b"),
                    F.when((n >= MIN_PAIR_ROWS) & (bottom > 0), top / bottom).alias("r"),
                    n.cast("long").alias("n_matched"),
                    F.col("rows").alias("rows"),
                )
            )
    rows = rows_from_aggregate(joined.agg(*parts), structs)
    return (
        rows.where((F.col("rows") >= MIN_JOINED_ROWS) & (F.abs("r") >= STRONG_CORRELATION))
        .select("col_a", "col_b", F.round("r", 4).alias("pearson_r"), F.round(F.abs("r"), 4).alias("abs_r"), "n_matched")
        .orderBy(F.col("abs_r").desc(), "col_a", "col_b")
        .limit(top_n)
    )


def cross_dataset_profile(df: DataFrame, others: Mapping[str, DataFrame]) -> DataFrame:
    """Key candidates and, on the best key, strong correlations against each other table."""
    out = None
    for name, other in others.items():
        keys = join_key_candidates(df, other)
        part = keys.select(
            F.lit(name).alias("dataset"),
            F.lit("join_key").alias("section"),
            "col_a",
            "col_b",
            F.col("value_overlap").alias("score"),
            F.col("recommended").alias("strong"),
        )
        best = keys.where("recommended").first()
        if best is not None:
            corr = cross_correlations(df, other, best["col_a"], best["col_b"])
            part = part.unionByName(
                corr.select(
                    F.lit(name).alias("dataset"),
                    F.lit("correlation").alias("section"),
                    "col_a",
                    "col_b",
                    F.col("pearson_r").alias("score"),
                    F.lit(True).alias("strong"),
                )
            )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no other dataset given")
    return out
