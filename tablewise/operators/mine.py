"""Isolation-forest anomalies, their explanation, and k-means clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import as_double, ratio, ref, require_between, require_columns
from tablewise.plans.ordering import value_ranks
from tablewise.plans.quantiles import quantile_values
from tablewise.plans.shape import long_form, rows_from_aggregate, spread, steady

# Fixed parameters of the forest and the report.
TREES, TREE_ROWS = 300, 256
SEED = 42
STD_FLOOR = 1e-9
# Rows that walk through the trees at once.
WALK_ROWS = 16_384


def complete_rows(df: DataFrame, cols: Sequence[str], key: Sequence[str]) -> DataFrame:
    require_columns(df, *cols, *key)
    return df.select(*[ref(k) for k in key], *[as_double(df, c).alias(f"_x{i}") for i, c in enumerate(cols)]).dropna(
        subset=[f"_x{i}" for i in range(len(cols))]
    )


def _path_length(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random binary tree of n rows."""
    n = np.asarray(n, dtype="float64")
    big = np.maximum(n, 3.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big))


def _grow(pool: np.ndarray, rng: np.random.Generator, rows: int) -> tuple[list, list, list, list]:
    """One tree as node arrays: feature (-1 at leaves), threshold, left child, leaf depth score."""
    sample = pool[rng.choice(len(pool), size=min(rows, len(pool)), replace=False)]
    limit = math.ceil(math.log2(max(len(sample), 2)))
    feature, cut, left, value = [-1], [0.0], [0], [0.0]
    stack = [(0, sample, 0)]
    while stack:
        node, data, depth = stack.pop()
        low, high = data.min(0), data.max(0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(data) <= 1 or not len(usable):
            value[node] = depth + float(_path_length(np.array([len(data)]))[0])
            continue
        f = int(rng.choice(usable))
        t = float(rng.uniform(low[f], high[f]))
        child = len(feature)
        feature[node], cut[node], left[node] = f, t, child
        for _ in range(2):
            feature.append(-1)
            cut.append(0.0)
            left.append(0)
            value.append(0.0)
        side = data[:, f] <= t
        stack += [(child, data[side], depth + 1), (child + 1, data[~side], depth + 1)]
    return feature, cut, left, value


def _in_levels(f: np.ndarray, t: np.ndarray, left: np.ndarray, v: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree for walks of equal length: depth, features, cuts, left children and values. Leaves lead to themselves,
    as nothing lies above their cut."""
    depth, level = 0, np.zeros(1, dtype="int64")
    while len(level := level[f[level] >= 0]):
        depth, level = depth + 1, np.concatenate([left[level], left[level] + 1])
    leaf = f < 0
    return depth, np.where(leaf, 0, f).astype("int64"), np.where(leaf, np.inf, t), np.where(leaf, np.arange(len(f)), left).astype("int64"), v


def _depths(x: np.ndarray, trees: Sequence[tuple]) -> np.ndarray:
    """Sum of the leaf values that each row reaches; so many rows at a time go through all trees."""
    out = np.zeros(len(x))
    for begin in range(0, len(x), WALK_ROWS):
        part = np.ascontiguousarray(x[begin : begin + WALK_ROWS])
        n, k = part.shape
        flat, first = part.reshape(-1), np.arange(n) * k
        node, at, go = np.empty(n, "int64"), np.empty(n, "int64"), np.empty(n, bool)
        value, cut, total = np.empty(n), np.empty(n), out[begin : begin + n]
        for depth, f, t, left, v in trees:
            node.fill(0)
            for _ in range(depth):
                np.take(f, node, out=at, mode="clip")
                at += first
                np.take(flat, at, out=value, mode="clip")
                np.take(t, node, out=cut, mode="clip")
                np.greater(value, cut, out=go)
                np.take(left, node, out=at, mode="clip")
                np.add(at, go, out=node)
            total += np.take(v, node, out=value, mode="clip")
    return out


def isolation_scores(
    df: DataFrame, numeric_cols: Sequence[str], key: Sequence[str], trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED
) -> DataFrame:
    """``key..., raw_score`` of every complete row (lower is more anomalous).

    Trees draw from a pool of at most ``trees * tree_rows`` hashed rows, are grown in parallel
    tasks, and travel as a few hundred small node arrays to one scan that scores all rows.
    """
    rows = complete_rows(df, numeric_cols, key)
    k = len(numeric_cols)
    xs = [f"_x{i}" for i in range(k)]
    n, want = rows.count(), trees * tree_rows
    if n == 0:
        raise ValueError("no complete row")
    mixed = F.xxhash64(*[ref(c) for c in key], *xs, F.lit(seed))
    part = rows
    if n > 3 * want:  # thin out first, so that no task returns more than a few rows
        part = rows.where(F.pmod(mixed, F.lit(1_000_000)) < math.ceil(3 * want / n * 1_000_000))
    pool = part.orderBy(mixed).select(*xs).limit(want).toPandas().to_numpy(dtype="float64")
    spark = df.sparkSession

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [_grow(pool, np.random.default_rng([seed, int(i)]), tree_rows) for i in b["id"]]
            yield pd.DataFrame(
                {"id": b["id"], "f": [m[0] for m in made], "t": [m[1] for m in made], "l": [m[2] for m in made], "v": [m[3] for m in made]}
            )

    forest = (
        spark.range(trees, numPartitions=min(trees, spark.sparkContext.defaultParallelism))
        .mapInPandas(grow, "id long, f array<int>, t array<double>, l array<int>, v array<double>")
        .collect()  # trees * (2 * tree_rows - 1) nodes at most
    )
    nodes = [_in_levels(*(np.array(r[c]) for c in "ftlv")) for r in sorted(forest, key=lambda r: r["id"])]
    norm = float(_path_length(np.array([min(tree_rows, len(pool))]))[0]) or 1.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in xs], 1)
            raw = -np.power(2.0, -_depths(x, nodes) / len(nodes) / norm)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(key)], pa.array(raw)], [*key, "raw_score"])

    schema = T.StructType([rows.schema[c] for c in key] + [T.StructField("raw_score", T.DoubleType())])
    return spread(rows).mapInArrow(score, schema)


def anomaly_scores(
    df: DataFrame, numeric_cols: Sequence[str], key: Sequence[str], contamination: float = 0.02, trees: int = TREES
) -> DataFrame:
    """``key..., score, is_anomaly`` of every complete row; negative scores are flagged."""
    require_between("contamination", contamination, 0.0, 0.5)
    raw = steady(isolation_scores(df, numeric_cols, key, trees))
    offset = quantile_values(raw, "raw_score", [contamination])[0]
    score = F.col("raw_score") - F.lit(offset)
    return raw.select(*[ref(k) for k in key], score.alias("score"), (score < 0).alias("is_anomaly"))


def anomaly_scan(
    df: DataFrame,
    numeric_cols: Sequence[str],
    key: Sequence[str],
    contamination: float = 0.02,
    trees: int = TREES,
    limit: int | None = None,
) -> DataFrame:
    """All flagged rows, the worst first, or the ``limit`` worst."""
    scores = anomaly_scores(df, numeric_cols, key, contamination, trees)
    worst = scores.where("is_anomaly").orderBy("score", *[ref(k) for k in key]).drop("is_anomaly")
    return worst if limit is None else worst.limit(limit)


def explain_anomaly(df: DataFrame, numeric_cols: Sequence[str], rows: DataFrame, key: Sequence[str], top_k: int = 10) -> DataFrame:
    """Why rows stand out, for all given rows at once.

    ``key..., feature, value, percentile (share of smaller values), z_score, direction, rank``
    """
    require_columns(df, *numeric_cols, *key)
    values = {c: as_double(df, c) for c in numeric_cols}
    tall = long_form(df, values).where(F.col("value").isNotNull())
    ranks = value_ranks(tall, "value", ["column"]).select("column", "value", "n_before")
    stats = rows_from_aggregate(
        df.agg(
            *[F.count(v).alias(f"n{i}") for i, v in enumerate(values.values())],
            *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values.values())],
            *[F.stddev_samp(v).alias(f"s{i}") for i, v in enumerate(values.values())],
        ),
        [
            F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"s{i}").alias("s"))
            for i, c in enumerate(values)
        ],
    )
    wanted = rows.select(*[ref(k) for k in key], *[as_double(rows, c).alias(c) for c in numeric_cols])
    asked = long_form(wanted, {c: ref(c) for c in numeric_cols}, key).where(F.col("value").isNotNull())
    joined = asked.join(ranks, ["column", "value"]).join(F.broadcast(stats), "column")  # one row per feature
    pct = ratio(F.col("n_before"), F.col("n")) * 100
    z = (F.col("value") - F.col("m")) / F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(STD_FLOOR))
    order = Window.partitionBy(*[ref(k) for k in key]).orderBy(F.abs(F.col("percentile") - 50).desc(), "feature")
    return (
        joined.select(
            *[ref(k) for k in key],
            F.col("column").alias("feature"),
            F.round("value", 6).alias("value"),
            F.round(pct, 1).alias("percentile"),
            F.round(z, 2).alias("z_score"),
            F.when(pct > 50, "high").otherwise("low").alias("direction"),
        )
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_k)
    )


# ---- clusters ----


def kmeans_clusters(df: DataFrame, numeric_cols: Sequence[str], key: Sequence[str], k: int = 5, seed: int = SEED) -> DataFrame:
    """``key..., the columns, cluster, _scaled``: k-means on standardised complete rows."""
    rows = complete_rows(df, numeric_cols, key)
    n = rows.count()
    if n < 3:
        raise ValueError("need at least 3 complete rows")
    k = max(2, min(k, n - 1))
    xs = [f"_x{i}" for i in range(len(numeric_cols))]
    stages = [
        VectorAssembler(inputCols=xs, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        KMeans(featuresCol="_scaled", predictionCol="cluster", k=k, seed=seed),
    ]
    out = Pipeline(stages=stages).fit(rows).transform(rows)
    return out.select(*[ref(c) for c in key], *[ref(x).alias(c) for x, c in zip(xs, numeric_cols)], "cluster", "_scaled")


def cluster_summary(clusters: DataFrame, numeric_cols: Sequence[str]) -> DataFrame:
    """Size, share and feature means of each cluster in original units."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"), *[F.avg(ref(c)).alias(c) for c in numeric_cols])
    total = sizes.agg(F.sum("size").alias("n")).first()["n"] or 1
    return sizes.withColumn("pct", F.round(F.col("size") / F.lit(float(total)) * 100, 2)).orderBy("cluster")


def silhouette(clusters: DataFrame) -> DataFrame:
    """Mean silhouette and the distance it is of. That is squared Euclidean, which needs only
    per-cluster sums and so one pass; it reads higher than the plain Euclidean one, whose usual
    grades (above 0.25, above 0.5) do not apply."""
    if clusters.select("cluster").distinct().limit(2).count() < 2:
        raise ValueError("one cluster only")
    value = ClusteringEvaluator(featuresCol="_scaled", predictionCol="cluster", metricName="silhouette").evaluate(clusters)
    return clusters.sparkSession.createDataFrame([(float(value), "squared_euclidean")], "silhouette double, distance string")
