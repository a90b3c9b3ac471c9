"""Sums of products for least squares, gathered in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import ref


def moment_matrix(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and centred cross-product matrix of complete double columns.

    Two passes: centring on the means first keeps the sums well conditioned. Only k and k*k
    finished numbers reach the driver.
    """
    first = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(ref(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    n = int(first["n"])
    k = len(cols)
    if n == 0:
        return 0, np.zeros(k), np.zeros((k, k))
    means = np.array([first[f"m{i}"] for i in range(k)], dtype=float)
    sums = []
    for i in range(k):
        for j in range(i, k):
            sums.append(
                F.sum((ref(cols[i]) - F.lit(float(means[i]))) * (ref(cols[j]) - F.lit(float(means[j])))).alias(f"s{i}_{j}")
            )
    second = df.agg(*sums).first()
    s = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            s[i, j] = s[j, i] = second[f"s{i}_{j}"]
    return n, means, s
