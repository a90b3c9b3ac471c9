"""Spark jobs side by side, and vectors inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

#: Jobs that are submitted at once; small fits leave most cores idle one by one.
SIDE_BY_SIDE = 6


def side_by_side(work: Callable, items: Sequence) -> list:
    """``work`` of every item, some at a time from threads of the driver, in order. Each has a scheduler pool
    of its own, which matters where the session schedules fairly. The first error is raised."""
    items = list(items)
    spark = SparkSession.getActiveSession()
    if len(items) < 2 or spark is None:
        return [work(x) for x in items]
    sc = spark.sparkContext

    def one(numbered):
        number, item = numbered
        sc.setLocalProperty("spark.scheduler.pool", f"side-{number % SIDE_BY_SIDE}")
        try:
            return work(item)
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    target = inheritable_thread_target(spark)(one)
    with ThreadPoolExecutor(min(SIDE_BY_SIDE, len(items))) as pool:
        return list(pool.map(target, enumerate(items)))


def list_matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array<double> column, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), len(flat) // len(column) if len(column) else 0)
