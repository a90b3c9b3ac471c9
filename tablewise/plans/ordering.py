"""Global order without a single-task window.

Rows are range-partitioned on (group, order), the partition number is pinned by a reliable
checkpoint, each slice is summed, slice offsets are accumulated (one row per group and slice)
and added back. A group that holds a third of all rows is spread over a third of the slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.columns import ref
from tablewise.plans.shape import null_safe_join, steady

SLICE = "_slice"


def _col(c: str | Column) -> Column:
    return ref(c) if isinstance(c, str) else c


def sliced(df: DataFrame, order: Sequence[str | Column], by: Sequence[str], slices: int | None = None) -> DataFrame:
    """The rows with the number of their slice, pinned; as many slices as asked for, else as Spark makes."""
    keys = [ref(b) for b in by] + [_col(o) for o in order]
    ordered = df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    return steady(ordered.withColumn(SLICE, F.spark_partition_id()))


def _with_offsets(parts: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    # Without groups there is one offset row per slice, so the broadcast is bounded by the
    # partition count; with groups the join strategy is left to the optimizer.
    right = offsets if by else F.broadcast(offsets)
    return null_safe_join(parts, right, [*by, SLICE], "left")


def running_sums(
    df: DataFrame, order: Sequence[str | Column], sums: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Add ``<c>_before``: the sum of ``c`` over all earlier rows of the group.

    ``order`` must identify a row within its group (pre-aggregate on it or append a key).
    """
    parts = sliced(df, order, by)
    per_slice = parts.groupBy(*[ref(b) for b in by], SLICE).agg(*[F.sum(ref(c)).alias(f"_t_{c}") for c in sums])
    earlier = Window.partitionBy(*[ref(b) for b in by]).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *[ref(b) for b in by], SLICE, *[F.sum(ref(f"_t_{c}")).over(earlier).alias(f"_o_{c}") for c in sums]
    )
    local = (
        Window.partitionBy(*[ref(b) for b in by], SLICE)
        .orderBy(*[_col(o) for o in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = _with_offsets(parts, offsets, by)
    zero = {c: F.lit(0).cast(df.schema[c].dataType) for c in sums}
    return out.select(
        *[ref(c) for c in df.columns],
        *[
            (F.coalesce(ref(f"_o_{c}"), zero[c]) + F.coalesce(F.sum(ref(c)).over(local), zero[c])).alias(f"{c}_before")
            for c in sums
        ],
    )


def row_index(
    df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "row_idx"
) -> DataFrame:
    """Zero-based position of each row in the global order (per group)."""
    parts = sliced(df, order, by)
    per_slice = parts.groupBy(*[ref(b) for b in by], SLICE).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*[ref(b) for b in by]).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *[ref(b) for b in by], SLICE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o")
    )
    local = Window.partitionBy(*[ref(b) for b in by], SLICE).orderBy(*[_col(o) for o in order])
    out = _with_offsets(parts, offsets, by)
    return out.select(
        *[ref(c) for c in df.columns], (F.col("_o") + F.row_number().over(local) - 1).cast("long").alias(name)
    )


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), weights: Sequence[str] = ()) -> DataFrame:
    """Ranks of the distinct non-null values: ``by..., value, n, n_before, avg_rank, min_rank``.

    ``weights`` are extra columns summed per value (for example a group indicator).
    """
    counts = (
        df.where(ref(value).isNotNull())
        .groupBy(*[ref(b) for b in by], ref(value))
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(ref(w)).alias(w) for w in weights])
    )
    ranked = running_sums(counts, [value], ["n"], by)
    return ranked.withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / 2.0).withColumn(
        "min_rank", F.col("n_before") + 1
    )
