"""Exact linear-interpolation quantiles at any size.

When the plan and its number of values are proven small the built-in ``percentile`` runs inside one
aggregate, whose last step is one task. Beyond that, distinct values are counted (map-side combine) and globally ordered in
slices. The sizes of the slices tell which of them hold an order statistic that is asked for; only those are sorted, and the two
order statistics around each quantile are picked by their running count.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.columns import as_double, ref
from tablewise.plans.ordering import SLICE, sliced
from tablewise.plans.shape import (
    fits_in_memory,
    grouped_rows_from_aggregate,
    is_plain_scan,
    long_form,
    null_safe_join,
    short_splits,
    spread,
)


#: Values that one task may merge for built-in percentiles. A small file of packed columns can hold far more.
INLINE_VALUES = 4_000_000
#: Most values of an ordered slice, counted with their repeats.
SLICE_VALUES = 1_000_000


def fits_one_task(df: DataFrame, columns: int) -> bool:
    """True when one task may hold the distinct values of so many columns of ``df``."""
    return fits_in_memory(df) and df.count() * columns <= INLINE_VALUES


def percentile_expr(value: Column, probs: Sequence[float]) -> Column:
    return F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]))


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """``by..., column, quantiles array<double>`` aligned with ``probs``; NULL when no value."""
    narrow = df.select(*[ref(b) for b in by], *[as_double(df, c).alias(f"_v{i}") for i, c in enumerate(cols)])
    if fits_one_task(narrow, len(cols)):
        agg = spread(narrow).groupBy(*[ref(b) for b in by]).agg(
            *[percentile_expr(F.col(f"_v{i}"), probs).alias(f"_v{i}") for i in range(len(cols))]
        )
        structs = [
            F.struct(F.lit(c).alias("column"), F.col(f"_v{i}").alias("quantiles")) for i, c in enumerate(cols)
        ]
        return grouped_rows_from_aggregate(agg, by, structs)
    values = long_form(narrow, {c: F.col(f"_v{i}") for i, c in enumerate(cols)}, by)
    counts = (
        values.where(F.col("value").isNotNull())
        .groupBy(*[ref(b) for b in by], "column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    keys = [*by, "column"]
    if not is_plain_scan(narrow):  # counting its rows could cost as much as all the rest
        return _pick(sliced(counts, ["value"], keys), probs, keys)
    n = narrow.count() * len(cols)
    with short_splits(narrow, n):
        slices = max(narrow.sparkSession.sparkContext.defaultParallelism, math.ceil(n / SLICE_VALUES))
        return _pick(sliced(counts, ["value"], keys, slices), probs, keys)


def _pick(parts: DataFrame, probs: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Quantiles of counted values in ordered slices. A slice without an order statistic that is asked for is not sorted."""
    group = Window.partitionBy(*[ref(k) for k in keys])
    earlier = group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(*[ref(k) for k in keys], SLICE).agg(F.sum("n").alias("_t")).select(
        *[ref(k) for k in keys], SLICE, "_t", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_o"), F.sum("_t").over(group).alias("_total")
    )
    spots = [side((F.col("_total") - 1) * F.lit(float(p))) for p in probs for side in (F.floor, F.ceil)]
    asked = F.exists(F.array(*spots), lambda s: (F.col("_o") <= s) & (s < F.col("_o") + F.col("_t")))
    near = null_safe_join(parts, sizes.where(asked).drop("_t"), [*keys, SLICE])
    local = Window.partitionBy(*[ref(k) for k in keys], SLICE).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    rows = near.withColumn("n_before", F.col("_o") + F.coalesce(F.sum("n").over(local), F.lit(0)))

    def holds(position: Column) -> Column:
        return F.when((F.col("n_before") <= position) & (position < F.col("n_before") + F.col("n")), F.col("value"))

    picks = []
    for i, p in enumerate(probs):
        spot = (F.col("_total") - 1) * F.lit(float(p))
        picks.append(F.max(holds(F.floor(spot))).alias(f"_lo{i}"))
        picks.append(F.max(holds(F.ceil(spot))).alias(f"_hi{i}"))
    picked = rows.groupBy(*[ref(k) for k in keys], "_total").agg(*picks)
    blended = []
    for i, p in enumerate(probs):
        spot = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        blended.append(lo + (hi - lo) * (spot - F.floor(spot)))
    return picked.select(*[ref(k) for k in keys], F.array(*blended).alias("quantiles"))


def quantile_values(df: DataFrame, col: str, probs: Sequence[float]) -> list[float] | None:
    """Finished scalar quantiles of one column."""
    row = exact_quantiles(df, [col], probs).first()
    return list(row["quantiles"]) if row and row["quantiles"] is not None else None
