"""Data behind charts: bars, histograms, lines and scatter points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import as_double, missing, pearson, ref, require_columns

# Fixed point limits of the chart data.
BAR_ROWS = 200
LINE_POINTS = 2000


def bar_data(df: DataFrame, x: str, y: str, order_by: Sequence[str] | None = None, limit: int | None = BAR_ROWS) -> DataFrame:
    """First rows of two columns; Spark rows carry no order, so one is named (default ``x, y``)."""
    return multi_series_bar_data(df, x, [y], order_by, limit)


def multi_series_bar_data(
    df: DataFrame, x: str, y_cols: Sequence[str], order_by: Sequence[str] | None = None, limit: int | None = BAR_ROWS
) -> DataFrame:
    known = [y for y in y_cols if y in df.columns]
    if not known:
        raise ValueError(f"No known y column in {list(y_cols)}")
    require_columns(df, x)
    order = list(order_by or [x, *known])
    rows = df.orderBy(*[ref(o) for o in order]).select(ref(x), *[ref(y) for y in known])
    return rows if limit is None else rows.limit(limit)


def bin_edges(low: float, high: float, bins: int) -> tuple[float, float]:
    """Lower edge and width; a constant column gets half a unit on both sides."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    return low, (high - low) / bins


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between min and max, the last closed on the right; empty bins kept."""
    require_columns(df, column)
    value = as_double(df, column)
    spark = df.sparkSession
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if ends["lo"] is None:
        return spark.createDataFrame([], "bin int, bin_start double, bin_end double, count bigint")
    low, width = bin_edges(ends["lo"], ends["hi"], bins)
    slot = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(value.isNotNull()).groupBy(slot.alias("bin")).agg(F.count("*").alias("count"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        grid.join(counts, "bin", "left")
        .select(
            "bin",
            (F.lit(low) + F.col("bin") * F.lit(width)).alias("bin_start"),
            (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
        .orderBy("bin")
    )


def line_data(df: DataFrame, x: str, y: str, limit: int = LINE_POINTS) -> DataFrame:
    require_columns(df, x, y)
    clean = df.where(~missing(df, x) & ~missing(df, y)).select(ref(x), ref(y))
    return clean.orderBy(ref(x), ref(y)).limit(limit)


def scatter_data(df: DataFrame, x: str, y: str, limit: int = LINE_POINTS) -> DataFrame:
    """First points in (x, y) order with the Pearson correlation over *all* rows beside them."""
    require_columns(df, x, y)
    clean = df.where(~missing(df, x) & ~missing(df, y)).select(ref(x), ref(y))
    r = clean.agg(pearson(ref(x).cast("double"), ref(y).cast("double"))).first()[0]
    return clean.orderBy(ref(x), ref(y)).limit(limit).withColumn("correlation", F.lit(r).cast("double"))
