"""Multi-dimensional pivot that keeps every combination of the index levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import as_double, as_text, numeric_columns, present, ref, require_columns, text_columns
from tablewise.plans.ordering import row_index
from tablewise.plans.quantiles import exact_quantiles
from tablewise.plans.shape import null_safe_join, steady

AGGREGATES = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "mean": F.avg,
    "median": None,
    "min": F.min,
    "max": F.max,
    "count": lambda c: F.count(c).cast("double"),
}


def multidim_pivot(
    df: DataFrame,
    index: Sequence[str] | None = None,
    values: str | None = None,
    columns: Sequence[str] | None = None,
    agg: str = "sum",
    fillna: float | None = 0,
    top_n: int = 50,
) -> DataFrame:
    """Aggregate ``values`` by ``index`` (rows) and ``columns`` (pivoted).

    Index levels form a full product whose empty cells hold ``fillna``; NULL is a level of its
    own. More than ``top_n`` rows are cut to the largest by the last column; on ties rows that
    exist in the data come first, then index order.
    """
    if values is None:
        values = next(iter(numeric_columns(df)), None)
        if values is None:
            raise ValueError("no numeric column to aggregate")
    index = list(index) if index is not None else text_columns(df)[:2]
    if not index:
        raise ValueError("index dimensions required")
    if agg not in AGGREGATES:
        raise ValueError(f"agg must be one of {sorted(AGGREGATES)}")
    columns = list(columns or [])
    require_columns(df, values, *index, *columns)
    keys = [present(df, c).alias(c) for c in index]
    series = F.concat_ws("|", *[F.coalesce(as_text(df, c), F.lit("null")) for c in columns]) if columns else None
    narrow = df.select(*keys, as_double(df, values).alias("_value"), *([series.alias("_series")] if columns else []))
    cells, names = _cells(narrow, index, values, agg, bool(columns))
    return _complete(narrow, cells, index, names, fillna, top_n)


def _cells(narrow: DataFrame, index: list[str], values: str, agg: str, pivoted: bool) -> tuple[DataFrame, list[str]]:
    by = [*index, "_series"] if pivoted else index
    keys = [ref(k) for k in by]
    if agg == "median":
        cells = exact_quantiles(narrow, ["_value"], [0.5], by).select(*keys, F.col("quantiles")[0].alias("_cell"))
    else:
        # Aggregating before the pivot keeps the pivot itself on already small rows.
        cells = narrow.groupBy(*keys).agg(AGGREGATES[agg](F.col("_value")).alias("_cell"))
    if not pivoted:
        return cells.withColumnRenamed("_cell", values), [values]
    levels = sorted(r[0] for r in narrow.select("_series").distinct().limit(10_001).collect())
    if len(levels) > 10_000:
        raise ValueError("more than 10000 pivot columns")
    wide = cells.groupBy(*[ref(i) for i in index]).pivot("_series", levels).agg(F.first("_cell"))
    return wide, levels


def first_empty_cells(cells: DataFrame, index: Sequence[str], count: int) -> DataFrame:
    """The first ``count`` combinations of index levels, in index order, that are no row of ``cells``.

    A combination is the number that its level positions spell in mixed radix. If a present number has k missing
    ones below it, every missing one from the k-th on lies beyond it; so how many present numbers have few
    missing ones below tells the first missing numbers. The product of the levels is never made.
    """
    spark = cells.sparkSession
    rows, number, levels = cells.select(*[ref(i).alias(f"_k{k}") for k, i in enumerate(index)]).distinct(), F.lit(0).cast("decimal(38,0)"), []
    for k in range(len(index)):
        level = steady(row_index(rows.select(f"_k{k}").distinct(), [F.col(f"_k{k}").asc_nulls_first()], name=f"_p{k}"))
        levels.append((level, level.count()))
    numbered, total = rows, 1
    for k, (level, size) in enumerate(levels):
        numbered = null_safe_join(numbered, level, [f"_k{k}"])
        number = (number * F.lit(size).cast("decimal(38,0)") + F.col(f"_p{k}")).cast("decimal(38,0)")
        total *= size
    ranked = row_index(numbered.select(number.alias("_v")), ["_v"], name="_i")
    below = (F.col("_v") - F.col("_i")).cast("decimal(38,0)")
    few = ranked.where(below < count).groupBy(below.cast("long").alias("missing")).agg(F.count("*").alias("n"))
    passed = {r["missing"]: r["n"] for r in few.collect()}  # at most ``count`` rows
    found, present_ = [], 0
    for k in range(count):
        present_ += passed.get(k, 0)
        value, at = k + present_, []
        if value >= total:
            break
        for _, size in reversed(levels):
            value, place = divmod(value, size)
            at.append(place)
        found.append(tuple(reversed(at)))
    out = spark.createDataFrame(found, ", ".join(f"_p{k} long" for k in range(len(index))))
    for k, (level, _) in enumerate(levels):
        out = out.join(level, f"_p{k}")
    return out.select(*[F.col(f"_k{k}").alias(i) for k, i in enumerate(index)])


def _complete(
    narrow: DataFrame, cells: DataFrame, index: list[str], names: list[str], fillna: float | None, top_n: int
) -> DataFrame:
    fill = F.lit(fillna).cast("double")
    real = cells.select(*[ref(i) for i in index], *[F.coalesce(ref(c), fill).alias(c) for c in names], F.lit(True).alias("_real"))
    order = [ref(names[-1]).desc_nulls_last(), F.col("_real").desc_nulls_last(), *[ref(i) for i in index]]
    if len(index) == 1:
        return real.orderBy(*order).limit(top_n).drop("_real")
    # empty cells all hold the same value, so no more than the first ``top_n`` of them can be in the result
    empty = first_empty_cells(cells, index, top_n).select(
        *[ref(i) for i in index], *[fill.alias(c) for c in names], F.lit(False).alias("_real")
    )
    return real.unionByName(empty).orderBy(*order).limit(top_n).drop("_real")
