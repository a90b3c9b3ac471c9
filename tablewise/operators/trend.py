"""Resampled time series, growth and trend lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.columns import as_double, kinds, numeric_columns, ref, require_columns, text_columns
from tablewise.plans.quantiles import exact_quantiles
from tablewise.plans.shape import null_safe_join

# Fixed rules: span in days above which months or weeks are used, and the parse share of a date column.
LONG_SPAN_DAYS = 400
MEDIUM_SPAN_DAYS = 60
PARSE_SHARE = 0.9

AGGREGATES = ("sum", "mean", "median", "min", "max", "count")


def as_timestamp(df: DataFrame, name: str) -> Column:
    if kinds(df)[name] == "datetime":
        return ref(name).cast("timestamp")
    return F.try_to_timestamp(ref(name).cast("string"))


def detect_datetime_col(df: DataFrame) -> str | None:
    """First datetime column, else the first text column of which 90 % parses."""
    for c, k in kinds(df).items():
        if k == "datetime":
            return c
    texts = text_columns(df)
    if not texts:
        return None
    row = df.agg(
        *[F.avg(as_timestamp(df, c).isNotNull().cast("double")).alias(f"p{i}") for i, c in enumerate(texts)]
    ).first()
    for i, c in enumerate(texts):
        if row[f"p{i}"] is not None and row[f"p{i}"] >= PARSE_SHARE:
            return c
    return None


def infer_freq(span_days: float) -> str:
    if span_days > LONG_SPAN_DAYS:
        return "M"
    return "W" if span_days > MEDIUM_SPAN_DAYS else "D"


def period_label(ts: Column, freq: str) -> Column:
    """Date that names the period: the day, the closing Sunday, or the last day of the period."""
    day = F.to_date(ts)
    labels = {
        "D": day,
        "W": F.next_day(F.date_sub(day, 1), "Sun"),
        "M": F.last_day(day),
        "Q": F.last_day(F.add_months(F.trunc(day, "quarter"), 2)),
        "Y": F.last_day(F.add_months(F.trunc(day, "year"), 11)),
    }
    if freq not in labels:
        raise ValueError(f"freq must be one of {sorted(labels)}")
    return labels[freq]


def _calendar(low: Column, high: Column, freq: str) -> Column:
    """All period labels from ``low`` to ``high`` (both labels already)."""
    if freq in ("D", "W"):
        return F.sequence(low, high, F.expr("interval 1 day" if freq == "D" else "interval 7 day"))
    step = {"M": 1, "Q": 3, "Y": 12}[freq]
    starts = F.sequence(F.trunc(low, "month"), F.trunc(high, "month"), F.expr(f"interval {step} month"))
    return F.transform(starts, lambda d: F.last_day(d))


def _resolve(df: DataFrame, date_col, value_col, freq, by: Sequence[str] = ()) -> tuple[DataFrame, str, str, str] | None:
    date_col = date_col or detect_datetime_col(df)
    if date_col is None:
        raise ValueError("no datetime column found or given")
    value_col = value_col or next((c for c in numeric_columns(df) if c != date_col), None)
    if value_col is None:
        raise ValueError("no numeric value column found or given")
    require_columns(df, date_col, value_col, *by)
    rows = df.select(*[ref(b) for b in by], as_timestamp(df, date_col).alias("ts"), as_double(df, value_col).alias("value")).where(
        F.col("ts").isNotNull() & F.col("value").isNotNull()
    )
    if freq == "auto":
        ends = rows.agg(F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("b")).first()
        freq = "D" if ends["a"] is None else infer_freq((ends["b"] - ends["a"]) / 86_400_000_000)
    return rows, date_col, value_col, freq


def trend_periods(
    df: DataFrame, date_col: str | None = None, value_col: str | None = None, freq: str = "auto", agg: str = "sum",
    by: Sequence[str] = (),
) -> DataFrame:
    """``by..., period, value``: sum and count keep empty periods as 0, the other aggregates drop them.

    Each series of ``by`` columns has its own calendar, from its first period to its last.
    """
    if agg not in AGGREGATES:
        raise ValueError(f"agg must be one of {AGGREGATES}")
    rows, _, _, freq = _resolve(df, date_col, value_col, freq, by)
    keys = [ref(b) for b in by]
    rows = rows.select(*keys, period_label(F.col("ts"), freq).alias("period"), "value")
    if agg == "median":
        return exact_quantiles(rows, ["value"], [0.5], [*by, "period"]).select(*keys, "period", F.col("quantiles")[0].alias("value"))
    fn = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}[agg]
    out = rows.groupBy(*keys, "period").agg(fn("value").cast("double").alias("value"))
    if agg not in ("sum", "count"):
        return out
    span = out.groupBy(*keys).agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    calendar = span.where(F.col("lo").isNotNull()).select(
        *keys, F.explode(_calendar(F.col("lo"), F.col("hi"), freq)).alias("period")
    )
    filled = null_safe_join(calendar, out, [*by, "period"], "left")
    return filled.select(*keys, "period", F.coalesce("value", F.lit(0.0)).alias("value"))


def pct_change(periods: DataFrame) -> DataFrame:
    """Percent change against the previous period; from zero it is infinite (or NaN for 0 to 0).

    The window is unpartitioned, but over one row per period.
    """
    prev = F.lag("value").over(Window.orderBy("period"))
    value = F.col("value")
    change = (
        F.when(prev.isNull(), F.lit(None).cast("double"))
        .when((prev == 0) & (value == 0), F.lit(float("nan")))
        .when(prev == 0, F.when(value > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
        .otherwise((value / prev - 1) * 100)
    )
    return periods.withColumn("pct_change", change)


def trend_summary(
    df: DataFrame, date_col: str | None = None, value_col: str | None = None, freq: str = "auto", agg: str = "sum"
) -> DataFrame:
    """One row: fitted direction and overall change, latest value and change, peak and trough."""
    _, date_col, value_col, freq = _resolve(df, date_col, value_col, freq)
    periods = pct_change(trend_periods(df, date_col, value_col, freq, agg)).withColumn(
        "x", F.row_number().over(Window.orderBy("period")) - 1
    )
    early = F.struct(-F.datediff("period", F.lit("1970-01-01")))
    s = periods.agg(
        F.count("*").alias("n_periods"),
        F.regr_slope("value", "x").alias("slope"),
        F.regr_intercept("value", "x").alias("intercept"),
        F.max_by("value", "period").alias("latest_value"),
        F.max_by("pct_change", "period").alias("latest_change"),
        F.max_by("period", F.struct("value", early)).alias("peak_period"),
        F.max("value").alias("peak_value"),
        F.max_by("period", F.struct(-F.col("value"), early)).alias("trough_period"),
        F.min("value").alias("trough_value"),
    ).where(F.col("n_periods") >= 2)
    slope, first = F.col("slope"), F.col("intercept")
    return s.select(
        F.lit(date_col).alias("date_col"),
        F.lit(value_col).alias("value_col"),
        F.lit(freq).alias("freq"),
        F.lit(agg).alias("agg"),
        "n_periods",
        F.when(slope > 0, "upward").when(slope < 0, "downward").otherwise("flat").alias("direction"),
        F.round(F.when(first != 0, slope * (F.col("n_periods") - 1) / F.abs(first) * 100), 2).alias("overall_change_pct"),
        "latest_value",
        F.round(F.when(~F.isnan("latest_change"), F.col("latest_change")), 2).alias("latest_change_pct"),
        F.col("peak_period").cast("string").alias("peak_period"),
        "peak_value",
        F.col("trough_period").cast("string").alias("trough_period"),
        "trough_value",
    )

