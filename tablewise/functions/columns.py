"""Column-level building blocks. Everything here returns a Column and stays JVM-side."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)
DATETIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def kind_of(dtype: T.DataType) -> str:
    """Analysis kind of a Spark type: boolean, datetime, numeric or categorical."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, DATETIMES):
        return "datetime"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    return "categorical"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in kinds(df).items() if k == "numeric"]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def ref(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for floating point columns."""
    c = ref(name)
    if isinstance(df.schema[name].dataType, FLOATING):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, so that every aggregate skips it."""
    c = ref(name)
    if isinstance(df.schema[name].dataType, FLOATING):
        return F.when(~F.isnan(c), c)
    return c


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric reading of any column: unparseable text and NaN become NULL."""
    dtype = df.schema[name].dataType
    c = ref(name)
    if isinstance(dtype, FLOATING):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    parsed = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def as_text(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, NESTED):
        return F.to_json(ref(name)) if not isinstance(dtype, T.VariantType) else ref(name).cast("string")
    return present(df, name).cast("string")


def half_up(x: float | None, digits: int) -> float | None:
    """Round a finished number exactly as the SQL ``round`` does: half away from zero."""
    if x is None or not math.isfinite(x):
        return x
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


def adjusted_skewness(c: Column) -> Column:
    """Bias-corrected G1 skewness; NULL for fewer than three values."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def pearson(x: Column, y: Column) -> Column:
    """Correlation of the pairs where both are present; NULL when either side is constant.

    The built-in ``corr`` fails on a constant column under ANSI arithmetic.
    """
    return F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))


def ratio(a: Column, b: Column) -> Column:
    """Quotient, NULL over zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def word_tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def require_columns(df: DataFrame, *names: str | None) -> None:
    absent = [n for n in names if n is not None and n not in df.columns]
    if absent:
        raise ValueError(f"Columns not found: {absent}. Available: {df.columns}")


def require_between(name: str, value, low, high) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, got {value}")


def limited(df: DataFrame, sample: float | None) -> DataFrame:
    """Optional Bernoulli sample; the default keeps every row."""
    if sample is None:
        return df
    require_between("sample", sample, 0.0, 1.0)
    return df.sample(fraction=float(sample), seed=42)
