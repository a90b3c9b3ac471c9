"""Distribution functions for finished test statistics (scalars only).

They come from the commons-math3 library that ships with Spark.
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession


def _dist(spark: SparkSession):
    return spark._jvm.org.apache.commons.math3.distribution


def t_tail(spark: SparkSession, stat: float | None, dof: float, alternative: str = "two-sided") -> float | None:
    """p-value of a t statistic."""
    if stat is None or math.isnan(stat) or dof <= 0:
        return None
    if math.isinf(stat):
        upper = 0.0 if stat > 0 else 1.0
    else:
        upper = float(_dist(spark).TDistribution(float(dof)).cumulativeProbability(-float(stat)))
    return _two_sided(upper, alternative)


def t_quantile(spark: SparkSession, p: float, dof: float) -> float:
    return float(_dist(spark).TDistribution(float(dof)).inverseCumulativeProbability(float(p)))


def normal_tail(spark: SparkSession, z: float | None, alternative: str = "two-sided") -> float | None:
    if z is None or math.isnan(z):
        return None
    return _two_sided(0.5 * math.erfc(z / math.sqrt(2)), alternative)


def normal_quantile(spark: SparkSession, p: float) -> float:
    return float(_dist(spark).NormalDistribution().inverseCumulativeProbability(float(p)))


def f_tail(spark: SparkSession, stat: float | None, d1: float, d2: float) -> float | None:
    if stat is None or math.isnan(stat) or d1 <= 0 or d2 <= 0:
        return None
    return 1.0 - float(_dist(spark).FDistribution(float(d1), float(d2)).cumulativeProbability(float(stat)))


def chi2_tail(spark: SparkSession, stat: float | None, dof: float) -> float | None:
    if stat is None or math.isnan(stat) or dof <= 0:
        return None
    gamma = spark._jvm.org.apache.commons.math3.special.Gamma
    return float(gamma.regularizedGammaQ(dof / 2.0, float(stat) / 2.0))


def _two_sided(upper: float, alternative: str) -> float:
    if alternative == "greater":
        return upper
    if alternative == "less":
        return 1.0 - upper
    return min(1.0, 2.0 * min(upper, 1.0 - upper))
