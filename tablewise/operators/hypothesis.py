"""Hypothesis tests: one distributed aggregate to sufficient statistics, then a scalar p-value."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import as_double, as_text, half_up, pearson, present, require_columns
from tablewise.functions.distributions import (
    chi2_tail,
    f_tail,
    normal_quantile,
    normal_tail,
    t_quantile,
    t_tail,
)
from tablewise.plans.ordering import value_ranks
from tablewise.plans.quantiles import exact_quantiles
from tablewise.plans.shape import one_row

# Fixed sample sizes of the power curve.
POWER_CURVE = (10, 20, 50, 100, 200, 500)
EXACT_RANK_ROWS = 8


def two_group_extract(
    df: DataFrame,
    col_a: str,
    group_col: str | None = None,
    group_a: str | None = None,
    group_b: str | None = None,
    col_b: str | None = None,
) -> DataFrame:
    """Rows ``side ('a'/'b'), label, value`` of the two compared samples.

    Without labels the two smallest group values by text order are compared.
    """
    if group_col and col_a:
        require_columns(df, group_col, col_a)
        if not (group_a and group_b):
            levels = (
                df.select(as_text(df, group_col).alias("g")).where(F.col("g").isNotNull()).distinct().orderBy("g").limit(2)
            )
            found = [r[0] for r in levels.collect()]
            if len(found) < 2:
                raise ValueError(f"'{group_col}' has fewer than 2 unique values")
            group_a, group_b = found
        rows = df.select(as_text(df, group_col).alias("g"), as_double(df, col_a).alias("value"))
        side = F.when(F.col("g") == group_a, "a").when(F.col("g") == group_b, "b")
        label = F.concat(F.lit(f"{col_a}["), F.col("g"), F.lit("]"))
        return rows.where(F.col("g").isin(group_a, group_b) & F.col("value").isNotNull()).select(
            side.alias("side"), label.alias("label"), "value"
        )
    if col_a and col_b:
        require_columns(df, col_a, col_b)
        pairs = F.array(
            F.struct(F.lit("a").alias("side"), F.lit(col_a).alias("label"), as_double(df, col_a).alias("value")),
            F.struct(F.lit("b").alias("side"), F.lit(col_b).alias("label"), as_double(df, col_b).alias("value")),
        )
        return df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull())
    raise ValueError("give col_a with group_col, or col_a with col_b")


def _sides(rows: DataFrame) -> dict[str, tuple]:
    stats = rows.groupBy("side").agg(
        F.max("label").alias("label"),
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.var_samp("value").alias("var"),
    )
    found = {r["side"]: (r["label"], r["n"], r["mean"], r["var"]) for r in stats.collect()}
    if any(s not in found or found[s][1] < 2 for s in ("a", "b")):
        raise ValueError("each group needs at least 2 observations")
    return found


def _pooled_d(a: tuple, b: tuple) -> float:
    _, na, ma, va = a
    _, nb, mb, vb = b
    if na + nb <= 2:
        return 0.0
    pooled = math.sqrt(((na - 1) * (va or 0.0) + (nb - 1) * (vb or 0.0)) / (na + nb - 2))
    return (ma - mb) / max(pooled, 1e-12)


def two_sample_t(
    df: DataFrame,
    col_a: str,
    group_col: str | None = None,
    group_a: str | None = None,
    group_b: str | None = None,
    col_b: str | None = None,
    alpha: float = 0.05,
    alternative: str = "two-sided",
) -> DataFrame:
    """Welch's t-test with pooled Cohen's d; the interval uses n1 + n2 - 2 degrees of freedom."""
    spark = df.sparkSession
    side = _sides(two_group_extract(df, col_a, group_col, group_a, group_b, col_b))
    a, b = side["a"], side["b"]
    ea, eb = a[3] / a[1], b[3] / b[1]
    diff, se = a[2] - b[2], math.sqrt(ea + eb)
    stat = diff / se if se > 0 else None
    dof = (ea + eb) ** 2 / (ea**2 / (a[1] - 1) + eb**2 / (b[1] - 1)) if se > 0 else 0.0
    p = t_tail(spark, stat, dof, alternative)
    half = t_quantile(spark, 1 - alpha / 2, a[1] + b[1] - 2) * se
    return one_row(
        spark,
        "group_a string, group_b string, n_a bigint, n_b bigint, mean_a double, mean_b double, t_statistic double, "
        "p_value double, significant boolean, cohens_d double, ci_lower double, ci_upper double",
        (
            a[0], b[0], a[1], b[1], half_up(a[2], 4), half_up(b[2], 4), half_up(stat, 4), half_up(p, 6),
            p is not None and p < alpha, half_up(_pooled_d(a, b), 4), half_up(diff - half, 4), half_up(diff + half, 4),
        ),
    )


def one_sample_t(
    df: DataFrame, col_a: str, popmean: float = 0.0, alpha: float = 0.05, alternative: str = "two-sided"
) -> DataFrame:
    require_columns(df, col_a)
    spark, x = df.sparkSession, as_double(df, col_a)
    row = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
    n, m, s = row["n"], row["m"], row["s"]
    if n < 2:
        raise ValueError("need at least 2 observations")
    stat = (m - popmean) / (s / math.sqrt(n)) if s > 0 else None
    p = t_tail(spark, stat, n - 1, alternative)
    return one_row(
        spark,
        "col string, sample_mean double, population_mean double, n bigint, t_statistic double, p_value double, "
        "significant boolean, cohens_d double",
        (
            col_a, half_up(m, 4), float(popmean), n, half_up(stat, 4), half_up(p, 6),
            p is not None and p < alpha, half_up((m - popmean) / max(s, 1e-12), 4),
        ),
    )


def paired_t(
    df: DataFrame, col_a: str, col_b: str, alpha: float = 0.05, alternative: str = "two-sided"
) -> DataFrame:
    require_columns(df, col_a, col_b)
    spark, gap = df.sparkSession, as_double(df, col_a) - as_double(df, col_b)
    row = df.agg(F.count(gap).alias("n"), F.avg(gap).alias("m"), F.stddev_samp(gap).alias("s")).first()
    n, m, s = row["n"], row["m"], row["s"]
    if n < 2:
        raise ValueError("need at least 2 paired observations")
    stat = m / (s / math.sqrt(n)) if s > 0 else None
    p = t_tail(spark, stat, n - 1, alternative)
    return one_row(
        spark,
        "col_a string, col_b string, n_pairs bigint, mean_diff double, t_statistic double, p_value double, "
        "significant boolean, cohens_d double",
        (
            col_a, col_b, n, half_up(m, 4), half_up(stat, 4), half_up(p, 6),
            p is not None and p < alpha, half_up(m / max(s, 1e-12), 4),
        ),
    )


def _partitions_to(few: int):
    """Function of t: the number of ways to write all whole numbers up to t as sums of parts 1 to ``few``.

    On every remainder modulo the least common multiple of the parts it is a polynomial of degree ``few``, so values at
    ``few`` + 1 points of each give all others, as fractions without rounding.
    """
    period = math.lcm(*range(1, few + 1))
    known = [1] + [0] * (period * (few + 1))
    for part in [*range(1, few + 1), 1]:  # the last one sums up
        for t in range(part, len(known)):
            known[t] += known[t - part]

    def count(t: int) -> int:
        if t < 0:
            return 0
        if t < len(known):
            return known[t]
        x, points = Fraction(t // period), [known[t % period + period * j] for j in range(few + 1)]
        value = Fraction(0)
        for j, y in enumerate(points):
            term = Fraction(y)
            for i in range(few + 1):
                if i != j:
                    term *= (x - i) / (j - i)
            value += term
        return int(value)

    return count


def _exact_u_tail(u: float, n1: int, n2: int, alternative: str) -> float:
    """Exact null distribution of U for untied samples, in whole numbers, for any size of the larger one.

    U counts partitions into at most ``few`` parts of at most ``many``: a Gaussian binomial. Its numerator, a product of
    ``few`` differences, is written out; the rest are partitions into small parts.
    """
    few, many = min(n1, n2), max(n1, n2)
    ways, total = _partitions_to(few), math.comb(n1 + n2, few)

    def at_most(t: int) -> int:
        out = 0
        for chosen in range(1 << few):
            lifted = [many + i + 1 for i in range(few) if chosen >> i & 1]
            out += (-1) ** len(lifted) * ways(t - sum(lifted))
        return out

    # the distribution is symmetric
    low = float(Fraction(at_most(math.floor(u)), total)) if u >= 0 else 0.0
    high = float(Fraction(at_most(math.floor(n1 * n2 - u)), total)) if u <= n1 * n2 else 0.0
    if alternative == "greater":
        return high
    if alternative == "less":
        return low
    return min(1.0, 2 * min(high, low))


def mannwhitney(
    df: DataFrame,
    col_a: str,
    group_col: str | None = None,
    group_a: str | None = None,
    group_b: str | None = None,
    col_b: str | None = None,
    alpha: float = 0.05,
    alternative: str = "two-sided",
) -> DataFrame:
    """Mann-Whitney U of sample a: average ranks, tie and continuity corrected normal p-value.

    Ranks come from counts per distinct value, so no row is ever joined back. With at most
    eight rows on one side and no ties the exact distribution is used.
    """
    spark = df.sparkSession
    rows = two_group_extract(df, col_a, group_col, group_a, group_b, col_b)
    side = _sides(rows)
    a, b = side["a"], side["b"]
    medians = {
        r["side"]: r["quantiles"][0] for r in exact_quantiles(rows, ["value"], [0.5], ["side"]).collect()
    }
    ranks = value_ranks(rows.withColumn("is_a", (F.col("side") == "a").cast("long")), "value", weights=["is_a"])
    totals = ranks.agg(
        F.sum(F.col("is_a") * F.col("avg_rank")).alias("rank_sum"),
        F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"),
    ).first()
    n1, n2 = a[1], b[1]
    n = n1 + n2
    u = totals["rank_sum"] - n1 * (n1 + 1) / 2
    if totals["ties"] == 0 and min(n1, n2) <= EXACT_RANK_ROWS:
        p = _exact_u_tail(u, n1, n2, alternative)
    else:
        sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - totals["ties"] / (n * (n - 1))))
        mean = n1 * n2 / 2
        if sd == 0:
            p = None
        elif alternative == "two-sided":
            top = max(u, n1 * n2 - u)
            p = min(1.0, 2 * normal_tail(spark, (top - mean - 0.5) / sd, "greater"))
        elif alternative == "greater":
            p = normal_tail(spark, (u - mean - 0.5) / sd, "greater")
        else:
            p = normal_tail(spark, (n1 * n2 - u - mean - 0.5) / sd, "greater")
    return one_row(
        spark,
        "group_a string, group_b string, n_a bigint, n_b bigint, median_a double, median_b double, u_statistic double, "
        "p_value double, significant boolean, rank_biserial_r double",
        (
            a[0], b[0], n1, n2, half_up(medians["a"], 4), half_up(medians["b"], 4), half_up(u, 2), half_up(p, 6),
            p is not None and p < alpha, half_up(1 - 2 * u / (n1 * n2), 4),
        ),
    )


def contingency_table(df: DataFrame, col_a: str, col_b: str) -> DataFrame:
    """``a, b, n`` of the non-missing pairs that occur."""
    return (
        df.select(present(df, col_a).alias("a"), present(df, col_b).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("a", "b")
        .agg(F.count("*").alias("n"))
    )


def chi_squared(df: DataFrame, col_a: str, col_b: str, alpha: float = 0.05) -> DataFrame:
    """Independence test; Yates' correction for 2x2 tables.

    Cells that do not occur contribute their expected count, which is N minus the expected
    counts of the cells that do, so the full table is never built.
    """
    require_columns(df, col_a, col_b)
    spark = df.sparkSession
    cells = contingency_table(df, col_a, col_b)
    rows = cells.groupBy("a").agg(F.sum("n").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("cb"))
    shape = rows.agg(F.count("*").alias("r"), F.sum("ra").alias("n")).first()
    r, total = shape["r"], shape["n"] or 0
    c = cols.count()
    if r < 2 or c < 2:
        raise ValueError("need at least a 2x2 table")
    joined = cells.join(rows, "a").join(cols, "b")
    expected = F.col("ra") * F.col("cb") / F.lit(float(total))
    if r == 2 and c == 2:
        # All four cells matter under the correction; at most four rows here.
        ra = {x["a"]: x["ra"] for x in rows.collect()}
        cb = {x["b"]: x["cb"] for x in cols.collect()}
        seen = {(x["a"], x["b"]): x["n"] for x in cells.collect()}
        stat = 0.0
        for i, ri in ra.items():
            for j, cj in cb.items():
                e = ri * cj / total
                gap = abs(seen.get((i, j), 0) - e)
                stat += (gap - min(0.5, gap)) ** 2 / e
    else:
        sums = joined.agg(
            F.sum(F.pow(F.col("n") - expected, 2) / expected).alias("s"), F.sum(expected).alias("e")
        ).first()
        stat = sums["s"] + max(total - sums["e"], 0.0)
    dof = (r - 1) * (c - 1)
    p = chi2_tail(spark, stat, dof)
    v = math.sqrt(stat / (total * (min(r, c) - 1)))
    strength = "strong" if v > 0.5 else "moderate" if v > 0.3 else "weak" if v > 0.1 else "negligible"
    return one_row(
        spark,
        "col_a string, col_b string, n bigint, n_rows bigint, n_cols bigint, chi2_statistic double, dof bigint, "
        "p_value double, significant boolean, cramers_v double, association_strength string",
        (
            col_a, col_b, total, r, c, half_up(stat, 4), dof, half_up(p, 6), p is not None and p < alpha,
            half_up(v, 4), strength,
        ),
    )


def anova_groups(df: DataFrame, col_a: str, group_col: str) -> DataFrame:
    """``group, n, mean, within`` of the groups with at least two values."""
    return (
        df.select(as_text(df, group_col).alias("group"), as_double(df, col_a).alias("x"))
        .where(F.col("group").isNotNull() & F.col("x").isNotNull())
        .groupBy("group")
        .agg(F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("within"))
        .where(F.col("n") >= 2)
    )


def anova(df: DataFrame, col_a: str, group_col: str, alpha: float = 0.05) -> DataFrame:
    require_columns(df, col_a, group_col)
    spark = df.sparkSession
    groups = anova_groups(df, col_a, group_col)
    top = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s")).first()
    k, n = top["k"], top["n"] or 0
    if k < 2:
        raise ValueError("need at least 2 groups with 2 or more observations each")
    grand = top["s"] / n
    parts = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.lit(grand), 2)).alias("between"), F.sum("within").alias("within")
    ).first()
    between, within = parts["between"], parts["within"]
    stat = (between / (k - 1)) / (within / (n - k)) if within > 0 and n > k else None
    p = f_tail(spark, stat, k - 1, n - k)
    eta = between / (between + within) if between + within > 0 else 0.0
    size = "large" if eta > 0.14 else "medium" if eta > 0.06 else "small"
    return one_row(
        spark,
        "col string, group_col string, n_groups bigint, n bigint, f_statistic double, p_value double, significant boolean, "
        "eta_squared double, effect_magnitude string",
        (
            col_a, group_col, k, n, half_up(stat, 4), half_up(p, 6), p is not None and p < alpha, half_up(eta, 4), size,
        ),
    )


def anova_group_means(df: DataFrame, col_a: str, group_col: str) -> DataFrame:
    require_columns(df, col_a, group_col)
    return anova_groups(df, col_a, group_col).select("group", "n", F.round("mean", 4).alias("mean")).orderBy("group")


def correlation_test(df: DataFrame, col_a: str, col_b: str, alpha: float = 0.05) -> DataFrame:
    """Pearson and Spearman on complete pairs with t-based p-values."""
    require_columns(df, col_a, col_b)
    spark = df.sparkSession
    pairs = (
        df.select(as_double(df, col_a).alias("a"), as_double(df, col_b).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("a", "b")
        .agg(F.count("*").alias("w"))
    )
    flat = df.select(as_double(df, col_a).alias("a"), as_double(df, col_b).alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull()
    )
    first = flat.agg(F.count("*").alias("n"), pearson(F.col("a"), F.col("b")).alias("r")).first()
    n = first["n"]
    if n < 3:
        raise ValueError("need at least 3 paired observations")
    rank_a = value_ranks(flat, "a").select("a", F.col("avg_rank").alias("ra"))
    rank_b = value_ranks(flat, "b").select("b", F.col("avg_rank").alias("rb"))
    mid = (n + 1) / 2.0  # mean of average ranks
    ranked = pairs.join(rank_a, "a").join(rank_b, "b")
    da, db, w = F.col("ra") - mid, F.col("rb") - mid, F.col("w")
    s = ranked.agg(F.sum(w * da * db).alias("ab"), F.sum(w * da * da).alias("aa"), F.sum(w * db * db).alias("bb")).first()
    rho = s["ab"] / math.sqrt(s["aa"] * s["bb"]) if s["aa"] > 0 and s["bb"] > 0 else None
    r = first["r"]

    def p_of(x: float | None) -> float | None:
        if x is None or math.isnan(x):
            return None
        if abs(x) >= 1:
            return 0.0
        return t_tail(spark, x * math.sqrt((n - 2) / (1 - x * x)), n - 2)

    pr, ps = p_of(r), p_of(rho)
    return one_row(
        spark,
        "col_a string, col_b string, n bigint, pearson_r double, pearson_p double, spearman_r double, spearman_p double, "
        "pearson_significant boolean, spearman_significant boolean",
        (
            col_a, col_b, n, half_up(r, 4), half_up(pr, 6), half_up(rho, 4), half_up(ps, 6),
            pr is not None and pr < alpha, ps is not None and ps < alpha,
        ),
    )


def _power(spark, d: float, n: int, alpha: float) -> float:
    z = normal_quantile(spark, 1 - alpha / 2)
    shift = abs(d) * math.sqrt(n / 2)
    return normal_tail(spark, z - shift, "greater") + normal_tail(spark, z + shift, "greater")


def power_analysis(
    df: DataFrame | None = None,
    spark=None,
    effect_size: float | None = None,
    col_a: str | None = None,
    col_b: str | None = None,
    group_col: str | None = None,
    group_a: str | None = None,
    group_b: str | None = None,
    n_obs: int | None = None,
    alpha: float = 0.05,
    target_power: float = 0.8,
) -> DataFrame:
    """Achieved power for ``n_obs`` or the required n, and the power curve, one row per n."""
    spark = spark or df.sparkSession
    d = effect_size
    if d is None:
        if df is None or not col_a:
            raise ValueError("give effect_size, or columns to compute it from")
        side = _sides(two_group_extract(df, col_a, group_col, group_a, group_b, col_b))
        d = _pooled_d(side["a"], side["b"])
    d = abs(d)
    za, zb = normal_quantile(spark, 1 - alpha / 2), normal_quantile(spark, target_power)
    need = math.ceil(2 * ((za + zb) / max(d, 1e-9)) ** 2)
    points: Sequence[tuple[str, int]] = [("n_obs", n_obs)] if n_obs else [("required", need)]
    points = [*points, *[("curve", n) for n in POWER_CURVE]]
    rows = [
        (kind, half_up(d, 4), int(n), half_up(_power(spark, d, n, alpha), 4 if kind != "curve" else 3), int(need), target_power)
        for kind, n in points
    ]
    return spark.createDataFrame(
        rows, "point string, cohens_d double, n_per_group bigint, power double, required_n bigint, target_power double"
    )
