"""Profiles, quality scans, charts, pivots."""

from pyspark.sql import functions as F

from tablewise.operators import charts, pivot, profile
from workload.registry import Tables, query

_R = 4


def _rounded(df, *cols, digits=_R):
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def holed_lineitem(t: Tables):
    """lineitem with computed gaps: a mostly missing column, a flag and a constant."""
    return t.lineitem.select(
        "l_orderkey",
        "l_quantity",
        F.when(F.col("l_quantity") > 30, F.col("l_discount")).alias("sparse_discount"),
        F.when(F.col("l_linenumber") != 2, F.col("l_shipdate")).alias("ship"),
        (F.col("l_returnflag") == "R").alias("returned"),
        F.when(F.col("l_tax") > 0.02, F.col("l_returnflag")).alias("flag"),
        F.lit("x").alias("constant"),
        (F.col("l_extendedprice") * F.col("l_extendedprice") * F.col("l_discount")).alias("heavy"),
    )


_HOLED = """WITH t AS (
  SELECT l_orderkey, l_quantity, CASE WHEN l_quantity > 30 THEN l_discount END AS sparse_discount,
         CASE WHEN l_linenumber <> 2 THEN l_shipdate END AS ship, l_returnflag = 'R' AS returned,
         CASE WHEN l_tax > 0.02 THEN l_returnflag END AS flag, 'x' AS constant,
         l_extendedprice * l_extendedprice * l_discount AS heavy
  FROM lineitem)"""


def _num(c, alias="t", table="t"):
    return (
        f"SELECT '{c}' AS name, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean, "
        f"round(stddev_samp({c}), 4) AS std, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, "
        f"round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75, "
        f"round(quantile_cont({c}::DOUBLE, 0.95), 4) AS p95, round(quantile_cont({c}::DOUBLE, 0.99), 4) AS p99, "
        f"round(skewness({c}), 4) AS skewness FROM {table}"
    )


_STATS = ["min", "max", "mean", "std", "p25", "p50", "p75", "p95", "skewness"]
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"


def _profile_sql(cols, time_cols, bools, source, extra_quantiles=False):
    """cols: list of (name, dtype, kind)."""
    parts = []
    for c, dtype, kind in cols:
        num, tim, flag = kind == "numeric", kind == "datetime", kind == "boolean"

        def pick(on, sql, typ):
            return sql if on else f"NULL::{typ}"

        parts.append(
            f"SELECT '{c}' AS name, '{dtype}' AS dtype, '{kind}' AS kind, count(*) - count({c}) AS missing, "
            f"round((count(*) - count({c}))::DOUBLE / count(*) * 100, 2) AS missing_pct, count(DISTINCT {c}) AS \"unique\", "
            + ", ".join(
                [
                    pick(num, f"min({c})::DOUBLE", "DOUBLE") + " AS min",
                    pick(num, f"max({c})::DOUBLE", "DOUBLE") + " AS max",
                    pick(num, f"round(avg({c}), 4)", "DOUBLE") + " AS mean",
                    pick(num, f"round(stddev_samp({c}), 4)", "DOUBLE") + " AS std",
                    *[
                        pick(num, f"round(quantile_cont({c}::DOUBLE, {q}), 4)", "DOUBLE") + f" AS {n}"
                        for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))
                    ],
                    pick(num, f"round(skewness({c}), 4)", "DOUBLE") + " AS skewness",
                    pick(tim, _ISO.format(f"min({c})"), "VARCHAR") + " AS min_time",
                    pick(tim, _ISO.format(f"max({c})"), "VARCHAR") + " AS max_time",
                    pick(tim, f"round((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000.0, 4)", "DOUBLE")
                    + " AS range_days",
                    pick(flag, f"count(*) FILTER (WHERE {c})", "BIGINT") + " AS true_count",
                    pick(flag, f"count(*) FILTER (WHERE NOT {c})", "BIGINT") + " AS false_count",
                ]
            )
            + f" FROM {source}"
        )
    return " UNION ALL ".join(parts)


LINEITEM_COLS = [
    ("l_orderkey", "bigint", "numeric"),
    ("l_partkey", "bigint", "numeric"),
    ("l_suppkey", "bigint", "numeric"),
    ("l_linenumber", "int", "numeric"),
    ("l_quantity", "double", "numeric"),
    ("l_extendedprice", "double", "numeric"),
    ("l_discount", "double", "numeric"),
    ("l_tax", "double", "numeric"),
    ("l_returnflag", "string", "categorical"),
    ("l_linestatus", "string", "categorical"),
    ("l_shipdate", "timestamp_ntz", "datetime"),
]


@query("profile_lineitem", _profile_sql(LINEITEM_COLS, (), (), "lineitem"))
def _(t):
    return _rounded(profile.profile_dataset(t.lineitem), "mean", "std", "p25", "p50", "p75", "p95", "skewness", "range_days")


@query(
    "profile_with_gaps",
    _HOLED
    + _profile_sql(
        [
            ("l_orderkey", "bigint", "numeric"),
            ("l_quantity", "double", "numeric"),
            ("sparse_discount", "double", "numeric"),
            ("ship", "timestamp_ntz", "datetime"),
            ("returned", "boolean", "boolean"),
            ("flag", "string", "categorical"),
            ("constant", "string", "categorical"),
        ],
        (),
        (),
        "t",
    ),
)
def _(t):
    out = profile.profile_dataset(holed_lineitem(t).drop("heavy"))
    return _rounded(out, "mean", "std", "p25", "p50", "p75", "p95", "skewness", "range_days")


def _numeric_sql(cols, table, probs=("p25", "p50", "p75", "p95")):
    q = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean, "
        f"round(stddev_samp({c}), 4) AS std, "
        + ", ".join(f"round(quantile_cont({c}::DOUBLE, {q[p]}), 4) AS {p}" for p in probs)
        + f", round(skewness({c}), 4) AS skewness FROM {table}"
        for c in cols
    )


@query("numeric_summary_orders", _numeric_sql(["o_orderkey", "o_custkey", "o_totalprice"], "orders"))
def _(t):
    return _rounded(profile.numeric_summary(t.orders), "mean", "std", "p25", "p50", "p75", "p95", "skewness")


def _top_sql(cols, table, top):
    return " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS name, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank,
            {c} AS value, count(*) AS count, round(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 2) AS pct
            FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= {top}"""
        for c in cols
    )


@query(
    "categorical_top_values",
    _top_sql(["o_orderstatus", "o_orderpriority"], "orders", 5),
)
def _(t):
    return profile.categorical_summary(t.orders)


@query(
    "datetime_summary_orders_lineitem",
    f"""SELECT 'o_orderdate' AS name, {_ISO.format("min(o_orderdate)")} AS min_time, {_ISO.format("max(o_orderdate)")} AS max_time,
    round((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000.0, 4) AS range_days FROM orders
    UNION ALL SELECT 'ts', {_ISO.format("min(ts)")}, {_ISO.format("max(ts)")},
    round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0, 4) FROM events""",
)
def _(t):
    return _rounded(profile.datetime_summary(t.orders).union(profile.datetime_summary(t.events)), "range_days")


@query(
    "boolean_summary_flags",
    """SELECT 'late' AS name, count(*) FILTER (WHERE l_shipdate > TIMESTAMP '1998-01-01') AS true_count,
       count(*) FILTER (WHERE NOT l_shipdate > TIMESTAMP '1998-01-01') AS false_count FROM lineitem
       UNION ALL SELECT 'taxed', count(*) FILTER (WHERE l_tax > 0.04), count(*) FILTER (WHERE NOT l_tax > 0.04) FROM lineitem""",
)
def _(t):
    return profile.boolean_summary(
        t.lineitem.select((F.col("l_shipdate") > "1998-01-01").alias("late"), (F.col("l_tax") > 0.04).alias("taxed"))
    )


@query(
    "profile_findings_gaps",
    _HOLED
    + """, n AS (SELECT count(*)::DOUBLE AS n FROM t)
    SELECT 'sparse_discount' AS "column", 'mostly_missing' AS finding,
      round((SELECT count(*) FROM t WHERE sparse_discount IS NULL) / n * 100, 2) AS value FROM n
      WHERE (SELECT count(*) FROM t WHERE sparse_discount IS NULL) / n >= 0.5
    UNION ALL SELECT 'constant', 'constant', 1.0
    UNION ALL SELECT 'heavy', 'highly_skewed', round(skewness(heavy), 4) FROM t HAVING abs(skewness(heavy)) >= 2
    """,
)
def _(t):
    return _rounded(profile.profile_findings(holed_lineitem(t)), "value")


@query(
    "profile_findings_orders",
    """SELECT c AS "column", 'identifier_like' AS finding, u::DOUBLE AS value FROM (
        SELECT 'o_orderkey' AS c, count(DISTINCT o_orderkey) AS u, count(*) AS n FROM orders
        UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), count(*) FROM orders) WHERE u = n""",
)
def _(t):
    return profile.profile_findings(t.orders)


_REPORT_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS name, '{d}' AS dtype, count(*) - count({c}) AS missing_count, "
    f"round((count(*) - count({c}))::DOUBLE / count(*) * 100, 2) AS missing_pct, count(DISTINCT {c}) AS \"unique\", "
    + (
        f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
        + ", ".join(
            f"round(quantile_cont({c}::DOUBLE, {q}), 4) AS {p}"
            for p, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99))
        )
        + f", round(skewness({c}), 4) AS skewness"
        if k == "numeric"
        else ", ".join(
            f"NULL::DOUBLE AS {x}" for x in ("mean", "std", "min", "max", "p25", "p50", "p75", "p95", "p99", "skewness")
        )
    )
    + (
        f", {_ISO.format(f'min({c})')} AS min_time, {_ISO.format(f'max({c})')} AS max_time"
        if k == "datetime"
        else ", NULL::VARCHAR AS min_time, NULL::VARCHAR AS max_time"
    )
    + " FROM lineitem"
    for c, d, k in LINEITEM_COLS
)


@query("quality_report_lineitem", _REPORT_SQL)
def _(t):
    return _rounded(profile.data_quality_report(t.lineitem), "mean", "std", "p25", "p50", "p75", "p95", "p99", "skewness")


@query(
    "quality_findings_customer",
    """SELECT c AS "column", 'high_cardinality' AS finding, u::DOUBLE AS value FROM (
        SELECT 'c_name' AS c, count(DISTINCT c_name) AS u, count(*)::DOUBLE AS n FROM customer
        UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), count(*) FROM customer) WHERE u / n >= 0.9""",
)
def _(t):
    return profile.quality_findings(t.customer)


_HOLED_COLS = ["l_orderkey", "l_quantity", "sparse_discount", "ship", "returned", "flag", "constant", "heavy"]


@query(
    "missingness_matrix_gaps",
    _HOLED
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_pct FROM t"
        for c in _HOLED_COLS
    ),
)
def _(t):
    return _rounded(profile.missingness_matrix(holed_lineitem(t)), "missing_pct", digits=6)


@query(
    "overrepresented_flag",
    _HOLED
    + """SELECT flag AS value, count(*) AS count, round(count(*)::DOUBLE / (SELECT count(*) FROM t), 6) AS proportion,
      count(*)::DOUBLE / (SELECT count(*) FROM t) >= 0.25 AS dominant FROM t GROUP BY flag ORDER BY 2 DESC LIMIT 10""",
)
def _(t):
    return _rounded(
        profile.overrepresented_categories(holed_lineitem(t), "flag", threshold=0.25), "proportion", digits=6
    )


@query(
    "skewed_features_gaps",
    _HOLED
    + " SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(skewness({c}), 4) AS skewness, CASE WHEN abs(skewness({c})) >= 2 THEN 'high' "
        f"ELSE 'moderate' END AS severity FROM t"
        for c in ("l_orderkey", "l_quantity", "sparse_discount", "heavy")
    )
    + ") WHERE abs(skewness) >= 1",
)
def _(t):
    return _rounded(profile.skewed_features(holed_lineitem(t)), "skewness")


@query(
    "zscore_outliers",
    _HOLED
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", (SELECT count(*) FROM t, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM t) "
        f"WHERE abs({c} - m) / s >= 3) AS outliers"
        for c in ("heavy", "l_quantity", "sparse_discount")
    ),
)
def _(t):
    return profile.zscore_outlier_count(holed_lineitem(t), ["heavy", "l_quantity", "sparse_discount"])


@query(
    "column_hints_orders",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, '{d}' AS dtype, round((count(*) - count({c}))::DOUBLE / count(*) * 100, 3) AS missing_pct, "
        + (f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, " if num else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, ")
        + (
            f"(SELECT string_agg(v, '|' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM orders GROUP BY {c} "
            f"ORDER BY n DESC, v LIMIT 3)) AS top_values"
            if d == "string"
            else "NULL::VARCHAR AS top_values"
        )
        + " FROM orders"
        for c, d, num in (
            ("o_orderkey", "bigint", True),
            ("o_custkey", "bigint", True),
            ("o_orderstatus", "string", False),
            ("o_totalprice", "double", True),
            ("o_orderdate", "timestamp_ntz", False),
            ("o_orderpriority", "string", False),
        )
    ),
)
def _(t):
    return profile.column_hints(t.orders)


# ---- chart data ----


@query(
    "bar_data_orders",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey, o_totalprice LIMIT 200",
)
def _(t):
    return charts.bar_data(t.orders, "o_orderkey", "o_totalprice")


@query(
    "multi_series_bar_parts",
    "SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_partkey LIMIT 200",
)
def _(t):
    return charts.multi_series_bar_data(t.part, "p_partkey", ["p_size", "p_retailprice", "absent"], ["p_partkey"])


def _hist_sql(col, table, bins):
    return f"""WITH e AS (SELECT min({col})::DOUBLE AS lo, (max({col}) - min({col}))::DOUBLE / {bins} AS w FROM {table}),
      c AS (SELECT least(floor(({col} - lo) / w), {bins - 1})::INT AS bin, count(*) AS n FROM {table}, e GROUP BY 1)
      SELECT g.bin, round(lo + g.bin * w, 4) AS bin_start, round(lo + (g.bin + 1) * w, 4) AS bin_end, coalesce(n, 0) AS count
      FROM (SELECT unnest(range({bins}))::INT AS bin) g CROSS JOIN e LEFT JOIN c ON g.bin = c.bin"""


@query("histogram_price", _hist_sql("l_extendedprice", "lineitem", 20))
def _(t):
    return _rounded(charts.histogram(t.lineitem, "l_extendedprice"), "bin_start", "bin_end")


@query("histogram_event_value", _hist_sql("value", "events", 50))
def _(t):
    return _rounded(charts.histogram(t.events, "value", bins=50), "bin_start", "bin_end")


@query(
    "line_data_events",
    "SELECT event_id, value FROM events WHERE value IS NOT NULL ORDER BY event_id, value LIMIT 2000",
)
def _(t):
    return charts.line_data(t.events, "event_id", "value")


@query(
    "scatter_price_quantity",
    """SELECT l_quantity, l_extendedprice, (SELECT round(corr(l_quantity, l_extendedprice), 6) FROM lineitem) AS correlation
       FROM lineitem ORDER BY l_quantity, l_extendedprice LIMIT 2000""",
)
def _(t):
    return _rounded(charts.scatter_data(t.lineitem, "l_quantity", "l_extendedprice"), "correlation", digits=6)


# ---- pivot ----


@query(
    "pivot_flag_by_status",
    """SELECT l_returnflag, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 0), 2) AS "F",
       round(coalesce(sum(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 0), 2) AS "O" FROM lineitem GROUP BY 1""",
)
def _(t):
    out = pivot.multidim_pivot(t.lineitem, ["l_returnflag"], "l_extendedprice", ["l_linestatus"])
    return _rounded(out, "F", "O", digits=2)


@query(
    "pivot_product_of_levels",
    """WITH b AS (SELECT p_brand, p_size, avg(p_retailprice) AS v FROM part GROUP BY ALL),
       g AS (SELECT DISTINCT a.p_brand, c.p_size FROM (SELECT DISTINCT p_brand FROM part) a, (SELECT DISTINCT p_size FROM part) c)
       SELECT g.p_brand, g.p_size, round(coalesce(v, 0), 4) AS p_retailprice FROM g LEFT JOIN b USING (p_brand, p_size)
       ORDER BY coalesce(v, 0) DESC, (v IS NOT NULL) DESC, p_brand, p_size LIMIT 2000""",
)
def _(t):
    out = pivot.multidim_pivot(t.part, ["p_brand", "p_size"], "p_retailprice", agg="mean", top_n=2000)
    return _rounded(out, "p_retailprice")


@query(
    "pivot_median_priority",
    """SELECT o_orderpriority, o_orderstatus, round(median(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY ALL
       ORDER BY 3 DESC LIMIT 12""",
)
def _(t):
    out = pivot.multidim_pivot(t.orders, ["o_orderpriority", "o_orderstatus"], "o_totalprice", agg="median", top_n=12)
    return _rounded(out, "o_totalprice")


@query(
    "pivot_null_keys_count",
    _HOLED
    + """ SELECT g.flag, g.l_quantity, coalesce(n, 0)::DOUBLE AS l_orderkey FROM
      (SELECT * FROM (SELECT DISTINCT flag FROM t) a, (SELECT DISTINCT l_quantity FROM t) b) g
      LEFT JOIN (SELECT flag, l_quantity, count(l_orderkey) AS n FROM t GROUP BY ALL) c
      ON g.flag IS NOT DISTINCT FROM c.flag AND g.l_quantity = c.l_quantity
      ORDER BY l_orderkey DESC, (n IS NOT NULL) DESC, g.flag NULLS FIRST, g.l_quantity LIMIT 50""",
)
def _(t):
    return pivot.multidim_pivot(holed_lineitem(t), ["flag", "l_quantity"], "l_orderkey", agg="count")
