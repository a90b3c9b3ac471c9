"""Relationships, trends, hypothesis tests, causal estimates, cross-table keys."""

from itertools import combinations

from pyspark.sql import functions as F

from tablewise.operators import causal, crossdata, hypothesis, relate, trend
from workload.profiling import _HOLED, _rounded, holed_lineitem
from workload.registry import query

_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs_sql(cols, table):
    return " UNION ALL ".join(
        "SELECT '{0}' AS column_a, '{1}' AS column_b, round(r, 4) AS correlation, round(abs(r), 4) AS abs_correlation, n_pairs, "
        "n_pairs < n * 0.5 AS low_overlap FROM (SELECT corr({0}, {1}) AS r, "
        "count(*) FILTER (WHERE {0} IS NOT NULL AND {1} IS NOT NULL) AS n_pairs, count(*) AS n FROM {2})".format(
            *sorted(p), table
        )
        for p in combinations(cols, 2)
    )


@query("correlation_pairs_lineitem", _pairs_sql(_LI_NUM, "lineitem"))
def _(t):
    return relate.correlation_pairs(t.lineitem, top_n=100)


@query(
    "correlation_pairs_gaps",
    _HOLED + _pairs_sql(["l_orderkey", "l_quantity", "sparse_discount", "heavy"], "t"),
)
def _(t):
    return relate.correlation_pairs(holed_lineitem(t), top_n=100)


def _eta(cat, num, table):
    return f"""SELECT '{cat}' AS categorical_col, '{num}' AS numeric_col, round(sqrt(b / (b + w)), 4) AS correlation_ratio FROM (
      SELECT sum(n * (m - g) * (m - g)) AS b, sum(v) AS w FROM (
        SELECT count({num}) AS n, avg({num}) AS m, var_pop({num}) * count({num}) AS v FROM {table} WHERE {cat} IS NOT NULL GROUP BY {cat}),
        (SELECT avg({num}) AS g FROM {table} WHERE {cat} IS NOT NULL))"""


@query(
    "categorical_associations_lineitem",
    " UNION ALL ".join(_eta(c, n, "lineitem") for c in ("l_returnflag", "l_linestatus") for n in _LI_NUM),
)
def _(t):
    return relate.categorical_associations(t.lineitem)


_LINKED = """WITH t AS (SELECT l_quantity, l_extendedprice, l_quantity * 3 - l_linenumber * 0.1 AS derived, l_returnflag AS flag,
   CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS size_class FROM lineitem)"""


def _linked(t):
    return t.lineitem.select(
        "l_quantity",
        "l_extendedprice",
        (F.col("l_quantity") * 3 - F.col("l_linenumber") * 0.1).alias("derived"),
        F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_quantity") > 25, "large").otherwise("small").alias("size_class"),
    )


@query(
    "relationship_findings_derived",
    _LINKED
    + " SELECT CASE WHEN correlation > 0 THEN 'positive_correlation' ELSE 'negative_correlation' END AS finding, column_a, column_b, "
    "correlation AS strength FROM ("
    + _pairs_sql(["l_quantity", "l_extendedprice", "derived"], "t")
    + ") WHERE abs_correlation >= 0.7 AND NOT low_overlap UNION ALL SELECT 'association', categorical_col, numeric_col, "
    "correlation_ratio FROM ("
    + " UNION ALL ".join(
        _eta(c, n, "t") for c in ("flag", "size_class") for n in ("l_quantity", "l_extendedprice", "derived")
    )
    + ") WHERE correlation_ratio >= 0.5",
)
def _(t):
    return relate.relationship_findings(_linked(t))


@query(
    "group_means_priority",
    "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1",
)
def _(t):
    return _rounded(relate.group_means(t.orders, "o_orderpriority", "o_totalprice"), "o_totalprice")


# ---- trends ----


@query(
    "trend_periods_month_sum",
    """WITH p AS (SELECT last_day(o_orderdate) AS period, sum(o_totalprice) AS value FROM orders GROUP BY 1),
       c AS (SELECT last_day(d) AS period FROM (SELECT unnest(generate_series(date_trunc('month', min(period)),
         date_trunc('month', max(period)), INTERVAL 1 MONTH)) AS d FROM p))
       SELECT period::VARCHAR AS period, round(coalesce(value, 0), 2) AS value,
       round((value / lag(value) OVER (ORDER BY period) - 1) * 100, 4) AS pct_change FROM c LEFT JOIN p USING (period)""",
)
def _(t):
    out = trend.pct_change(trend.trend_periods(t.orders, "o_orderdate", "o_totalprice"))
    return _rounded(_rounded(out, "value", digits=2), "pct_change").withColumn("period", F.col("period").cast("string"))


@query(
    "trend_periods_week_median",
    """SELECT CAST(date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS DATE)::VARCHAR AS period, round(median(o_totalprice), 4) AS value
       FROM orders GROUP BY 1""",
)
def _(t):
    out = trend.trend_periods(t.orders, "o_orderdate", "o_totalprice", "W", "median")
    return _rounded(out, "value").withColumn("period", F.col("period").cast("string"))


@query(
    "trend_periods_quarter_mean",
    """SELECT CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)::VARCHAR AS period,
       round(avg(l_discount), 6) AS value FROM lineitem GROUP BY 1""",
)
def _(t):
    out = trend.trend_periods(t.lineitem, "l_shipdate", "l_discount", "Q", "mean")
    return _rounded(out, "value", digits=6).withColumn("period", F.col("period").cast("string"))


@query(
    "trend_periods_day_gaps",
    """WITH e AS (SELECT user_id, ts::DATE AS period, count(value) AS n FROM events WHERE event_type = 'error' AND value IS NOT NULL GROUP BY ALL),
       c AS (SELECT user_id, unnest(generate_series(min(period), max(period), INTERVAL 1 DAY))::DATE AS period FROM e GROUP BY user_id)
       SELECT user_id, period::VARCHAR AS period, coalesce(n, 0)::DOUBLE AS value FROM c LEFT JOIN e USING (user_id, period)""",
)
def _(t):
    out = trend.trend_periods(t.events.where("event_type = 'error'"), "ts", "value", "D", "count", ["user_id"])
    return out.withColumn("period", F.col("period").cast("string"))


def _trend_sql(period, table, date_col, value_col, freq, agg, agg_sql):
    return f"""WITH p AS (SELECT {period} AS period, {agg_sql} AS value FROM {table} GROUP BY 1),
      s AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS x, (value / lag(value) OVER (ORDER BY period) - 1) * 100 AS ch FROM p),
      f AS (SELECT count(*) AS n, regr_slope(value, x) AS sl, regr_intercept(value, x) AS ic FROM s)
      SELECT '{date_col}' AS date_col, '{value_col}' AS value_col, '{freq}' AS freq, '{agg}' AS agg, n AS n_periods,
        CASE WHEN sl > 0 THEN 'upward' WHEN sl < 0 THEN 'downward' ELSE 'flat' END AS direction,
        round(sl * (n - 1) / abs(ic) * 100, 2) AS overall_change_pct,
        (SELECT round(value, 2) FROM s ORDER BY period DESC LIMIT 1) AS latest_value,
        (SELECT round(ch, 2) FROM s ORDER BY period DESC LIMIT 1) AS latest_change_pct,
        (SELECT period::VARCHAR FROM s ORDER BY value DESC, period LIMIT 1) AS peak_period,
        (SELECT round(max(value), 2) FROM s) AS peak_value,
        (SELECT period::VARCHAR FROM s ORDER BY value, period LIMIT 1) AS trough_period,
        (SELECT round(min(value), 2) FROM s) AS trough_value FROM f"""


@query(
    "trend_summary_orders",
    _trend_sql("last_day(o_orderdate)", "orders", "o_orderdate", "o_totalprice", "M", "sum", "sum(o_totalprice)"),
)
def _(t):
    out = trend.trend_summary(t.orders, value_col="o_totalprice")
    return _rounded(out, "latest_value", "peak_value", "trough_value", digits=2)


@query(
    "trend_summary_events",
    _trend_sql("ts::DATE", "events", "ts", "value", "D", "mean", "avg(value)"),
)
def _(t):
    out = trend.trend_summary(t.events, value_col="value", agg="mean")
    return _rounded(out, "latest_value", "peak_value", "trough_value", digits=2)


# ---- hypothesis tests ----

_SIDES = "(SELECT count(*) AS n, avg({x}) AS m, var_samp({x}) AS v FROM {t} WHERE {c})"


@query(
    "two_sample_t_price_by_status",
    f"""SELECT 'l_extendedprice[F]' AS group_a, 'l_extendedprice[O]' AS group_b, a.n AS n_a, b.n AS n_b, round(a.m, 4) AS mean_a,
       round(b.m, 4) AS mean_b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 4) AS t_statistic,
       round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 4) AS cohens_d
       FROM {_SIDES.format(x="l_extendedprice", t="lineitem", c="l_linestatus = 'F'")} a,
            {_SIDES.format(x="l_extendedprice", t="lineitem", c="l_linestatus = 'O'")} b""",
)
def _(t):
    out = hypothesis.two_sample_t(t.lineitem, "l_extendedprice", "l_linestatus")
    return out.drop("p_value", "significant", "ci_lower", "ci_upper")


@query(
    "two_sample_t_two_columns",
    """SELECT 'l_discount' AS group_a, 'l_tax' AS group_b, count(l_discount) AS n_a, count(l_tax) AS n_b,
       round(avg(l_discount), 4) AS mean_a, round(avg(l_tax), 4) AS mean_b,
       round((avg(l_discount) - avg(l_tax)) / sqrt(var_samp(l_discount) / count(*) + var_samp(l_tax) / count(*)), 4) AS t_statistic,
       round((avg(l_discount) - avg(l_tax)) / sqrt((var_samp(l_discount) + var_samp(l_tax)) / 2), 4) AS cohens_d FROM lineitem""",
)
def _(t):
    out = hypothesis.two_sample_t(t.lineitem, "l_discount", col_b="l_tax")
    return out.drop("p_value", "significant", "ci_lower", "ci_upper")


@query(
    "one_sample_t_quantity",
    """SELECT 'l_quantity' AS col, round(avg(l_quantity), 4) AS sample_mean, 25.0::DOUBLE AS population_mean, count(*) AS n,
       round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 4) AS t_statistic,
       round((avg(l_quantity) - 25) / stddev_samp(l_quantity), 4) AS cohens_d FROM lineitem""",
)
def _(t):
    return hypothesis.one_sample_t(t.lineitem, "l_quantity", popmean=25.0).drop("p_value", "significant")


@query(
    "paired_t_discount_tax",
    """SELECT 'l_discount' AS col_a, 'l_tax' AS col_b, count(*) AS n_pairs, round(avg(l_discount - l_tax), 4) AS mean_diff,
       round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 4) AS t_statistic,
       round(avg(l_discount - l_tax) / stddev_samp(l_discount - l_tax), 4) AS cohens_d FROM lineitem""",
)
def _(t):
    return hypothesis.paired_t(t.lineitem, "l_discount", "l_tax").drop("p_value", "significant")


@query(
    "mannwhitney_price_by_flag",
    """WITH r AS (SELECT l_returnflag AS g, l_extendedprice AS x, rank() OVER (ORDER BY l_extendedprice) +
         (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS rk FROM lineitem WHERE l_returnflag IN ('A', 'N'))
       SELECT 'l_extendedprice[A]' AS group_a, 'l_extendedprice[N]' AS group_b, na AS n_a, nb AS n_b, round(ma, 4) AS median_a,
       round(mb, 4) AS median_b, round(u, 2) AS u_statistic, round(1 - 2 * u / (na::DOUBLE * nb), 4) AS rank_biserial_r
       FROM (SELECT count(*) FILTER (WHERE g = 'A') AS na, count(*) FILTER (WHERE g = 'N') AS nb,
         quantile_cont(x, 0.5) FILTER (WHERE g = 'A') AS ma, quantile_cont(x, 0.5) FILTER (WHERE g = 'N') AS mb,
         (sum(rk) FILTER (WHERE g = 'A') - count(*) FILTER (WHERE g = 'A') * (count(*) FILTER (WHERE g = 'A') + 1) / 2.0)::DOUBLE AS u FROM r)""",
)
def _(t):
    out = hypothesis.mannwhitney(t.lineitem, "l_extendedprice", "l_returnflag", "A", "N")
    return out.drop("p_value", "significant")


_CHI = """WITH c AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {t} GROUP BY ALL),
  r AS (SELECT a, sum(n) AS ra FROM c GROUP BY a), k AS (SELECT b, sum(n) AS cb FROM c GROUP BY b),
  e AS (SELECT r.a, k.b, coalesce(n, 0) AS n, ra * cb / (SELECT sum(n) FROM c) AS ex FROM r CROSS JOIN k LEFT JOIN c ON c.a = r.a AND c.b = k.b),
  s AS (SELECT sum(pow({gap}, 2) / ex) AS chi, sum(n) AS n, count(DISTINCT a) AS nr, count(DISTINCT b) AS nc FROM e)
  SELECT '{a}' AS col_a, '{b}' AS col_b, n::BIGINT AS n, nr AS n_rows, nc AS n_cols, round(chi, 4) AS chi2_statistic,
  (nr - 1) * (nc - 1) AS dof, round(sqrt(chi / (n * (least(nr, nc) - 1))), 4) AS cramers_v FROM s"""


@query("chi_squared_flag_status", _CHI.format(a="l_returnflag", b="l_linestatus", t="lineitem", gap="n - ex"))
def _(t):
    return hypothesis.chi_squared(t.lineitem, "l_returnflag", "l_linestatus").drop(
        "p_value", "significant", "association_strength"
    )


@query(
    "chi_squared_two_by_two",
    _CHI.format(a="quality", b="toxic", t="labels", gap="abs(n - ex) - least(0.5, abs(n - ex))"),
)
def _(t):
    return hypothesis.chi_squared(t.labels, "quality", "toxic").drop("p_value", "significant", "association_strength")


@query(
    "chi_squared_sparse_table",
    _CHI.format(a="p_brand", b="p_size", t="part", gap="n - ex"),
)
def _(t):
    return hypothesis.chi_squared(t.part, "p_brand", "p_size").drop("p_value", "significant", "association_strength")


@query(
    "anova_price_by_priority",
    """WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) * count(*) AS w FROM orders GROUP BY 1),
       s AS (SELECT count(*) AS k, sum(n) AS n, sum(w) AS w, sum(n * pow(m - (SELECT avg(o_totalprice) FROM orders), 2)) AS b FROM g)
       SELECT 'o_totalprice' AS col, 'o_orderpriority' AS group_col, k AS n_groups, n::BIGINT AS n,
       round((b / (k - 1)) / (w / (n - k)), 4) AS f_statistic, round(b / (b + w), 4) AS eta_squared FROM s""",
)
def _(t):
    return hypothesis.anova(t.orders, "o_totalprice", "o_orderpriority").drop("p_value", "significant", "effect_magnitude")


@query(
    "anova_group_means",
    """SELECT c_mktsegment AS "group", count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1 HAVING count(*) >= 2""",
)
def _(t):
    return hypothesis.anova_group_means(t.customer, "c_acctbal", "c_mktsegment")


@query(
    "correlation_test_spearman",
    """WITH r AS (SELECT l_quantity AS a, l_extendedprice AS b,
         rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS ra,
         rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS rb FROM lineitem)
       SELECT 'l_quantity' AS col_a, 'l_extendedprice' AS col_b, count(*) AS n, round(corr(a, b), 4) AS pearson_r,
       round(corr(ra, rb), 4) AS spearman_r FROM r""",
)
def _(t):
    return hypothesis.correlation_test(t.lineitem, "l_quantity", "l_extendedprice").select(
        "col_a", "col_b", "n", "pearson_r", "spearman_r"
    )


@query("power_analysis_price")
def _(t):
    return hypothesis.power_analysis(t.lineitem, col_a="l_extendedprice", group_col="l_linestatus")


# ---- causal ----


@query(
    "causal_effect_dose",
    """WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem),
       f AS (SELECT regr_slope(y, x) AS b, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, count(*) AS n,
             stddev_samp(x) AS sx, stddev_pop(y) AS sy, regr_r2(y, x) AS r2 FROM d),
       e AS (SELECT sqrt(sum(pow((y - my - b * (x - mx)) / (1 - least(1.0 / n + pow(x - mx, 2) / sxx, 0.9999)), 2) * pow(x - mx, 2))) / any_value(sxx) AS se FROM d, f)
       SELECT 'l_quantity' AS treatment_col, 'l_extendedprice' AS outcome_col, n AS n_observations, round(b, 4) AS ate, round(se, 4) AS std_error_hc3,
       round(b - 1.96 * se, 3) AS ci_lower_95, round(b + 1.96 * se, 3) AS ci_upper_95, round(b / se, 4) AS t_statistic,
       round(b * sx / sy, 4) AS effect_size, round(r2, 4) AS r_squared,
       round(exp(0.91 * abs(b * sx / sy)) + sqrt(exp(0.91 * abs(b * sx / sy)) * (exp(0.91 * abs(b * sx / sy)) - 1)), 3) AS e_value,
       round(mx, 4) AS treatment_mean, round(my, 4) AS outcome_mean FROM f, e""",
)
def _(t):
    out = causal.estimate_causal_effect(t.lineitem, "l_quantity", "l_extendedprice")
    out = _rounded(_rounded(out, "ci_lower_95", "ci_upper_95", digits=3), "ate", "std_error_hc3")
    return out.select(
        "treatment_col", "outcome_col", "n_observations", "ate", "std_error_hc3", "ci_lower_95", "ci_upper_95", "t_statistic",
        "effect_size", "r_squared", "e_value", "treatment_mean", "outcome_mean",
    )


@query(
    "causal_effect_with_control",
    """WITH d AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS t, l_quantity AS c, l_extendedprice AS y FROM lineitem),
       m AS (SELECT count(*) AS n, covar_pop(t, y) AS ty, covar_pop(c, y) AS cy, covar_pop(t, c) AS tc, var_pop(t) AS tt, var_pop(c) AS cc,
             var_pop(y) AS yy, avg(t) AS mt, avg(y) AS my FROM d),
       b AS (SELECT *, (ty * cc - cy * tc) / (tt * cc - tc * tc) AS bt, (cy * tt - ty * tc) / (tt * cc - tc * tc) AS bc FROM m)
       SELECT 'treated' AS treatment_col, n AS n_observations, true AS treatment_is_binary, round(bt, 4) AS ate,
         round(1 - (yy - bt * ty - bc * cy) / yy, 4) AS r_squared, round(mt, 4) AS treatment_mean, round(my, 4) AS outcome_mean FROM b""",
)
def _(t):
    rows = t.lineitem.withColumn("treated", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))
    out = causal.estimate_causal_effect(rows, "treated", "l_extendedprice", ["l_quantity"])
    return _rounded(out, "ate").select(
        "treatment_col", "n_observations", "treatment_is_binary", "ate", "r_squared", "treatment_mean", "outcome_mean"
    )


@query(
    "mediation_quantity_price",
    """WITH d AS (SELECT l_linenumber::DOUBLE AS t, l_quantity AS m, l_extendedprice AS y FROM lineitem),
       s AS (SELECT covar_pop(t, y) AS ty, covar_pop(m, y) AS my, covar_pop(t, m) AS tm, var_pop(t) AS tt, var_pop(m) AS mm FROM d),
       p AS (SELECT tm / tt AS a, (my * tt - ty * tm) / (tt * mm - tm * tm) AS b, (ty * mm - my * tm) / (tt * mm - tm * tm) AS dr FROM s)
       SELECT 'l_quantity' AS mediator, round(a, 4) AS path_a, round(b, 4) AS path_b, round(a * b, 4) AS indirect_effect,
       round(dr, 4) AS direct_effect, round(dr + a * b, 4) AS total_effect, round(abs(a * b / (dr + a * b) * 100), 1) AS mediation_pct FROM p""",
)
def _(t):
    return causal.mediation(t.lineitem, "l_linenumber", "l_extendedprice", "l_quantity")


# ---- across tables ----


@query(
    "name_similarity_columns",
    """WITH a AS (SELECT unnest(['customer_id', 'order_date', 'ship_date', 'region name']) AS na),
       n AS (SELECT DISTINCT n_name AS nn FROM nation), x AS (SELECT lower(na || ' ' || nn) AS name_a, na, nn FROM a, n)
       SELECT name_a, name_b, similarity FROM (
         SELECT x.name_a, y.na AS name_b, round(len(list_intersect(regexp_extract_all(x.name_a, '[a-z0-9]+'), regexp_extract_all(y.na, '[a-z0-9]+')))::DOUBLE /
         len(list_distinct(list_concat(regexp_extract_all(x.name_a, '[a-z0-9]+'), regexp_extract_all(y.na, '[a-z0-9]+')))), 6) AS similarity
         FROM x, a y) WHERE similarity > 0""",
)
def _(t):
    base = t.nation.select(F.col("n_name").alias("nn")).distinct()
    names = ["customer_id", "order_date", "ship_date", "region name"]
    left = base.select(
        F.explode(F.transform(F.array(*[F.lit(x) for x in names]), lambda v: F.lower(F.concat_ws(" ", v, F.col("nn"))))).alias("name")
    )
    right = t.spark.createDataFrame([(x,) for x in names], "name string")
    return _rounded(crossdata.name_similarities(left, right), "similarity", digits=6)


@query(
    "join_key_candidates_orders_lineitem",
    """WITH o AS (SELECT 'order_key' AS n, o_orderkey::VARCHAR AS v FROM orders GROUP BY ALL), l AS (SELECT l_orderkey::VARCHAR AS v FROM lineitem GROUP BY ALL)
       SELECT 'order_key' AS col_a, 'order_key' AS col_b, 1.0::DOUBLE AS name_similarity, true AS exact_name_match,
         round((SELECT count(*) FROM o JOIN l USING (v))::DOUBLE / least((SELECT count(*) FROM o), (SELECT count(*) FROM l)), 3) AS value_overlap, true AS recommended
       UNION ALL
       SELECT 'cust_key', 'cust_part_key', round(2 / 3.0, 3), false,
         round((SELECT count(*) FROM (SELECT o_custkey::VARCHAR AS v FROM orders INTERSECT SELECT l_partkey::VARCHAR FROM lineitem))::DOUBLE
           / least((SELECT count(DISTINCT o_custkey) FROM orders), (SELECT count(DISTINCT l_partkey) FROM lineitem)), 3), true""",
)
def _(t):
    a = t.orders.select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("cust_key"), "o_orderstatus")
    b = t.lineitem.select(F.col("l_orderkey").alias("order_key"), F.col("l_partkey").alias("cust_part_key"), "l_tax")
    return crossdata.join_key_candidates(a, b)


@query(
    "cross_correlations_orders",
    """WITH a AS (SELECT o_custkey AS k, o_totalprice AS x, o_totalprice * 2 + o_orderkey * 0.001 AS y FROM orders),
       b AS (SELECT o_custkey AS k, sum(o_totalprice) AS total, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1),
       j AS (SELECT a.x, a.y, b.total, b.n, b.top FROM a JOIN b USING (k)),
       p AS (SELECT 'x' AS col_a, 'total' AS col_b, corr(x, total) AS r, count(*) AS m FROM j UNION ALL
             SELECT 'x', 'n', corr(x, n), count(*) FROM j UNION ALL SELECT 'x', 'top', corr(x, top), count(*) FROM j UNION ALL
             SELECT 'y', 'total', corr(y, total), count(*) FROM j UNION ALL SELECT 'y', 'n', corr(y, n), count(*) FROM j UNION ALL
             SELECT 'y', 'top', corr(y, top), count(*) FROM j UNION ALL
             SELECT 'ck', 'ck2', corr(j2.k, j2.k * 3 + j2.x * 0), count(*) FROM (SELECT a.k, a.x FROM a JOIN b USING (k)) j2)
       SELECT col_a, col_b, round(r, 4) AS pearson_r, round(abs(r), 4) AS abs_r, m AS n_matched FROM p WHERE abs(r) >= 0.7""",
)
def _(t):
    a = t.orders.select(
        F.col("o_custkey").alias("k"),
        F.col("o_totalprice").alias("x"),
        (F.col("o_totalprice") * 2 + F.col("o_orderkey") * 0.001).alias("y"),
        F.col("o_custkey").alias("ck"),
    )
    b = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(
        F.sum("o_totalprice").alias("total"), F.count("*").alias("n"), F.max("o_totalprice").alias("top"),
        (F.max("o_custkey") * 3).alias("ck2"),
    )
    return crossdata.cross_correlations(a, b, "k", "k")


@query(
    "potential_keys_orders",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c})::DOUBLE / count({c}) > 0.5 AND count(DISTINCT {c}) > 5 AS is_key FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ),
)
def _(t):
    return crossdata.is_potential_key(t.orders)


@query("cross_dataset_profile_orders")
def _(t):
    orders = t.orders.select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("cust_key"), "o_totalprice")
    lines = t.lineitem.select(F.col("l_orderkey").alias("order_key"), "l_quantity", "l_extendedprice")
    customers = t.customer.select(F.col("c_custkey").alias("cust_key"), "c_acctbal")
    return crossdata.cross_dataset_profile(orders, {"lineitem": lines, "customer": customers})
