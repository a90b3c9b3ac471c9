"""Prediction evaluation, drift, features: prediction tables are expressions over the given tables."""

from pyspark.sql import functions as F

from tablewise.operators import drift, evaluate, features, scoring
from workload.profiling import _HOLED, _rounded, _hist_sql, holed_lineitem
from workload.registry import query

# A scored table: actual = returned?, score = a deterministic function of the row.
_SCORED = """WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS actual,
  (((l_orderkey * 37 + l_linenumber * 11) % 1000) + CASE WHEN l_returnflag = 'R' THEN 300 ELSE 0 END) / 1300.0::DOUBLE AS probability,
  CASE WHEN (((l_orderkey * 37 + l_linenumber * 11) % 1000) + CASE WHEN l_returnflag = 'R' THEN 300 ELSE 0 END) / 1300.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS prediction,
  l_linestatus AS segment, CASE WHEN l_linenumber <> 3 THEN l_returnflag END AS flag FROM lineitem)"""


def scored(t):
    score = (F.pmod(F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11, F.lit(1000)) + F.when(F.col("l_returnflag") == "R", 300).otherwise(0)) / F.lit(1300.0)
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_returnflag") == "R").cast("int").alias("actual"),
        score.alias("probability"),
        (score >= 0.5).cast("int").alias("prediction"),
        F.col("l_linestatus").alias("segment"),
        F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("flag"),
    )


# Three classes: actual and predicted order status.
_MULTI = """WITH t AS (SELECT o_orderkey, o_orderstatus AS actual, CASE WHEN o_orderkey % 5 < 3 THEN o_orderstatus WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'O' END AS predicted,
  ((o_orderkey * 7) % 100 + CASE WHEN o_orderstatus = 'F' THEN 40 ELSE 0 END) / 200.0::DOUBLE AS p_f,
  ((o_orderkey * 13) % 100 + CASE WHEN o_orderstatus = 'O' THEN 40 ELSE 0 END) / 200.0::DOUBLE AS p_o,
  ((o_orderkey * 29) % 100 + CASE WHEN o_orderstatus = 'P' THEN 40 ELSE 0 END) / 200.0::DOUBLE AS p_p FROM orders)"""


def multi(t):
    def p(k, s):
        return ((F.pmod(F.col("o_orderkey") * k, F.lit(100)) + F.when(F.col("o_orderstatus") == s, 40).otherwise(0)) / F.lit(200.0))

    return t.orders.select(
        "o_orderkey",
        F.col("o_orderstatus").alias("actual"),
        F.when(F.pmod("o_orderkey", F.lit(5)) < 3, F.col("o_orderstatus"))
        .when(F.pmod("o_orderkey", F.lit(2)) == 0, "F")
        .otherwise("O")
        .alias("predicted"),
        p(7, "F").alias("p_f"),
        p(13, "O").alias("p_o"),
        p(29, "P").alias("p_p"),
    )


# A forecast table: predicted price from quantity.
_FORECAST = """WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS row_key, l_extendedprice AS actual, l_quantity * 1500.0 AS prediction, l_returnflag AS segment FROM lineitem)"""


def forecast(t):
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_key"),
        F.col("l_extendedprice").alias("actual"),
        (F.col("l_quantity") * 1500.0).alias("prediction"),
        F.col("l_returnflag").alias("segment"),
    )


_MULTI_CELLS = _MULTI + ", c AS (SELECT actual, predicted AS prediction, count(*) AS n FROM t GROUP BY ALL), k AS (SELECT actual AS label FROM c UNION SELECT prediction FROM c)"
_MULTI_LABELS = (
    _MULTI_CELLS
    + """, r AS (SELECT label, coalesce(sum(n) FILTER (WHERE actual = label AND prediction = label), 0) AS tp,
      coalesce(sum(n) FILTER (WHERE actual = label), 0) AS sup, coalesce(sum(n) FILTER (WHERE prediction = label), 0) AS pre FROM k, c GROUP BY label),
      m AS (SELECT label, tp, sup, CASE WHEN pre > 0 THEN tp / pre ELSE 0 END AS p, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS rc,
      CASE WHEN sup + pre > 0 THEN 2 * tp / (sup + pre) ELSE 0 END AS f FROM r)"""
)


@query(
    "confusion_matrix_status",
    _MULTI_CELLS
    + """ SELECT a.label AS actual, b.label AS prediction, coalesce(n, 0) AS n FROM k a CROSS JOIN k b
    LEFT JOIN c ON c.actual = a.label AND c.prediction = b.label""",
)
def _(t):
    return evaluate.confusion_matrix(multi(t), "actual", "predicted")


@query(
    "classification_report_status",
    _MULTI_LABELS + " SELECT label, sup::BIGINT AS support, round(p, 6) AS precision, round(rc, 6) AS recall, round(f, 6) AS f1 FROM m",
)
def _(t):
    return _rounded(evaluate.classification_report(multi(t), "actual", "predicted"), "precision", "recall", "f1", digits=6)


@query(
    "classification_metrics_status",
    _MULTI_LABELS
    + """ SELECT sum(sup)::BIGINT AS n_rows_evaluated, count(*) AS n_classes, round(sum(tp) / sum(sup), 6) AS accuracy,
    round(avg(rc) FILTER (WHERE sup > 0), 6) AS balanced_accuracy, round(avg(p), 6) AS precision_macro, round(avg(rc), 6) AS recall_macro,
    round(avg(f), 6) AS f1_macro, round(sum(p * sup) / sum(sup), 6) AS precision_weighted, round(sum(rc * sup) / sum(sup), 6) AS recall_weighted,
    round(sum(f * sup) / sum(sup), 6) AS f1_weighted FROM m""",
)
def _(t):
    out = evaluate.classification_metrics(multi(t), "actual", "predicted")
    return _rounded(out, *[c for c in out.columns if c not in ("n_rows_evaluated", "n_classes")], digits=6)


@query(
    "probability_summary_scored",
    _SCORED
    + """ SELECT 'probability' AS "column", round(avg(probability), 6) AS mean, round(quantile_cont(probability, 0.5), 6) AS p50,
    round(quantile_cont(probability, 0.9), 6) AS p90, round(quantile_cont(probability, 0.95), 6) AS p95, round(quantile_cont(probability, 0.99), 6) AS p99 FROM t""",
)
def _(t):
    return _rounded(evaluate.probability_summary(scored(t), "probability"), "mean", "p50", "p90", "p95", "p99", digits=6)


_CURVE = _SCORED + """, g AS (SELECT probability AS s, sum(actual) AS tp, count(*) - sum(actual) AS fp FROM t GROUP BY 1),
  w AS (SELECT s, tp, fp, sum(tp) OVER (ORDER BY s DESC) AS ctp, sum(fp) OVER (ORDER BY s DESC) AS cfp, row_number() OVER (ORDER BY s DESC) AS point FROM g),
  z AS (SELECT sum(tp)::DOUBLE AS p, sum(fp)::DOUBLE AS n, count(*) AS k FROM g)"""


@query(
    "roc_auc_scored",
    _CURVE
    + " SELECT round(sum(fp * (ctp - tp + tp / 2.0)) / any_value(p) / any_value(n), 6) AS roc_auc, any_value(p)::BIGINT AS positives, any_value(n)::BIGINT AS negatives FROM w, z",
)
def _(t):
    return _rounded(evaluate.roc_auc(scored(t), "actual", "probability"), "roc_auc", digits=6)


_PICK = "point IN (SELECT (j * k) // 79 FROM (SELECT unnest(range(80)) AS j), z)"


@query(
    "roc_curve_scored",
    _CURVE
    + f""" SELECT 0::BIGINT AS point, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL
    SELECT point, round(cfp / n, 6), round(ctp / p, 6) FROM w, z WHERE {_PICK}""",
)
def _(t):
    return _rounded(evaluate.roc_curve(scored(t), "actual", "probability"), "fpr", "tpr", digits=6)


@query(
    "average_precision_scored",
    _CURVE + " SELECT round(sum(tp * ctp / (ctp + cfp)) / any_value(p), 6) AS average_precision FROM w, z",
)
def _(t):
    return _rounded(evaluate.average_precision(scored(t), "actual", "probability"), "average_precision", digits=6)


@query(
    "pr_curve_scored",
    _CURVE
    + f""" SELECT 0::BIGINT AS point, 0.0::DOUBLE AS recall, 1.0::DOUBLE AS precision UNION ALL
    SELECT point, round(ctp / p, 6), round(ctp / (ctp + cfp), 6) FROM w, z WHERE {_PICK}""",
)
def _(t):
    return _rounded(evaluate.pr_curve(scored(t), "actual", "probability"), "recall", "precision", digits=6)


@query(
    "calibration_curve_scored",
    _SCORED
    + """, e AS (SELECT quantile_cont(probability, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM t),
    b AS (SELECT len(list_filter(q, lambda x: x < probability))::INT AS bin, probability, actual FROM t, e)
    SELECT bin, round(avg(probability), 6) AS mean_predicted, round(avg(actual), 6) AS fraction_positive, count(*) AS n FROM b GROUP BY bin""",
)
def _(t):
    return _rounded(evaluate.calibration_curve(scored(t), "actual", "probability"), "mean_predicted", "fraction_positive", digits=6)


def _ovr(cls, col):
    return f"""SELECT '{cls}' AS "class", sum(fp * (ctp - tp + tp / 2.0)) / sum(tp) / sum(fp) AS a FROM (
      SELECT *, sum(tp) OVER (ORDER BY s DESC) AS ctp FROM (SELECT {col} AS s, count(*) FILTER (WHERE actual = '{cls}') AS tp,
      count(*) FILTER (WHERE actual <> '{cls}') AS fp FROM t GROUP BY 1))"""


@query(
    "ovr_roc_status",
    _MULTI
    + f""", a AS ({_ovr("F", "p_f")} UNION ALL {_ovr("O", "p_o")} UNION ALL {_ovr("P", "p_p")})
    SELECT "class", round(a, 6) AS roc_auc FROM a UNION ALL SELECT '__macro__', round(avg(a), 6) FROM a""",
)
def _(t):
    return _rounded(evaluate.ovr_roc(multi(t), "actual", {"F": "p_f", "O": "p_o", "P": "p_p"}), "roc_auc", digits=6)


@query(
    "error_slices_scored",
    _SCORED
    + " UNION ALL ".join(
        f""" SELECT * FROM (SELECT '{c}' AS slice_column, {c} AS slice_value, count(*) AS n, round(avg((actual = prediction)::INT), 6) AS accuracy,
        round(1 - avg((actual = prediction)::INT), 6) AS error_rate FROM t GROUP BY {c})"""
        for c in ("segment", "flag")
    ),
)
def _(t):
    return _rounded(evaluate.error_slices(scored(t), "actual", "prediction"), "accuracy", "error_rate", digits=6)


@query(
    "regression_metrics_forecast",
    _FORECAST
    + """ SELECT count(*) AS n_rows_evaluated, round(avg(abs(prediction - actual)), 4) AS mae, round(sqrt(avg(pow(prediction - actual, 2))), 4) AS rmse,
    round(avg(abs(prediction - actual) / abs(actual)), 6) AS mape, round(sum(abs(prediction - actual)) / sum(abs(actual)), 6) AS wmape,
    round(sum(prediction - actual) / sum(abs(actual)), 6) AS wbias, round(1 - sum(pow(prediction - actual, 2)) / (var_pop(actual) * count(*)), 6) AS r2,
    round(sum(actual), 1) AS actual_sum, round(sum(prediction), 1) AS prediction_sum, round(avg(prediction - actual), 4) AS mean_error,
    round(quantile_cont(abs(prediction - actual), 0.5), 4) AS median_absolute_error, round(quantile_cont(abs(prediction - actual), 0.9), 4) AS p90_absolute_error,
    round(quantile_cont(abs(prediction - actual), 0.95), 4) AS p95_absolute_error FROM t""",
)
def _(t):
    out = evaluate.regression_metrics(forecast(t), "actual", "prediction")
    out = _rounded(out, "mae", "rmse", "mean_error", "median_absolute_error", "p90_absolute_error", "p95_absolute_error")
    return _rounded(_rounded(out, "mape", "wmape", "wbias", "r2", digits=6), "actual_sum", "prediction_sum", digits=1)


@query(
    "actual_vs_predicted_points",
    _FORECAST
    + """, o AS (SELECT row_number() OVER (ORDER BY row_key, actual, prediction) - 1 AS point, row_key AS key, actual, prediction FROM t), z AS (SELECT count(*) - 1 AS k FROM t)
    SELECT * FROM o WHERE point IN (SELECT (j * k) // 199 FROM (SELECT unnest(range(200)) AS j), z)""",
)
def _(t):
    return evaluate.actual_vs_predicted(forecast(t), "actual", "prediction", "row_key")


@query("residual_histogram_forecast", _hist_sql("residual", "(SELECT l_quantity * 1500.0 - l_extendedprice AS residual FROM lineitem)", 25))
def _(t):
    return _rounded(evaluate.residual_histogram(forecast(t), "actual", "prediction"), "bin_start", "bin_end")


@query(
    "precomputed_metric_summary_parts",
    """WITH t AS (SELECT l_partkey, avg(abs(l_extendedprice - l_quantity * 1500)) AS mae, sum(l_discount) / sum(l_quantity) AS wmape_value FROM lineitem GROUP BY 1)"""
    + " UNION ALL ".join(
        f""" SELECT '{c}' AS "column", round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(min({c}), 6) AS min, round(max({c}), 6) AS max,
        round(quantile_cont({c}, 0.9), 6) AS p90, round(quantile_cont({c}, 0.95), 6) AS p95 FROM t"""
        for c in ("mae", "wmape_value")
    ),
)
def _(t):
    rows = t.lineitem.groupBy("l_partkey").agg(
        F.avg(F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1500)).alias("mae"),
        (F.sum("l_discount") / F.sum("l_quantity")).alias("wmape_value"),
    )
    return _rounded(evaluate.precomputed_metric_summary(rows), "mean", "median", "min", "max", "p90", "p95", digits=6)


@query(
    "score_distribution_scored",
    _SCORED
    + """ SELECT count(*) AS n_rows_scored, round(avg(probability), 6) AS mean, round(min(probability), 6) AS min, round(max(probability), 6) AS max,
    count(*) FILTER (WHERE probability >= 0.8) AS high_confidence, count(*) FILTER (WHERE probability >= 0.5 AND probability < 0.8) AS medium_confidence,
    count(*) FILTER (WHERE probability < 0.5) AS low_confidence, round(quantile_cont(probability, 0.1), 6) AS p10, round(quantile_cont(probability, 0.5), 6) AS p50,
    round(quantile_cont(probability, 0.9), 6) AS p90, round(quantile_cont(probability, 0.95), 6) AS p95 FROM t""",
)
def _(t):
    out = evaluate.score_distribution(scored(t), "probability")
    return _rounded(out, "mean", "min", "max", "p10", "p50", "p90", "p95", digits=6)


@query(
    "top_scored_rows",
    _SCORED + " SELECT l_orderkey, prediction, round(probability, 6) AS probability FROM (SELECT * FROM t ORDER BY t.probability DESC, l_orderkey, prediction LIMIT 25)",
)
def _(t):
    return _rounded(evaluate.top_scored(scored(t), "probability", "prediction", "l_orderkey"), "probability", digits=6)


@query(
    "segment_classification_status",
    _MULTI
    + """, s AS (SELECT substr(o_orderpriority, 1, 1) AS segment, t.* FROM t JOIN orders USING (o_orderkey)),
    u AS (SELECT segment, actual, predicted FROM s UNION ALL SELECT '__overall__', actual, predicted FROM s),
    l AS (SELECT segment, actual AS label FROM u UNION SELECT segment, predicted FROM u),
    m AS (SELECT l.segment, label, count(*) FILTER (WHERE actual = label AND predicted = label) AS tp, count(*) FILTER (WHERE actual = label) AS sup,
      count(*) FILTER (WHERE predicted = label) AS pre FROM l JOIN u USING (segment) GROUP BY ALL)
    SELECT segment, sum(sup)::BIGINT AS n, round(sum(tp)::DOUBLE / sum(sup), 4) AS accuracy, round(sum(2.0 * tp / (sup + pre) * sup)::DOUBLE / sum(sup), 4) AS f1_weighted
    FROM m GROUP BY segment""",
)
def _(t):
    rows = multi(t).join(t.orders.select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("segment")), "o_orderkey")
    return evaluate.evaluate_by_segment(rows, "segment", "actual", "predicted")


@query(
    "segment_regression_forecast",
    _FORECAST
    + """, u AS (SELECT segment, actual, prediction FROM t UNION ALL SELECT '__overall__', actual, prediction FROM t)
    SELECT segment, count(*) AS n, round(sqrt(avg(pow(prediction - actual, 2))), 4) AS rmse, round(sum(abs(prediction - actual)) / (sum(abs(actual)) + 1e-9), 4) AS wmape
    FROM u GROUP BY segment""",
)
def _(t):
    return evaluate.evaluate_by_segment(forecast(t), "segment", "actual", "prediction", "regression")


@query("evaluate_predictions_scored")
def _(t):
    return evaluate.evaluate_predictions(scored(t))


@query("evaluate_predictions_forecast")
def _(t):
    return evaluate.evaluate_predictions(forecast(t).select("actual", "prediction"))


# ---- baselines, weights, thresholds, conformal ----


@query(
    "regression_baselines_orders",
    """WITH a AS (SELECT o_totalprice AS y FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_totalprice AS y FROM orders WHERE o_orderkey % 5 = 0),
    g AS (SELECT 'mean' AS strategy, avg(y) AS v FROM a UNION ALL SELECT 'median', median(y) FROM a)
    SELECT strategy, round(sum(abs(y - v)) / sum(abs(y)), 4) AS wmape, round(1 - sum(pow(y - v, 2)) / (var_pop(y) * count(*)), 4) AS r2 FROM g, b GROUP BY strategy""",
)
def _(t):
    held = F.pmod("o_orderkey", F.lit(5)) == 0
    return scoring.regression_baselines(t.orders.where(~held), t.orders.where(held), "o_totalprice")


@query(
    "classification_baselines_status",
    """WITH a AS (SELECT o_orderstatus AS k, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1),
    b AS (SELECT o_orderstatus AS k, count(*) AS m FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1),
    j AS (SELECT k, n::DOUBLE AS n, m::DOUBLE AS m, sum(n) OVER () AS tn, sum(m) OVER () AS tm, row_number() OVER (ORDER BY n DESC, k) AS r FROM a JOIN b USING (k))
    SELECT 'most_frequent' AS strategy, round(m / tm, 4) AS accuracy, round(2 * m / (m + tm) * m / tm, 4) AS f1_weighted FROM j WHERE r = 1
    UNION ALL SELECT 'stratified', round(sum(n / tn * m / tm), 4), round(sum(2 * (n / tn * m) / (n / tn * tm + m) * m / tm), 4) FROM j""",
)
def _(t):
    held = F.pmod("o_orderkey", F.lit(5)) == 0
    return scoring.classification_baselines(t.orders.where(~held), t.orders.where(held), "o_orderstatus")


@query(
    "class_weights_labels",
    """WITH c AS (SELECT toxic::VARCHAR AS label, count(*) AS n FROM labels GROUP BY 1)
    SELECT label, n, round((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n), 6) AS weight, round((SELECT max(n)::DOUBLE / min(n) FROM c), 6) AS imbalance_ratio FROM c""",
)
def _(t):
    return _rounded(scoring.class_weights(t.labels, "toxic"), "weight", "imbalance_ratio", digits=6)


@query(
    "threshold_sweep_scored",
    _SCORED
    + """, g AS (SELECT j, 0.05 + (0.95 - 0.05) * j / 90.0 AS th FROM (SELECT unnest(range(91)) AS j)),
    s AS (SELECT j, count(*) FILTER (WHERE probability >= th - 1e-12 AND actual = 1)::DOUBLE AS tp, count(*) FILTER (WHERE probability >= th - 1e-12 AND actual = 0) AS fp,
      count(*) FILTER (WHERE actual = 1) AS p FROM t, g GROUP BY j)
    SELECT round(0.05 + 0.01 * j, 2)::DOUBLE AS threshold, round(2 * tp / (tp + fp + p), 6) AS f1 FROM s""",
)
def _(t):
    return _rounded(_rounded(scoring.threshold_sweep(scored(t), "actual", "probability"), "f1", digits=6), "threshold", digits=2)


@query(
    "optimal_threshold_scored",
    _SCORED
    + """, g AS (SELECT j, 0.05 + (0.95 - 0.05) * j / 90.0 AS th FROM (SELECT unnest(range(91)) AS j)),
    s AS (SELECT j, count(*) FILTER (WHERE probability >= th - 1e-12 AND actual = 1)::DOUBLE AS tp, count(*) FILTER (WHERE probability >= th - 1e-12 AND actual = 0) AS fp,
      count(*) FILTER (WHERE actual = 1) AS p FROM t, g GROUP BY j)
    SELECT round(0.05 + 0.01 * j, 2)::DOUBLE AS threshold, round(2 * tp / (tp + fp + p), 6) AS f1 FROM s ORDER BY 2 * tp / (tp + fp + p) DESC, j LIMIT 1""",
)
def _(t):
    return _rounded(scoring.optimal_threshold(scored(t), "actual", "probability"), "f1", digits=6)


@query(
    "conformal_halfwidth_forecast",
    _FORECAST
    + """ SELECT round(quantile_cont(abs(actual - prediction), least(1.0, ceil((n + 1) * 0.9) / n)), 4) AS halfwidth FROM t, (SELECT count(*)::DOUBLE AS n FROM t) GROUP BY n""".replace(
        "quantile_cont(abs(actual - prediction), least(1.0, ceil((n + 1) * 0.9) / n))",
        "(list_sort(list(abs(actual - prediction)))[(floor((n - 1) * least(1.0, ceil((n + 1) * 0.9) / n)) + 1)::BIGINT] + "
        "(list_sort(list(abs(actual - prediction)))[(ceil((n - 1) * least(1.0, ceil((n + 1) * 0.9) / n)) + 1)::BIGINT] - "
        "list_sort(list(abs(actual - prediction)))[(floor((n - 1) * least(1.0, ceil((n + 1) * 0.9) / n)) + 1)::BIGINT]) * "
        "((n - 1) * least(1.0, ceil((n + 1) * 0.9) / n) - floor((n - 1) * least(1.0, ceil((n + 1) * 0.9) / n))))",
    ),
)
def _(t):
    width = scoring.conformal_halfwidth(forecast(t), "actual", "prediction")
    return t.spark.range(1).select(F.round(F.lit(width), 4).alias("halfwidth"))


_TRUE_P = "CASE actual WHEN 'F' THEN p_f WHEN 'O' THEN p_o ELSE p_p END"
_RANK_Q = """, v AS (SELECT 1 - {e} AS g FROM t), n AS (SELECT count(*) AS n, least(1.0, ceil((count(*) + 1) * 0.9) / count(*)) AS q FROM v),
  s AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i FROM v), w AS (SELECT
  (SELECT g FROM s, n WHERE i = floor((n.n - 1) * n.q)) AS lo, (SELECT g FROM s, n WHERE i = ceil((n.n - 1) * n.q)) AS hi, (n - 1) * q - floor((n - 1) * q) AS f FROM n),
  h AS (SELECT lo + (hi - lo) * f AS q FROM w)"""


def _class_threshold(t):
    p = F.when(F.col("actual") == "F", F.col("p_f")).when(F.col("actual") == "O", F.col("p_o")).otherwise(F.col("p_p"))
    return scoring.conformal_class_threshold(multi(t), p)


@query("conformal_class_threshold_status", _MULTI + _RANK_Q.format(e=_TRUE_P) + " SELECT round(q, 6) AS threshold FROM h")
def _(t):
    return t.spark.range(1).select(F.round(F.lit(_class_threshold(t)), 6).alias("threshold"))


@query(
    "prediction_sets_status",
    _MULTI
    + """ SELECT o_orderkey, CASE WHEN len(k) > 0 THEN list_aggregate(list_sort(k), 'string_agg', '|') WHEN p_f >= p_o AND p_f >= p_p THEN 'F' WHEN p_o >= p_p THEN 'O' ELSE 'P' END AS prediction_set,
    greatest(len(k), 1)::INT AS prediction_set_size FROM (SELECT *, list_filter([CASE WHEN p_f >= 0.25 THEN 'F' END, CASE WHEN p_o >= 0.25 THEN 'O' END, CASE WHEN p_p >= 0.25 THEN 'P' END], lambda x: x IS NOT NULL) AS k FROM t)""",
)
def _(t):
    out = scoring.prediction_sets(multi(t), {"F": "p_f", "O": "p_o", "P": "p_p"}, 0.75)
    return out.select("o_orderkey", "prediction_set", "prediction_set_size")


@query(
    "prediction_set_summary_status",
    _MULTI
    + """, s AS (SELECT greatest((p_f >= 0.25)::INT + (p_o >= 0.25)::INT + (p_p >= 0.25)::INT, 1) AS z FROM t)
    SELECT round(avg(z), 6) AS average_size, count(*) FILTER (WHERE z = 1) AS singletons, count(*) AS n FROM s""",
)
def _(t):
    sets = scoring.prediction_sets(multi(t), {"F": "p_f", "O": "p_o", "P": "p_p"}, 0.75)
    return _rounded(scoring.prediction_set_summary(sets), "average_size", digits=6)


@query(
    "prediction_intervals_forecast",
    _FORECAST + " SELECT row_key, prediction - 5000 AS prediction_lower, prediction + 5000 AS prediction_upper FROM t",
)
def _(t):
    return scoring.prediction_intervals(forecast(t), "prediction", 5000.0).select("row_key", "prediction_lower", "prediction_upper")


@query(
    "apply_threshold_scored",
    _SCORED + " SELECT CASE WHEN probability >= 0.37 THEN '1' ELSE '0' END AS label, actual, count(*) AS n FROM t GROUP BY ALL",
)
def _(t):
    return scoring.apply_threshold(scored(t), "probability", 0.37, name="label").groupBy("label", "actual").agg(F.count("*").alias("n"))


# ---- drift ----

_STATS_NUM = ["l_quantity", "l_extendedprice", "l_discount"]
_BASE = "(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')"
_NEW = "(SELECT *, l_extendedprice * 3 AS dear FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')"


def _base(t):
    return t.lineitem.where(F.col("l_shipdate") < "1998-01-01")


def _fresh(t):
    return t.lineitem.where(F.col("l_shipdate") >= "1998-01-01").withColumn("l_extendedprice", F.col("l_extendedprice") * 3)


@query(
    "training_stats_lineitem",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, 'numeric' AS type, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max,
        round(quantile_cont({c}, 0.05), 6) AS p5, round(quantile_cont({c}, 0.95), 6) AS p95, 0.0::DOUBLE AS missing_rate,
        list_aggregate(list_transform(quantile_cont({c}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), lambda x: round(x * 1000)::BIGINT), 'string_agg', ',') AS bins,
        NULL::VARCHAR AS top, NULL::BIGINT AS n_unique FROM {_BASE}"""
        for c in _STATS_NUM
    )
    + f""" UNION ALL SELECT 'l_returnflag', 'categorical', NULL, NULL, NULL, NULL, NULL, NULL, 0.0, NULL,
        (SELECT string_agg(v || ':' || round(n::DOUBLE / t * 10000)::BIGINT, ',' ORDER BY n DESC, v) FROM (SELECT l_returnflag AS v, count(*) AS n, sum(count(*)) OVER () AS t FROM {_BASE} GROUP BY 1)), count(DISTINCT l_returnflag) FROM {_BASE}""",
)
def _(t):
    out = drift.training_stats(_base(t), _STATS_NUM, ["l_returnflag"])
    out = out.withColumns(
        {
            "bins": F.array_join(F.transform("quantile_bins", lambda x: F.round(x * 1000).cast("long").cast("string")), ","),
            "top": F.array_join(
                F.transform("top_categories", lambda c: F.concat_ws(":", c["value"], F.round(c["share"] * 10000).cast("long"))), ","
            ),
        }
    ).drop("quantile_bins", "top_categories")
    return _rounded(out, "mean", "std", "p5", "p95", digits=6)


def _psi_sql(c, new):
    return f"""SELECT '{c}' AS feature, round(sum((greatest(n, 1e-6) - 0.1) * ln(greatest(n, 1e-6) / 0.1)), 5) AS psi FROM (
      SELECT i, (SELECT count(*) FROM {_NEW} x WHERE {new} >= q[i] - CASE WHEN i = 1 THEN 1e-9 ELSE 0 END AND {new} < q[i + 1] + CASE WHEN i = 10 THEN 1e-9 ELSE 0 END)::DOUBLE / (SELECT count(*) FROM {_NEW} x) AS n
      FROM (SELECT quantile_cont({c}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM {_BASE}), (SELECT unnest(range(1, 11)) AS i))"""


@query("psi_price_shift", _psi_sql("l_quantity", "l_quantity") + " UNION ALL " + _psi_sql("l_extendedprice", "dear"))
def _(t):
    return drift.psi(_fresh(t), drift.training_stats(_base(t), ["l_quantity", "l_extendedprice"], []))


@query(
    "check_drift_price_shift",
    f"""SELECT 'l_extendedprice' AS feature, 'numeric' AS type, round(abs(b.m - a.m) / a.s, 2) AS mean_shift_std, round(greatest(a.s, b.s) / least(a.s, b.s), 2) AS std_ratio,
    0.0::DOUBLE AS missing_rate_delta, psi, NULL::DOUBLE AS new_category_rate, CASE WHEN psi >= 0.25 THEN 'high' ELSE 'medium' END AS severity
    FROM (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM {_BASE}) a, (SELECT avg(dear) AS m, stddev_samp(dear) AS s FROM {_NEW}) b,
    ({_psi_sql("l_extendedprice", "dear")}) p WHERE psi >= 0.1""",
)
def _(t):
    return drift.check_drift(_fresh(t), drift.training_stats(_base(t), ["l_quantity", "l_extendedprice"], ["l_linestatus"]))


@query(
    "drift_summary_price_shift",
    f"""WITH p AS ({_psi_sql("l_quantity", "l_quantity")} UNION ALL {_psi_sql("l_extendedprice", "dear")}),
    w AS (SELECT avg((l_linestatus NOT IN (SELECT l_linestatus FROM {_BASE}))::INT) AS r FROM {_NEW}),
    d AS (SELECT count(*) FILTER (WHERE psi >= 0.1) + (SELECT (r > 0.1)::INT FROM w) AS n, count(*) FILTER (WHERE psi >= 0.25) + (SELECT (r > 0.3)::INT FROM w) AS h FROM p)
    SELECT n AS n_drifted, 3::BIGINT AS n_features_checked, round(n / 3.0, 3) AS drift_rate, CASE WHEN h > 0 THEN 'high' WHEN n > 0 THEN 'medium' ELSE 'none' END AS overall_severity FROM d""",
)
def _(t):
    return drift.drift_summary(_fresh(t), drift.training_stats(_base(t), ["l_quantity", "l_extendedprice"], ["l_linestatus"]))


@query(
    "fingerprint_orders",
    """SELECT c AS "column", m AS mean, s AS std, n AS n_rows, 3 AS n_cols, substr(md5('o_custkey|o_orderstatus|o_totalprice'), 1, 12) AS column_hash FROM (
    SELECT 'o_custkey' AS c, round(avg(o_custkey), 6) AS m, round(stddev_samp(o_custkey), 6) AS s, count(*) AS n FROM orders
    UNION ALL SELECT 'o_orderstatus', NULL, NULL, count(*) FROM orders
    UNION ALL SELECT 'o_totalprice', round(avg(o_totalprice), 6), round(stddev_samp(o_totalprice), 6), count(*) FROM orders)""",
)
def _(t):
    return drift.fingerprint(t.orders, ["o_totalprice", "o_custkey", "o_orderstatus"])


@query(
    "compare_fingerprints_orders",
    """SELECT 'o_totalprice' AS "column", CASE WHEN sh > 2 THEN 'shifted' ELSE 'ok' END AS status, round(sh, 4) AS shift FROM (
      SELECT abs(avg(o_totalprice * 4) - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders) AS sh FROM orders)
    UNION ALL SELECT 'o_custkey', 'removed', NULL UNION ALL SELECT 'o_orderkey', 'added', NULL""",
)
def _(t):
    stored = drift.fingerprint(t.orders, ["o_totalprice", "o_custkey"])
    now = t.orders.withColumn("o_totalprice", F.col("o_totalprice") * 4)
    return drift.compare_fingerprints(now, ["o_totalprice", "o_orderkey"], stored)


@query("detect_drift_lineitem")
def _(t):
    base = _base(t).select("l_quantity", "l_extendedprice", "l_linestatus", "l_tax")
    stats = drift.training_stats(base, ["l_quantity", "l_extendedprice"], ["l_linestatus"])
    expected = {"l_quantity": "numeric", "l_extendedprice": "numeric", "l_linestatus": "categorical", "l_tax": "numeric"}
    return drift.detect_drift(_fresh(t).drop("l_tax"), stats, expected, drift.fingerprint(base, ["l_quantity", "l_tax"]))


# ---- features ----


@query(
    "lag_features_events",
    """WITH o AS (SELECT event_id, ts, value, lag(value, 1) OVER w AS l1, lag(value, 7) OVER w AS l7,
      avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS r7 FROM events WINDOW w AS (ORDER BY ts, event_id))
    SELECT event_id, round(l1, 6) AS value__lag_1, round(l7, 6) AS value__lag_7, round(r7, 6) AS value__roll_mean_7 FROM o WHERE l1 IS NOT NULL AND l7 IS NOT NULL""",
)
def _(t):
    out = features.lag_features(t.events, "ts", ["value"], key=["event_id"], block_rows=1000)
    out = out.select("event_id", "value__lag_1", "value__lag_7", "value__roll_mean_7")
    return _rounded(out, "value__lag_1", "value__lag_7", "value__roll_mean_7", digits=6)


@query(
    "lag_features_per_user",
    """WITH o AS (SELECT event_id, lag(value, 1) OVER w AS l1, lag(value, 3) OVER w AS l3,
      avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS r5 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, round(l1, 6) AS value__lag_1, round(l3, 6) AS value__lag_3, round(r5, 6) AS value__roll_mean_5 FROM o WHERE l1 IS NOT NULL AND l3 IS NOT NULL""",
)
def _(t):
    out = features.lag_features(t.events, "ts", ["value"], [1, 3], [5], ["user_id"], ["event_id"], block_rows=16)
    out = out.select("event_id", "value__lag_1", "value__lag_3", "value__roll_mean_5")
    return _rounded(out, "value__lag_1", "value__lag_3", "value__roll_mean_5", digits=6)


@query(
    "datetime_features_events",
    """SELECT event_id, year(ts)::INT AS ts__year, month(ts)::INT AS ts__month, day(ts)::INT AS ts__day, (isodow(ts) - 1)::INT AS ts__dayofweek,
    (isodow(ts) >= 6)::INT AS ts__is_weekend, hour(ts)::INT AS ts__hour FROM events""",
)
def _(t):
    out = features.datetime_features(t.events, features.fit_datetime_features(t.events, ["ts"]))
    return out.select("event_id", *[c for c in out.columns if c.startswith("ts__")])


@query(
    "impute_scale_fit_gaps",
    _HOLED
    + """ SELECT 'sparse_discount' AS "column", m AS fill, round(avg(coalesce(sparse_discount, m)), 6) AS mean, round(stddev_pop(coalesce(sparse_discount, m)), 6) AS std, NULL::VARCHAR AS fill_text
      FROM t, (SELECT median(sparse_discount) AS m FROM t) GROUP BY m
      UNION ALL SELECT 'l_quantity', m, round(avg(l_quantity), 6), round(stddev_pop(l_quantity), 6), NULL FROM t, (SELECT median(l_quantity) AS m FROM t) GROUP BY m
      UNION ALL SELECT 'flag', NULL, NULL, NULL, (SELECT flag FROM t WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)""",
)
def _(t):
    return _rounded(features.fit_impute_scale(holed_lineitem(t), ["sparse_discount", "l_quantity"], ["flag"]), "mean", "std", digits=6)


@query(
    "impute_scale_apply_gaps",
    _HOLED
    + """, f AS (SELECT median(sparse_discount) AS m FROM t), s AS (SELECT any_value(m) AS m, avg(coalesce(sparse_discount, m)) AS a, stddev_pop(coalesce(sparse_discount, m)) AS d FROM t, f)
      SELECT l_orderkey, round((coalesce(sparse_discount, m) - a) / d, 6) AS sparse_discount FROM t, s""",
)
def _(t):
    rows = holed_lineitem(t).select("l_orderkey", "sparse_discount")
    return _rounded(features.impute_scale(rows, features.fit_impute_scale(rows, ["sparse_discount"])), "sparse_discount", digits=6)


@query(
    "one_hot_orders",
    """SELECT o_orderkey, (o_orderstatus = 'F')::INT AS "o_orderstatus_F", (o_orderstatus = 'O')::INT AS "o_orderstatus_O", (o_orderstatus = 'P')::INT AS "o_orderstatus_P" FROM orders""",
)
def _(t):
    out = features.one_hot(t.orders, features.fit_one_hot(t.orders, ["o_orderstatus"]))
    return out.select("o_orderkey", *[c for c in out.columns if c.startswith("o_orderstatus_")])


@query(
    "target_encode_supplier",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey AS c, l_orderkey % 5 AS f, l_extendedprice AS y FROM lineitem),
      fc AS (SELECT f, c, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM r GROUP BY ALL),
      pc AS (SELECT c, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM fc GROUP BY c), tot AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q FROM fc),
      pf AS (SELECT f, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM fc GROUP BY f),
      o AS (SELECT f, (tot.n - pf.n)::DOUBLE AS n, tot.s - pf.s AS s, tot.q - pf.q AS q FROM pf, tot),
      e AS (SELECT fc.f, fc.c, (pc.n - fc.n)::DOUBLE AS n, pc.s - fc.s AS s, pc.q - fc.q AS q, o.s / o.n AS g, o.q / o.n - pow(o.s / o.n, 2) AS v FROM fc JOIN pc USING (c) JOIN o ON o.f = fc.f),
      k AS (SELECT f, c, CASE WHEN n > 0 THEN n * v / (n * v + greatest(q / n - pow(s / n, 2), 0)) * s / n + (1 - n * v / (n * v + greatest(q / n - pow(s / n, 2), 0))) * g ELSE g END AS enc FROM e)
      SELECT l_orderkey, l_linenumber, round(enc, 3) AS l_suppkey__target FROM r JOIN k USING (f, c)""",
)
def _(t):
    out = features.target_encode(t.lineitem, "l_suppkey", "l_extendedprice", F.pmod("l_orderkey", F.lit(5)))
    return _rounded(out.select("l_orderkey", "l_linenumber", "l_suppkey__target"), "l_suppkey__target", digits=3)


@query(
    "looks_like_id_columns",
    """SELECT 'o_orderkey' AS "column", count(DISTINCT o_orderkey) = count(*) AND max(o_orderkey) - min(o_orderkey) = count(*) - 1 AS is_id FROM orders
       UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) = count(*) AND max(o_custkey) - min(o_custkey) = count(*) - 1 FROM orders
       UNION ALL SELECT 'o_totalprice', false UNION ALL SELECT 'row_num', true""",
)
def _(t):
    return features.looks_like_id(t.orders.withColumn("row_num", F.col("o_custkey") * 2))


@query(
    "should_log_transform_columns",
    _HOLED
    + " UNION ALL ".join(
        f" SELECT '{c}' AS \"column\", min({c}) >= 0 AND skewness({c}) > 1.5 AS log_transform FROM t"
        for c in ("heavy", "l_quantity", "sparse_discount")
    ),
)
def _(t):
    return features.should_log_transform(holed_lineitem(t), ["heavy", "l_quantity", "sparse_discount"])


@query("log_target_orders", "SELECT o_orderkey, round(ln(o_totalprice + 1), 6) AS o_totalprice FROM orders")
def _(t):
    return _rounded(features.log_target(t.orders, "o_totalprice").select("o_orderkey", "o_totalprice"), "o_totalprice", digits=6)


@query(
    "task_types_orders",
    """SELECT 'o_totalprice' AS "column", CASE WHEN count(DISTINCT o_totalprice) > 20 THEN 'regression' ELSE 'classification' END AS task_type FROM orders
       UNION ALL SELECT 'o_orderstatus', 'classification'
       UNION ALL SELECT 'priority_digit', CASE WHEN count(DISTINCT substr(o_orderpriority, 1, 1)) > 20 THEN 'regression' ELSE 'classification' END FROM orders""",
)
def _(t):
    rows = t.orders.withColumn("priority_digit", F.substring("o_orderpriority", 1, 1))
    return features.task_types(rows, ["o_totalprice", "o_orderstatus", "priority_digit"])


@query(
    "detect_leakage_price",
    """WITH t AS (SELECT l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS net, l_quantity FROM lineitem)
       SELECT 'net' AS feature, CASE WHEN corr(net, price) >= 0.95 THEN 'high' ELSE 'medium' END AS risk, round(abs(corr(net, price)), 3) AS correlation, 'correlation' AS reason FROM t HAVING abs(corr(net, price)) >= 0.85
       UNION ALL SELECT 'l_quantity', CASE WHEN corr(l_quantity, price) >= 0.95 THEN 'high' ELSE 'medium' END, round(abs(corr(l_quantity, price)), 3), 'correlation' FROM t HAVING abs(corr(l_quantity, price)) >= 0.85
       UNION ALL SELECT 'price_band', 'medium', NULL, 'name_similarity'""",
)
def _(t):
    rows = t.lineitem.select(
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        "l_quantity",
        F.col("l_returnflag").alias("price_band"),
    )
    return features.detect_leakage(rows, ["net", "l_quantity", "price_band"], "price")


@query("select_features_lineitem")
def _(t):
    rows = t.lineitem.select(
        "l_quantity", "l_extendedprice", "l_discount", (F.col("l_quantity") * 2).alias("double_quantity"), F.lit(1).alias("one"),
        F.lit("x").alias("same"), "l_returnflag",
    )
    return features.select_features(rows, rows.columns)


def _role_sql(column: str) -> str:
    return f"""SELECT '{column}' AS feature, CASE WHEN count(try_cast(v AS TIMESTAMP)) >= {features.PARSE_SHARE} * count(v) AND count(v) > 0 THEN 'datetime'
      WHEN count(DISTINCT v) <= {features.ONE_HOT_LEVELS} THEN 'one_hot'
      WHEN count(DISTINCT v) <= {features.TARGET_LEVELS} AND count(DISTINCT v)::DOUBLE / count(*) <= {features.TARGET_UNIQUE_SHARE} THEN 'target_encoded'
      WHEN avg(len(list_filter(regexp_split_to_array(v, '\\s+'), lambda w: w <> ''))) > {features.TEXT_WORDS} THEN 'text' ELSE 'dropped' END AS role
      FROM (SELECT {column}::VARCHAR AS v FROM r)"""


@query(
    "split_feature_types_documents",
    "WITH r AS (SELECT d.*, l.* EXCLUDE (doc_id), '2024-01-05' AS day FROM documents d LEFT JOIN labels l USING (doc_id)) "
    + " UNION ALL ".join(
        [_role_sql(c) for c in ("text", "lang", "source", "day")]
        + [f"SELECT '{c}' AS feature, 'numeric' AS role" for c in ("doc_id", "n_chars", "quality", "toxic")]
    ),
)
def _(t):
    rows = t.documents.join(t.labels, "doc_id", "left").withColumn("day", F.lit("2024-01-05"))
    return features.split_feature_types(rows, rows.columns)


_SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "interaction_features_lineitem",
    "WITH s AS (SELECT "
    + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS d{i}" for i, c in enumerate(_SCALED))
    + " FROM lineitem), z AS (SELECT "
    + ", ".join(f"({c} - m{i}) / d{i} AS z{i}" for i, c in enumerate(_SCALED))
    + " FROM lineitem, s) "
    + " UNION ALL ".join(
        f'SELECT \'{_SCALED[a]}\' AS "left", \'{_SCALED[b]}\' AS "right", round(var_pop(z{a} * z{b}), 6) AS variance FROM z'
        for a in range(4)
        for b in range(a + 1, 4)
    ),
)
def _(t):
    return _rounded(features.fit_interactions(t.lineitem, _SCALED), "variance", digits=6)
