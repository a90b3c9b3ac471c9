"""Anomalies, clusters, training, scoring, explanation and forecasting on whole tables."""

from pyspark.sql import functions as F

from tablewise.operators import explain, features, forecast, mine, models, train
from workload.profiling import _rounded
from workload.registry import query

_LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("anomaly_scan_lineitem")
def _(t):
    return mine.anomaly_scan(t.lineitem, _LI_NUM, _LI_KEY)


_ODD = "l_extendedprice > 104000"


@query(
    "explain_anomaly_lineitem",
    f"""WITH s AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS qm, stddev_samp(l_quantity) AS qs, avg(l_extendedprice) AS em, stddev_samp(l_extendedprice) AS es FROM lineitem),
    o AS (SELECT *, rank() OVER (ORDER BY l_quantity) - 1 AS qr, rank() OVER (ORDER BY l_extendedprice) - 1 AS er FROM lineitem),
    x AS (SELECT l_orderkey, l_linenumber, l_partkey, 'l_quantity' AS feature, l_quantity AS value, qr / n * 100 AS p, (l_quantity - qm) / qs AS z FROM o, s WHERE {_ODD}
      UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_extendedprice', l_extendedprice, er / n * 100, (l_extendedprice - em) / es FROM o, s WHERE {_ODD})
    SELECT l_orderkey, l_linenumber, l_partkey, feature, round(value, 6) AS value, round(p, 1) AS percentile, round(z, 2) AS z_score, CASE WHEN round(p, 1) > 50 THEN 'high' ELSE 'low' END AS direction,
      row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY abs(round(p, 1) - 50) DESC, feature)::INT AS rank FROM x""",
)
def _(t):
    return mine.explain_anomaly(t.lineitem, ["l_quantity", "l_extendedprice"], t.lineitem.where(_ODD), ["l_orderkey", "l_linenumber", "l_partkey"])


def _clusters(t):
    return mine.kmeans_clusters(t.orders.withColumn("day", F.datediff("o_orderdate", F.lit("1992-01-01"))), ["o_totalprice", "day"], ["o_orderkey"], 4)


@query("kmeans_cluster_sizes")
def _(t):
    return mine.cluster_summary(_clusters(t), ["o_totalprice", "day"])


@query("kmeans_silhouette")
def _(t):
    return mine.silhouette(_clusters(t))


# ---- training data on whole tables ----


def quality_table(t):
    """Document quality with simple text features."""
    text = F.col("text")
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id", "lang", "n_chars", F.size(F.split(text, r"\s+")).alias("words"), F.size(F.split(text, "\n")).alias("lines"),
        (F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(F.length(text), F.lit(1))).alias("digit_share"), "quality",
    )


def daily_orders(t):
    """Daily totals per order priority."""
    return t.orders.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").cast("double").alias("orders")
    )


def price_table(t):
    return t.part.select("p_partkey", "p_brand", "p_size", "p_retailprice")


_FITTED: dict = {}


def _once(fit):
    """Fit once per session and folder; several queries look at the same model."""

    def get(t, *args):
        slot = (t.spark.sparkContext.applicationId, t.folder, fit.__name__, args)
        if slot not in _FITTED:
            _FITTED[slot] = fit(t, *args)
        return _FITTED[slot]

    return get


@_once
def _quality_model(t, kind="logistic_regression"):
    return train.train_supervised_model(quality_table(t), "quality", ["doc_id"], model_type=kind)


@_once
def _price_model(t):
    return train.train_supervised_model(price_table(t), "p_retailprice", ["p_partkey"], model_type="ridge_regression")


@_once
def _daily_model(t):
    return train.train_supervised_model(
        daily_orders(t), "total", ["o_orderpriority"], ["day", "orders"], model_type="linear_regression", lag_series=["o_orderpriority"]
    )


@query(
    "split_train_test_stratified",
    """WITH c AS (SELECT o_orderstatus, count(*) AS n, round(count(*) * 0.2)::BIGINT AS held FROM orders GROUP BY 1)
    SELECT o_orderstatus, true AS is_test, held AS n FROM c UNION ALL SELECT o_orderstatus, false, n - held FROM c""",
)
def _(t):
    out = train.split_train_test(t.orders, ["o_orderkey"], stratify="o_orderstatus")
    return out.groupBy("o_orderstatus", "is_test").agg(F.count("*").alias("n"))


@query(
    "split_train_test_temporal",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 >= floor((SELECT count(*) FROM orders) * 0.8) AS is_test FROM orders""",
)
def _(t):
    return train.split_train_test(t.orders, ["o_orderkey"], time_col="o_orderdate").select("o_orderkey", "is_test")


@query("train_classifier_quality")
def _(t):
    return train.evaluation_rows(t.spark, _quality_model(t))


@query("train_tree_classifier_quality")
def _(t):
    return train.evaluation_rows(t.spark, _quality_model(t, "decision_tree"))


@query("train_regressor_parts")
def _(t):
    return train.evaluation_rows(t.spark, _price_model(t))


@query("train_temporal_regressor")
def _(t):
    return train.evaluation_rows(t.spark, _daily_model(t))


@query("auto_select_model_parts")
def _(t):
    rows = price_table(t)
    best = train.auto_select_model(rows, "p_retailprice", {"p_size": "numeric", "p_brand": "one_hot"}, "regression", ["p_partkey"])
    return t.spark.createDataFrame([(best,)], "model_type string")


@query("tune_forest_parts")
def _(t):
    roles = {"p_size": "numeric", "p_brand": "one_hot"}
    best = train.tune(price_table(t), "p_retailprice", roles, "regression", "random_forest", ["p_partkey"])
    return t.spark.createDataFrame([(k, float(v)) for k, v in best.items()], "parameter string, value double")


@query("cross_validate_parts")
def _(t):
    cv = train.cross_validate(price_table(t), "p_retailprice", {"p_size": "numeric", "p_brand": "one_hot"}, "regression", "ridge_regression", ["p_partkey"], 5)
    return t.spark.createDataFrame(list(enumerate(cv["scores"])), "fold int, score double")


@query("train_knn_regressor_parts")
def _(t):
    return train.evaluation_rows(t.spark, train.train_supervised_model(price_table(t), "p_retailprice", ["p_partkey"], model_type="knn"))


@query("feature_importance_quality")
def _(t):
    return t.spark.createDataFrame(train.feature_importance(_quality_model(t, "decision_tree")), "feature string, importance double")


@query("smote_toxic_documents")
def _(t):
    rows = t.documents.join(t.labels, "doc_id").select(
        "doc_id", "toxic", F.array(F.ln("n_chars"), F.size(F.split("text", r"\s+")).cast("double")).alias("v")
    )
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    minority = str(min(counts, key=lambda k: counts[k]))
    return train.smote(rows, "toxic", "v", ["doc_id"], minority)


@query(
    "knn_predict_embeddings",
    """WITH s AS (SELECT vec_id >= (SELECT max(vec_id) * 0.8 FROM embeddings) AS held, * FROM embeddings),
    d AS (SELECT a.vec_id AS query_id, b.label, b.vec_id, round(sqrt(greatest(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) + list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]) - 2 * list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0)), 6) AS dist FROM s a, s b WHERE a.held AND NOT b.held),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS r FROM d) WHERE r <= 5),
    v AS (SELECT query_id, label::VARCHAR AS l, count(*) AS n FROM k GROUP BY ALL)
    SELECT query_id, l AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, l) AS r FROM v) WHERE r = 1""",
)
def _(t):
    e = t.embeddings
    cut = e.agg((F.max("vec_id") * 0.8).alias("c")).first()["c"]
    return train.knn_predict(e.where(F.col("vec_id") < cut), e.where(F.col("vec_id") >= cut), "label", "embedding", "vec_id", "vec_id")


@query("text_vectors_documents")
def _(t):
    docs = t.documents.select("doc_id", "text")
    fitted = features.text_vectors(docs, "text", name="vector")
    from pyspark.ml.functions import vector_to_array

    return fitted.transform(docs).select("doc_id", vector_to_array("vector").alias("vector"))


# ---- scoring and explanation ----


@query("score_with_model_parts")
def _(t):
    return models.score_with_model(_price_model(t), price_table(t), ["p_partkey"])


@query("score_classifier_quality")
def _(t):
    return models.score_with_model(_quality_model(t), quality_table(t), ["doc_id"])


@query("evaluate_trained_model_parts")
def _(t):
    return models.evaluate_trained_model(t.spark, _price_model(t), price_table(t).drop("p_size"))


@query("retrain_on_drift_parts")
def _(t):
    fresh = price_table(t).withColumn("p_size", F.col("p_size") + 60)
    return models.retrain_on_drift(_price_model(t), fresh, price_table(t), ["p_partkey"])


@query("permutation_importance_parts")
def _(t):
    return explain.permutation_importance(_price_model(t), price_table(t), ["p_partkey"])


_COEFS = {"l_quantity": 1500.0, "l_discount": -20000.0, "l_tax": 0.5}


@query(
    "linear_importance_lineitem",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(abs({w} * ({c} - m))), 4) AS mean_abs, 0.0::DOUBLE AS mean_signed, round(stddev_pop({w} * ({c} - m)), 4) AS std FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)"
        for c, w in _COEFS.items()
    ),
)
def _(t):
    out = _rounded(explain.linear_importance(t.lineitem, _COEFS), "mean_abs", "mean_signed", "std")
    return out.withColumn("mean_signed", F.abs("mean_signed"))


@query(
    "linear_contributions_lineitem",
    " UNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, l_partkey, '{c}' AS feature, round({w} * ({c} - m), 4) AS contribution FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)"
        for c, w in _COEFS.items()
    ),
)
def _(t):
    return _rounded(explain.linear_contributions(t.lineitem, _COEFS, ["l_orderkey", "l_linenumber", "l_partkey"]), "contribution")


@query("linear_shap_parts")
def _(t):
    return explain.summarise_contributions(explain.linear_shap(_price_model(t), price_table(t), ["p_partkey"]))


@query("shapley_sampling_parts")
def _(t):
    return explain.shapley_sampling(_price_model(t), price_table(t), ["p_partkey"])


@query("partial_dependence_parts")
def _(t):
    return explain.partial_dependence(_price_model(t), price_table(t), ["p_size", "p_brand"])


@query("ice_curves_parts")
def _(t):
    return explain.ice_curves(_price_model(t), price_table(t), "p_size", ["p_partkey"])


@query("what_if_parts")
def _(t):
    overrides = price_table(t).select("p_partkey", (F.col("p_size") + 5).alias("p_size"))
    return explain.what_if(_price_model(t), price_table(t), overrides, ["p_partkey"])


# ---- forecasting ----


@query(
    "infer_steps_daily",
    """WITH d AS (SELECT o_orderpriority, o_orderdate::DATE AS day FROM orders GROUP BY ALL), g AS (SELECT o_orderpriority, day - lag(day) OVER (PARTITION BY o_orderpriority ORDER BY day) AS gap FROM d),
    c AS (SELECT o_orderpriority, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, gap) AS r FROM c)
    SELECT o_orderpriority, gap::INT AS step_days, CASE WHEN gap <= 1 THEN '1 day' WHEN gap <= 7 THEN '7 days' WHEN gap <= 31 THEN '1 month' ELSE '1 year' END AS step FROM m WHERE r = 1""",
)
def _(t):
    return forecast.infer_steps(daily_orders(t), "day", ["o_orderpriority"])


@query(
    "holt_forecast_daily",
    f"""WITH RECURSIVE d AS (SELECT o_orderpriority AS p, row_number() OVER (PARTITION BY o_orderpriority ORDER BY day) AS i, total AS y,
        lead(total) OVER (PARTITION BY o_orderpriority ORDER BY day) AS nxt, avg(total) OVER (PARTITION BY o_orderpriority) AS mean, count(*) OVER (PARTITION BY o_orderpriority) AS n
        FROM (SELECT o_orderpriority, o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL)),
      w AS (SELECT unnest({list(forecast.ALPHAS)}::DOUBLE[]) AS a), v AS (SELECT unnest({list(forecast.BETAS)}::DOUBLE[]) AS b),
      s AS (SELECT p, a, b, i, y AS l, nxt - y AS t, 0.0::DOUBLE AS sse FROM d, w, v WHERE i = 1
        UNION ALL SELECT s.p, a, b, d.i, a * y + (1 - a) * (l + t), b * (a * y + (1 - a) * (l + t) - l) + (1 - b) * t, sse + (y - l - t) * (y - l - t)
        FROM s JOIN d ON d.p = s.p AND d.i = s.i + 1),
      e AS (SELECT s.*, n, mean, row_number() OVER (PARTITION BY s.p ORDER BY sse, a, b) AS r FROM s JOIN d ON d.p = s.p AND d.i = s.i AND d.i = d.n)
      SELECT p AS o_orderpriority, step::INT AS step, round(CASE WHEN n < 4 THEN mean ELSE l + step * t END, 2) AS forecast FROM e, (SELECT unnest(range(1, 15)) AS step) WHERE r = 1""",
)
def _(t):
    out = forecast.holt_forecast(daily_orders(t), "day", "total", 14, ["o_orderpriority"], block_rows=500)
    return _rounded(out, "forecast", digits=2)


@query("forecast_with_model_daily")
def _(t):
    return forecast.forecast_with_model(_daily_model(t), daily_orders(t), 7)


@query("forecast_holdout_daily")
def _(t):
    return forecast.forecast_holdout(_daily_model(t), daily_orders(t), 7)


@query(
    "forecast_intervals_daily",
    """SELECT o_orderkey, o_totalprice - 1000 * sqrt(o_orderkey % 30 + 1) AS lower_90, o_totalprice + 1000 * sqrt(o_orderkey % 30 + 1) AS upper_90 FROM orders""",
)
def _(t):
    rows = t.orders.select("o_orderkey", F.col("o_totalprice").alias("prediction"), (F.pmod("o_orderkey", F.lit(30)) + 1).alias("step"))
    return forecast.forecast_intervals(rows, 1000.0).select("o_orderkey", "lower_90", "upper_90")
