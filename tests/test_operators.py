"""Operators on small fixtures with hand-computed or NumPy values."""

import itertools
import math
import re
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewise.operators import (
    causal,
    charts,
    crossdata,
    drift,
    evaluate,
    explain,
    features,
    forecast,
    hypothesis,
    insights,
    mine,
    models,
    pivot,
    profile,
    relate,
    retrieve,
    scoring,
    train,
    trend,
)
from tablewise.operators.sql import safe_view_name, sql_query
from tablewise.sources import datasets, tables


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


# ---- profile and quality ----


def test_profile_findings(spark, distributed):
    n = 50
    df = frame(
        spark,
        id=range(n),
        continuous=np.linspace(0, 1, n),
        mostly_missing=[1.0] * 20 + [float("nan")] * 30,
        skewed=[1] * 45 + [1000] * 5,
    )
    found = {(r["column"], r["finding"]) for r in profile.profile_findings(df).collect()}
    assert ("mostly_missing", "mostly_missing") in found and ("mostly_missing", "constant") in found
    assert ("id", "identifier_like") in found and ("continuous", "identifier_like") not in found
    assert ("skewed", "highly_skewed") in found
    row = profile.profile_dataset(df).where("name = 'continuous'").first()
    assert math.isclose(row["p25"], 0.25) and row["missing"] == 0


def test_profile_of_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string, c timestamp, d boolean")
    rows = {r["name"]: r for r in profile.profile_dataset(df).collect()}
    assert len(rows) == 4 and rows["a"]["mean"] is None and rows["b"]["unique"] == 0


def test_constant_histogram_and_empty_column(spark):
    df = frame(spark, x=[3.0, 3.0], y=[float("nan")] * 2)
    h = charts.histogram(df, "x", 4).collect()
    assert [r["count"] for r in h] == [0, 0, 2, 0] and h[0]["bin_start"] == 2.5
    assert charts.histogram(df, "y").count() == 0


def test_pivot_keeps_the_product_and_null_level(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 3.0), (None, 1, 4.0)], "r string, c int, v double")
    out = {(r["r"], r["c"]): r["v"] for r in pivot.multidim_pivot(df, ["r", "c"], "v").collect()}
    assert len(out) == 6 and out[("a", 2)] == 0.0 and out[(None, 1)] == 4.0


def test_pivot_fills_the_first_empty_cells(spark):
    df = spark.createDataFrame([(i, i % 7, float(i)) for i in range(60)], "r int, c int, v double")
    assert [(r.r, r.c, r.v) for r in pivot.multidim_pivot(df, ["r", "c"], "v", top_n=5).collect()] == [(i, i % 7, float(i)) for i in range(59, 54, -1)]
    assert pivot.multidim_pivot(df, ["r", "c"], "v", top_n=400).count() == 400
    rng = np.random.default_rng(5)
    for seed in range(4):
        sizes = [int(x) for x in rng.integers(1, 5, 3)]
        rows = {tuple(None if x == 0 else int(x) for x in rng.integers(0, sizes)) for _ in range(rng.integers(1, 25))}
        levels = [sorted({r[k] for r in rows}, key=lambda x: (x is not None, x or 0)) for k in range(3)]
        want = [c for c in itertools.product(*levels) if c not in rows]
        cells = spark.createDataFrame(list(rows), "a int, b int, c int")
        for count in (1, 3, 200):
            got = [tuple(r) for r in pivot.first_empty_cells(cells, ["a", "b", "c"], count).collect()]
            assert sorted(got, key=str) == sorted(want[:count], key=str)


def test_pivot_of_a_thousand_levels_each(spark):
    df = spark.range(1000).selectExpr("id AS a", "(id * 7) % 1000 AS b", "(id * 13) % 1000 AS c", "id * 1.0D - 900 AS v")
    out = pivot.multidim_pivot(df, ["a", "b", "c"], "v", top_n=150).collect()
    assert len(out) == 150 and [r.v for r in out[:99]] == [float(x) for x in range(99, 0, -1)]
    assert sorted((r.a, r.b, r.c) for r in out[100:]) == [(0, 0, i) for i in range(1, 51)]


# ---- SQL sandbox ----


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM csv.`/etc/passwd`",
        "COPY t TO '/tmp/x'",
        "ATTACH 'x.db'",
        "INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT * FROM t",
        "CREATE TABLE z AS SELECT * FROM t",
        "DROP TABLE t",
        "SET spark.sql.runSQLOnFiles=true",
        "SELECT reflect('java.lang.System', 'exit', 1) FROM t",
        "SELECT (SELECT java_method('java.util.UUID', 'randomUUID')) FROM t",
        "WITH c AS (SELECT TRANSFORM(a) USING 'cat' AS (b) FROM t) SELECT * FROM c",
        "SELECT nope FROM t",
    ],
)
def test_sql_rejects(spark, text):
    with pytest.raises(ValueError):
        sql_query(frame(spark, a=[1, 2, 3]), text).collect()


def test_sql_and_view_names(spark):
    df = frame(spark, a=[1, 2, 3])
    assert sql_query(df, "SELECT sum(a) AS s FROM t").first()["s"] == 6
    assert sql_query(df, "SELECT count(*) AS n FROM t JOIN u ON t.a = u.a", {"u": df}).first()["n"] == 3
    assert safe_view_name("2024 sales (eu).csv") == "ds_2024_sales_eu"
    assert safe_view_name("t.csv", "abcdef99") == "t_abcdef" and safe_view_name("---.csv") == "ds"
    assert len(safe_view_name("x" * 80 + ".csv")) == 32


# ---- relationships, trend ----


def test_sparse_pair_has_low_overlap_and_constant_is_dropped(spark):
    df = frame(spark, a=range(100), sparse=[float("nan")] * 80 + list(range(20)), flat=[1.0] * 100)
    rows = relate.correlation_pairs(df).collect()
    assert [(r["column_a"], r["column_b"], r["low_overlap"]) for r in rows] == [("a", "sparse", True)]


def test_full_association(spark):
    df = frame(spark, region=["high"] * 50 + ["low"] * 50, revenue=[10.0] * 50 + [1.0] * 50)
    assert relate.correlation_ratio(df, "region", "revenue").first()["correlation_ratio"] == 1.0


def test_weeks_end_on_sunday_and_gaps_are_zero(spark):
    df = frame(spark, date=["2023-01-03", "2023-01-20"], revenue=[1.0, 2.0])
    rows = trend.trend_periods(df, "date", "revenue", "W").orderBy("period").collect()
    assert [(str(r["period"]), r["value"]) for r in rows] == [("2023-01-08", 1.0), ("2023-01-15", 0.0), ("2023-01-22", 2.0)]
    change = [r["pct_change"] for r in trend.pct_change(trend.trend_periods(df, "date", "revenue", "W")).orderBy("period").collect()]
    assert change[0] is None and change[1] == -100.0 and change[2] == math.inf
    assert trend.detect_datetime_col(df) == "date" and trend.infer_freq(61) == "W"


# ---- tests and effects ----


def test_mannwhitney_exact_tail(spark):
    a, b = [1.1, 2.2, 3.3, 9.0], [4.4, 5.5, 6.6, 7.7, 8.8]
    row = hypothesis.mannwhitney(frame(spark, g=["a"] * 4 + ["b"] * 5, v=a + b), "v", "g").first()
    pool = a + b

    def u(x, y):
        return sum(i > j for i in x for j in y)

    us = [u([pool[i] for i in c], [pool[i] for i in range(9) if i not in c]) for c in itertools.combinations(range(9), 4)]
    seen = u(a, b)
    tail = min(np.mean([v <= seen for v in us]), np.mean([v >= seen for v in us]))
    assert row["u_statistic"] == seen and math.isclose(row["p_value"], min(1, 2 * tail), abs_tol=1e-6)


def test_t_test_p_value(spark):
    rows = hypothesis.one_sample_t(frame(spark, x=[1.0, 2.0, 3.0, 4.0, 5.0]), "x", 2.0).first()
    assert rows["t_statistic"] == 1.4142 and math.isclose(rows["p_value"], 0.230200, abs_tol=2e-6)


def test_chi_squared_yates(spark):
    df = frame(spark, a=["x"] * 30 + ["y"] * 30, b=["p"] * 20 + ["q"] * 10 + ["p"] * 10 + ["q"] * 20)
    row = hypothesis.chi_squared(df, "a", "b").first()
    assert row["chi2_statistic"] == 5.4 and row["dof"] == 1


def test_causal_effect_matches_matrix_hc3(spark):
    rng = np.random.default_rng(3)
    n = 200
    c = rng.normal(size=n)
    t = (rng.random(n) < 0.5).astype(float)
    y = 2 * t + c + rng.normal(size=n)
    row = causal.estimate_causal_effect(frame(spark, t=t, y=y, c=c), "t", "y", ["c"]).first()
    x = np.column_stack([np.ones(n), t, c])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    e = y - x @ beta
    cov = inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv
    assert math.isclose(row["ate"], beta[1], abs_tol=1e-6) and math.isclose(row["std_error_hc3"], math.sqrt(cov[1, 1]), abs_tol=1e-6)
    assert row["treatment_is_binary"] and abs(row["ate"] - 2) < 0.5


def test_mediation_paths(spark):
    rng = np.random.default_rng(5)
    t = rng.normal(size=400)
    m = 0.8 * t + 0.1 * rng.normal(size=400)
    y = 1.2 * m + 0.5 * t + 0.1 * rng.normal(size=400)
    row = causal.mediation(frame(spark, t=t, m=m, y=y), "t", "y", "m").first()
    assert abs(row["path_a"] - 0.8) < 0.05 and abs(row["path_b"] - 1.2) < 0.2 and abs(row["direct_effect"] - 0.5) < 0.2


def test_cross_correlations_equal_a_real_join(spark):
    rng = np.random.default_rng(2)
    a = pd.DataFrame({"k": rng.integers(0, 5, 60), "x": rng.normal(size=60)})
    b = pd.DataFrame({"k": rng.integers(0, 5, 40)})
    b["z"] = a.groupby("k")["x"].mean().reindex(b["k"]).to_numpy() * 3 + rng.normal(size=40) * 0.01
    a["w"] = a.groupby("k")["x"].transform("mean")
    joined = a.merge(b, on="k")
    out = crossdata.cross_correlations(spark.createDataFrame(a), spark.createDataFrame(b), "k", "k").collect()
    want = round(joined["w"].corr(joined["z"]), 4)
    assert [(r["col_a"], r["col_b"], r["pearson_r"], r["n_matched"]) for r in out] == [("w", "z", want, len(joined))]


# ---- evaluation ----


def test_binary_ranking_metrics(spark):
    y, p = [0, 0, 1, 1, 1, 0], [0.1, 0.4, 0.35, 0.8, 0.4, 0.4]
    df = frame(spark, actual=y, probability=p)
    pairs = [(a, b) for a, u in zip(p, y) if u for b, v in zip(p, y) if not v]
    auc = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs])
    assert math.isclose(evaluate.roc_auc(df, "actual", "probability").first()["roc_auc"], auc)
    curve = evaluate.roc_curve(df, "actual", "probability").collect()
    assert (curve[0]["fpr"], curve[0]["tpr"]) == (0, 0) and (curve[-1]["fpr"], curve[-1]["tpr"]) == (1, 1)


def test_ranking_refuses_three_labels(spark):
    df = frame(spark, y=[0, 1, 2, 1], p=[0.1, 0.2, 0.3, 0.4])
    with pytest.raises(ValueError):
        evaluate.roc_auc(df, "y", "p")


def test_null_pairs_count_as_errors_in_slices_only(spark):
    df = spark.createDataFrame([(1, 1, "a"), (None, None, "a"), (0, 1, None)], "actual int, prediction int, s string")
    assert evaluate.classification_metrics(df, "actual", "prediction").first()["n_rows_evaluated"] == 2
    slices = {r["slice_value"]: r["error_rate"] for r in evaluate.error_slices(df, "actual", "prediction", ["s"]).collect()}
    assert slices == {"a": 0.5, None: 1.0}


def test_prediction_columns_by_name(spark):
    df = frame(spark, customer_id=[1, 2], churn_probability=[0.9, 0.2], churn=[1, 0])
    roles = evaluate.infer_prediction_columns(df)
    assert roles["probability_col"] == "churn_probability" and roles["id_col"] == "customer_id"
    assert roles["actual_col"] is None and roles["prediction_col"] == "churn"


def test_threshold_sweep_is_the_best_of_its_curve(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(500), 2)
    y = (rng.random(500) < p).astype(int)
    df = frame(spark, y=y, p=p)
    best = scoring.optimal_threshold(df, "y", "p").first()
    f1 = []
    for t in np.linspace(0.05, 0.95, 91):
        tp, pred = ((p >= t) & (y == 1)).sum(), (p >= t).sum()
        f1.append(2 * tp / (pred + y.sum()))
    assert math.isclose(best["f1"], max(f1)) and best["threshold"] == round(0.05 + 0.01 * int(np.argmax(f1)), 2)


# ---- drift, features ----


def test_identical_data_has_no_drift(spark):
    df = frame(spark, x=np.random.default_rng(0).normal(size=1000), c=["a", "b"] * 500)
    stats = drift.training_stats(df)
    assert drift.psi(df, stats).first()["psi"] < 1e-6
    assert drift.check_drift(df, stats).count() == 0
    far = df.withColumn("x", F.col("x") + 9).withColumn("c", F.lit("z"))
    assert {r["feature"]: r["severity"] for r in drift.check_drift(far, stats).collect()} == {"x": "high", "c": "high"}


def test_lags_across_blocks_and_series(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": np.where(rng.random(400) < 0.5, "hot", "cold"), "ts": np.arange(400), "v": rng.normal(size=400)})
    out = features.lag_features(spark.createDataFrame(pdf).repartition(5), "ts", ["v"], [1, 7], [7], ["k"], ["ts"], block_rows=13)
    got = out.orderBy("ts").toPandas().set_index("ts")
    g = pdf.groupby("k")["v"]
    want = pdf.assign(a=g.shift(1), b=g.shift(7), m=g.transform(lambda s: s.shift(1).rolling(7, min_periods=1).mean()))
    want = want.dropna(subset=["a", "b"]).set_index("ts")
    assert (got.index == want.index).all()
    assert np.allclose(got["v__lag_7"], want["b"]) and np.allclose(got["v__roll_mean_7"], want["m"])


def test_feature_roles_and_selection(spark):
    n = 120
    df = frame(
        spark,
        zip_code=[f"z{i % 55}" for i in range(n)],
        city=["a", "b"] * (n // 2),
        review=[f"word{i} more words here now" for i in range(n)],
        code=[f"c{i}" for i in range(n)],
        day=["2024-01-05"] * n,
        a=np.arange(n, dtype=float),
        a2=np.arange(n) * 2.0,
        one=[1.0] * n,
    )
    roles = {r["feature"]: r["role"] for r in features.split_feature_types(df, df.columns).collect()}
    assert roles["zip_code"] == "target_encoded" and roles["city"] == "one_hot" and roles["review"] == "text"
    assert roles["code"] == "dropped" and roles["day"] == "datetime" and roles["a"] == "numeric"
    fate = {r["feature"]: (r["kept"], r["reason"]) for r in features.select_features(df, ["a", "a2", "one"]).collect()}
    assert fate == {"a": (False, "collinear"), "a2": (True, None), "one": (False, "near_constant")}


# ---- retrieval ----


def _reference_chunks(text, max_chars, overlap):
    """Plain restatement of the chunking rules for comparison."""
    text = text.strip()
    if not text:
        return []
    units = []
    for para in (p.strip() for p in re.split(r"\n{2,}", text)):
        if not para:
            continue
        if len(para) <= max_chars:
            units.append(para)
            continue
        run = ""
        for s in re.split(r"(?<=[.!?])\s+", para):
            if run and len(run) + 1 + len(s) > max_chars:
                units.append(run.strip())
                run = s
            else:
                run = f"{run} {s}" if run else s
        if run:
            units.append(run.strip())
    raw, run = [], ""
    for u in units:
        joined = f"{run}\n\n{u}" if run else u
        if len(joined) <= max_chars:
            run = joined
            continue
        if run:
            raw.append(run)
        run = u if len(u) <= max_chars else ""
        if not run:
            raw += [u[i : i + max_chars].strip() for i in range(0, len(u), max(1, max_chars - overlap))]
    if run:
        raw.append(run)
    out = raw[:1]
    for prev, cur in zip(raw, raw[1:]):
        tail = prev[-overlap:].strip() if overlap > 0 else ""
        out.append((f"{tail}\n\n{cur}" if tail and not cur.startswith(tail) else cur).strip())
    return [c for c in out if c]


@pytest.mark.parametrize("size", [(1200, 150), (60, 15), (40, 0)])
def test_chunks_equal_plain_python(spark, size):
    texts = ["", "short", "one para\n\nsecond para", "A b c. D e f! " * 40, "x" * 3000, "p one.\n\n" * 30, "  lead\n\n\n\ntrail é. Üb er?  "]
    df = frame(spark, source=range(len(texts)), text=texts)
    got = retrieve.chunk_documents(df, "text", "source", *size).orderBy("source", "chunk").toPandas()
    for i, text in enumerate(texts):
        assert got[got.source == i]["text"].tolist() == _reference_chunks(text, *size), i


def test_chunks_of_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = retrieve.chunk_documents(docs, "text", "doc_id").orderBy("source", "chunk").toPandas().groupby("source")["text"].agg(list)
    for r in docs.select("doc_id", "text").collect():
        assert got.get(r["doc_id"], []) == _reference_chunks(r["text"], 1200, 150)


# ---- mining ----


def test_planted_outliers_rank_first(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=102), rng.normal(size=102)
    a[100:], b[100:] = [50, -50], [50, -50]
    df = frame(spark, id=range(102), a=a, b=b)
    worst = mine.anomaly_scan(df, ["a", "b"], ["id"], trees=50).limit(2).collect()
    assert {r["id"] for r in worst} == {100, 101}
    why = mine.explain_anomaly(df, ["a", "b"], df.where("id = 100"), ["id"]).collect()
    assert why[0]["direction"] == "high" and why[0]["percentile"] > 98


def test_two_blobs(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, id=range(80), x=np.r_[rng.normal(0, 0.1, 40), rng.normal(5, 0.1, 40)], y=np.r_[rng.normal(0, 0.1, 40), rng.normal(5, 0.1, 40)])
    clusters = mine.kmeans_clusters(df, ["x", "y"], ["id"], 2)
    assert sorted(r["size"] for r in mine.cluster_summary(clusters, ["x", "y"]).collect()) == [40, 40]
    row = mine.silhouette(clusters).first()
    assert row["silhouette"] > 0.9 and row["distance"] == "squared_euclidean"


# ---- training, explanation, forecasting ----


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(0)
    n = 300
    pdf = pd.DataFrame({"id": np.arange(n) * 3, "a": rng.normal(size=n), "b": rng.normal(size=n), "c": rng.choice(["u", "v"], n)})
    pdf["y"] = 3 * pdf["a"] - 2 * pdf["b"] + (pdf["c"] == "u") * 1.5 + 0.01 * rng.normal(size=n) - 20
    df = spark.createDataFrame(pdf)
    return df, train.train_supervised_model(df, "y", ["id"], model_type="linear_regression", cv_folds=2)


def test_linear_model_learns_and_beats_the_baseline(linear):
    _, m = linear
    assert m.task_type == "regression" and m.evaluation["r2"] > 0.99 and m.comparison["beats_baseline"]
    assert m.conformal_halfwidth < 0.1 and len(m.cross_validation["scores"]) == 2


def test_shapley_values_add_up(linear):
    df, m = linear
    some = df.where("id < 30")
    out = explain.shapley_sampling(m, df, ["id"], draws=150, rows=some).toPandas()
    base = explain.scored(m, df).agg(F.avg("_score")).first()[0]
    f = explain.scored(m, some).toPandas().set_index("id")["_score"]
    total = out.groupby("id")["contribution"].sum()
    assert np.abs(total - (f - base)).max() < 1.5
    assert explain.permutation_importance(m, df, ["id"], 2).first()["feature"] == "a"


def test_dependence_and_what_if(spark, linear):
    df, m = linear
    curve = explain.partial_dependence(m, df, ["a"]).orderBy("value").toPandas()
    slope = np.polyfit(curve["value"], curve["mean_prediction"], 1)[0]
    assert abs(slope - 3) < 0.05
    delta = explain.what_if(m, df, df.select("id", (F.col("a") + 1).alias("a")), ["id"]).toPandas()["delta"]
    assert np.allclose(delta, 3, atol=0.05)


def test_store_and_score_again(spark, linear, tmp_path):
    df, m = linear
    models.save_model(spark, m, str(tmp_path))
    back = models.load_model(spark, str(tmp_path), m.model_id)
    a = models.score_with_model(m, df, ["id"]).orderBy("id").toPandas()
    b = models.score_with_model(back, df, ["id"]).orderBy("id").toPandas()
    assert np.allclose(a["prediction"], b["prediction"]) and (a["prediction_upper"] > a["prediction_lower"]).all()
    assert models.model_drift(back, df.withColumn("a", F.col("a") + 9)).first()["severity"] == "high"


def test_promoted_and_deleted_for_good(spark, linear, tmp_path):
    folder = str(tmp_path)
    old, new = replace(linear[1], model_id="old"), replace(linear[1], model_id="new")
    for m in (old, new):
        models.save_model(spark, m, folder)
    models.promote_stored(spark, folder, "new")
    models.promote_stored(spark, folder, "old")
    assert {r["model_id"]: r["is_champion"] for r in models.list_models(spark, folder).collect()} == {"old": True, "new": False}
    models.delete_model(spark, folder, "old")
    assert [r["model_id"] for r in models.list_models(spark, folder).collect()] == ["new"]
    assert [p.name for p in (tmp_path / "models").iterdir()] == ["new"]
    with pytest.raises(ValueError):
        models.load_model(spark, folder, "old")


def test_text_decides_the_label(spark):
    rng = np.random.default_rng(1)
    common = [f"word{i}" for i in range(30)]
    bad = rng.random(300) < 0.4
    texts = [" ".join([*rng.choice(common, 8), "refund broken" if b else "great thanks", f"n{i}"]) for i, b in enumerate(bad)]
    df = frame(spark, id=np.arange(300) * 7, x=rng.normal(size=300), note=texts, label=np.where(bad, "bad", "good"))
    m = train.train_supervised_model(df, "label", ["id"], model_type="logistic_regression")
    assert "note" in m.feature_cols and "note__text_0" in m.feature_names and m.evaluation["accuracy"] > 0.95
    lost = df.withColumn("note", F.lit(None).cast("string"))
    assert models.score_with_model(m, lost, ["id"]).where("prediction IS NULL").count() == 0


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_neighbours_train_store_and_score(spark, tmp_path, task):
    rng = np.random.default_rng(2)
    a = rng.normal(size=200)
    y = a * 2 if task == "regression" else np.where(a > 0, "up", "down")
    df = frame(spark, id=np.arange(200) * 7, a=a, y=y)
    m = train.train_supervised_model(df, "y", ["id"], ["a"], task_hint=task, model_type="knn")
    assert m.model_type == "knn" and (m.evaluation.get("accuracy") or 1 - m.evaluation["wmape"]) > 0.9
    models.save_model(spark, m, str(tmp_path))
    back = models.load_model(spark, str(tmp_path), m.model_id)
    both = [models.score_with_model(x, df, ["id"]).orderBy("id").toPandas()["prediction"].tolist() for x in (m, back)]
    assert both[0] == both[1] and len(both[0]) == 200


def test_imbalanced_classifier(spark):
    rng = np.random.default_rng(0)
    y = np.r_[np.zeros(260, int), np.ones(40, int)]
    df = frame(spark, id=np.arange(300) * 7, a=rng.normal(size=300) + 3 * y, b=rng.normal(size=300), label=np.where(y == 1, "yes", "no"))
    m = train.train_supervised_model(df, "label", ["id"], model_type="decision_tree")
    assert m.labels == ["no", "yes"] and m.evaluation["accuracy"] > 0.85 and m.platt is not None
    out = models.score_with_model(m, df, ["id"])
    assert {"thresholded", "prediction_set", "probability_yes"} <= set(out.columns)
    sides = train.split_train_test(df, ["id"], stratify="label").groupBy("label").agg(F.count_if("is_test").alias("n")).collect()
    assert {r["label"]: r["n"] for r in sides} == {"no": 52, "yes": 8}


def test_smote_balances_inside_the_minority(spark):
    rng = np.random.default_rng(0)
    v = [list(map(float, x)) for x in np.r_[rng.normal(0, 1, (60, 2)), rng.normal(8, 0.5, (10, 2))]]
    df = frame(spark, id=range(70), y=[0] * 60 + [1] * 10, v=v)
    made = np.array([r["v"] for r in train.smote(df, "y", "v", ["id"], "1").collect()])
    real = np.array(v[60:])
    assert made.shape == (50, 2) and (made >= real.min(0) - 1e-9).all() and (made <= real.max(0) + 1e-9).all()


def _holt(y, horizon):
    best = (math.inf, None)
    for a in forecast.ALPHAS:
        for b in forecast.BETAS:
            level, slope, sse = y[0], y[1] - y[0], 0.0
            for v in y[1:]:
                sse += (v - level - slope) ** 2
                new = a * v + (1 - a) * (level + slope)
                slope, level = b * (new - level) + (1 - b) * slope, new
            if sse < best[0]:
                best = (sse, [level + h * slope for h in range(1, horizon + 1)])
    return best[1]


@pytest.mark.parametrize("block", [7, 1000])
def test_holt_blocks_equal_one_sweep(spark, block):
    rng = np.random.default_rng(0)
    series = {"s": np.cumsum(rng.normal(size=90)) + 50, "t": np.linspace(0, 30, 31), "tiny": np.array([1.0, 3.0])}
    pdf = pd.concat([pd.DataFrame({"k": k, "ts": pd.date_range("2024-01-01", periods=len(y)), "y": y}) for k, y in series.items()])
    out = forecast.holt_forecast(spark.createDataFrame(pdf), "ts", "y", 3, ["k"], block_rows=block).orderBy("k", "step").toPandas()
    for k, y in series.items():
        want = _holt(y, 3) if len(y) >= 4 else [y.mean()] * 3
        assert np.allclose(out[out.k == k]["forecast"], want)


def test_temporal_model_rolls_forward(spark):
    n = 90
    pdf = pd.DataFrame({"id": np.arange(n) * 2, "date": pd.date_range("2024-01-01", periods=n).astype(str), "units": np.arange(n) % 7 * 1.0, "sales": np.arange(n) * 2.0 + 5})
    df = spark.createDataFrame(pdf)
    m = train.train_supervised_model(df, "sales", ["id"], ["date", "units"], model_type="linear_regression", task_hint="regression")
    assert m.lag_config and m.lag_config["lags"] == [1, 7]
    out = forecast.forecast_with_model(m, df, 6).orderBy("step").collect()
    assert [r["step"] for r in out] == [1, 2, 3, 4, 5, 6] and str(out[0]["date"]) == "2024-03-31"
    assert out[-1]["upper_90"] - out[-1]["lower_90"] > out[0]["upper_90"] - out[0]["lower_90"]
    verdict = forecast.forecast_holdout(m, df, 5).first()
    assert verdict["winner"] in ("ml", "holt") and verdict["holt_mae"] < 1e-6


# ---- sources ----


def test_normalize_and_formats(spark, tmp_path):
    df = spark.createDataFrame([("1", "x", 1.0), ("2", "y", float("inf"))], "` a\n` string, b string, c double")
    out = tables.normalize(df)
    assert out.columns == ["a", "b", "c"] and dict(out.dtypes)["a"] == "bigint"
    assert [r["c"] for r in out.orderBy("a").collect()] == [1.0, None]
    assert tables.detect_format("s3a://b/X.PARQUET?x=1") == "parquet" and tables.detect_format("http://h/a", "application/json") == "json"
    assert tables.detect_format("http://h/a.txt") == "csv"
    tables.write_scored_csv(out, str(tmp_path / "o"))
    assert tables.read_csv(spark, str(tmp_path / "o")).count() == 2


def test_dataset_registry(spark, tmp_path):
    store = datasets.Datasets(spark, str(tmp_path))
    a = store.register(frame(spark, x=[1, 2]), "first.csv")
    store.register(frame(spark, y=[1]), "second file.csv", make_active=False)
    assert store.meta()["dataset_id"] == a and spark.table("t").count() == 2
    assert list(store.views()) == ["second_file"]
    assert datasets.Datasets(spark, str(tmp_path)).active == a
    store.materialize_eda(a, ["x"])
    assert spark.read.parquet(f"{tmp_path}/eda_profile").count() == 1


def test_insights_are_ranked(spark):
    rng = np.random.default_rng(0)
    df = frame(spark, id=range(60), date=[f"2024-01-{1 + i % 28:02d}" for i in range(60)], a=rng.normal(size=60), k=rng.normal(size=60))
    df = df.withColumn("b", F.col("a") * 2)
    rows = insights.auto_insights(df, ["id"], trees=20).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert any(r["section"] == "relationships" and r["subject"] == "a ~ b" for r in rows)
