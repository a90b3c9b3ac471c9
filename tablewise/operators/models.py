"""Stored models, scoring with them, and retraining on drift."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import fields

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewise.functions.columns import half_up
from tablewise.operators import drift, features, scoring
from tablewise.operators.train import Trained, meta_json, predict, train_supervised_model
from tablewise.plans.shape import remove_path

META_SCHEMA = (
    "model_id string, dataset_id string, target_col string, model_type string, task_type string, created_at double, "
    "is_champion boolean, metric double, meta string"
)
EVENT_SCHEMA = "model_id string, event string, at double"


def _note(spark: SparkSession, folder: str, model_id: str, event: str) -> None:
    """The store is append-only: what happens to a model is one more row."""
    spark.createDataFrame([(model_id, event, time.time())], EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events")


def _metric(model: Trained) -> float | None:
    return model.evaluation.get("accuracy" if model.task_type == "classification" else "wmape")


def save_model(spark: SparkSession, model: Trained, folder: str) -> str:
    """Pipeline under ``folder/models`` and one metadata row appended to ``folder/meta``."""
    model.pipeline.write().overwrite().save(f"{folder}/models/{model.model_id}")
    metric = _metric(model)
    row = (
        model.model_id, model.dataset_id, model.target_col, model.model_type, model.task_type, float(model.created_at),
        model.is_champion, None if metric is None else float(metric), meta_json(model),
    )
    spark.createDataFrame([row], META_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/meta")
    _note(spark, folder, model.model_id, "saved")
    return model.model_id


def list_models(spark: SparkSession, folder: str) -> DataFrame:
    """Stored models, newest first. The one promoted last is the champion of its (dataset, target)."""
    events = spark.read.schema(EVENT_SCHEMA).parquet(f"{folder}/events").groupBy("model_id").agg(
        F.bool_or(F.col("event") == "deleted").alias("_gone"),
        F.max(F.when(F.col("event") == "promoted", F.col("at"))).alias("_promoted"),
    )
    rows = spark.read.schema(META_SCHEMA).parquet(f"{folder}/meta").join(events, "model_id").where("NOT _gone")
    last = F.max("_promoted").over(Window.partitionBy("dataset_id", "target_col"))
    champion = F.when(last.isNotNull(), F.coalesce(F.col("_promoted") == last, F.lit(False))).otherwise(F.col("is_champion"))
    names = [f.strip().split(" ")[0] for f in META_SCHEMA.split(",")]
    return rows.withColumn("is_champion", champion).select(*names).orderBy(F.col("created_at").desc(), "model_id")


def _known(spark: SparkSession, folder: str, model_id: str) -> None:
    if list_models(spark, folder).where(F.col("model_id") == model_id).isEmpty():
        raise ValueError(f"unknown model {model_id}")


def load_model(spark: SparkSession, folder: str, model_id: str) -> Trained:
    row = list_models(spark, folder).where(F.col("model_id") == model_id).first()
    if row is None:
        raise ValueError(f"unknown model {model_id}")
    meta = json.loads(row["meta"])
    known = {f.name for f in fields(Trained)}
    pipeline = PipelineModel.load(f"{folder}/models/{model_id}")
    return Trained(pipeline=pipeline, **{k: v for k, v in meta.items() if k in known and k != "pipeline"})


def delete_model(spark: SparkSession, folder: str, model_id: str) -> DataFrame:
    """Removes the model's files and takes it off the list; returns the models that remain."""
    _known(spark, folder, model_id)
    _note(spark, folder, model_id, "deleted")
    remove_path(spark, f"{folder}/models/{model_id}")
    return list_models(spark, folder)


def evaluate_trained_model(spark: SparkSession, model: Trained, df: DataFrame | None = None) -> DataFrame:
    """Stored evaluation; with a table, the missing features are reported as well."""
    rows = [("metric", k, float(v)) for k, v in model.evaluation.items() if isinstance(v, (int, float))]
    if df is not None:
        rows += [("missing_feature", c, None) for c in model.feature_cols if c not in df.columns and "__" not in c]
    return spark.createDataFrame(rows, "item string, name string, value double")


# ---- scoring ----


def with_lags(model: Trained, df: DataFrame, key: Sequence[str]) -> DataFrame:
    c = model.lag_config
    if not c:
        return df
    return features.lag_features(df, c["sort_col"], c["lag_cols"], c["lags"], c["windows"], c.get("series") or (), key)


def score_with_model(model: Trained, df: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows with prediction, interval or probability, tuned label and prediction set."""
    out = predict(model, with_lags(model, df, key))
    if model.task_type == "regression":
        if model.conformal_halfwidth is None:
            return out
        return scoring.prediction_intervals(out, "prediction", model.conformal_halfwidth, model.log_target)
    columns = {v: f"probability_{v}" for v in model.labels}
    out = out.withColumns({columns[v]: F.col("probability")[i] for i, v in enumerate(model.labels)}).drop("probability")
    if model.optimal_threshold is not None and len(model.labels) == 2:
        out = scoring.apply_threshold(out, columns[model.labels[1]], model.optimal_threshold, tuple(model.labels), "thresholded")
    if model.conformal_q is not None:
        out = scoring.prediction_sets(out, columns, model.conformal_q)
    return out


def stats_frame(spark: SparkSession, model: Trained) -> DataFrame:
    rows = [tuple(s.get(f.strip().split(" ")[0]) for f in _stat_fields()) for s in model.training_stats]
    return spark.createDataFrame(rows, drift.STATS_SCHEMA)


def _stat_fields() -> list[str]:
    return [
        "feature", "type", "mean", "std", "min", "max", "p5", "p95", "missing_rate", "quantile_bins", "top_categories", "n_unique",
    ]


def model_drift(model: Trained, df: DataFrame) -> DataFrame:
    """Drifted features of a scoring table against the model's training statistics."""
    return drift.check_drift(df, stats_frame(df.sparkSession, model))


def retrain_on_drift(
    model: Trained, scoring_rows: DataFrame, training_rows: DataFrame, key: Sequence[str], folder: str | None = None, **train_args
) -> DataFrame:
    """One row: whether drift was high, and how a retrained model compares.

    The better model (higher accuracy, lower WMAPE) is promoted: with ``folder`` the retrained one
    is saved there and the better of the two becomes the stored champion; ``model`` must be stored there.
    """
    spark = scoring_rows.sparkSession
    schema = "severity string, retrained boolean, old_metric double, new_metric double, promoted string, new_model_id string"
    severity = drift.drift_summary(scoring_rows, stats_frame(spark, model)).first()["overall_severity"]
    old = _metric(model)
    if severity != "high":
        return spark.createDataFrame([(severity, False, old, None, model.model_id, None)], schema)
    train_args.setdefault("model_type", model.model_type)
    fresh = train_supervised_model(training_rows, model.target_col, key, dataset_id=model.dataset_id, **train_args)
    new = _metric(fresh)
    better = new is not None and (old is None or (new > old if model.task_type == "classification" else new < old))
    if folder is not None:
        save_model(spark, fresh, folder)
        promote_stored(spark, folder, fresh.model_id if better else model.model_id)
    return spark.createDataFrame(
        [(severity, True, half_up(old, 6), half_up(new, 6), fresh.model_id if better else model.model_id, fresh.model_id)], schema
    )


def promote_stored(spark: SparkSession, folder: str, model_id: str) -> DataFrame:
    """Makes the model the champion of its (dataset, target) for good; returns all models."""
    _known(spark, folder, model_id)
    _note(spark, folder, model_id, "promoted")
    return list_models(spark, folder)
