"""Analytics over append-only log tables and the registry of models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.columns import ratio, ref, require_columns
from tablewise.plans.shape import long_form

# Fixed window lengths and limits.
LAST_RECORDS = 200
LAST_FALLBACKS = 500
MAX_KEYS = 50
MAX_CONVERSATIONS = 200
MAX_TURNS = 20
HISTORY_TURNS = 6
TTL_DAYS = 7
MODEL_CAP = 10
LOW_SCORE = 3
STATUSES = ("judged", "not_sampled", "rule_based", "llm_disabled", "failed")


def last_records(df: DataFrame, order: Sequence[str], n: int = LAST_RECORDS) -> DataFrame:
    """Newest n rows by ``order`` (time first, key last)."""
    require_columns(df, *order)
    return df.orderBy(*[ref(o).desc() for o in order]).limit(n)


# ---- scores and calls ----


def daily_scores(df: DataFrame, ts: Column, score: Column) -> DataFrame:
    day = F.to_date(ts).alias("day")
    return df.groupBy(day).agg(
        F.round(F.avg(score), 2).alias("avg_score"),
        F.count("*").alias("n"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
    )


def quality_trend(df: DataFrame, now: Column | None = None, days: int = 30, ts: str = "timestamp", score: str = "score") -> DataFrame:
    """Scores per UTC day of the last days, oldest first."""
    now = now if now is not None else F.current_timestamp()
    recent = df.where(ref(ts) > now - F.make_dt_interval(F.lit(days)))
    return daily_scores(recent, ref(ts), ref(score)).orderBy("day")


def judge_snapshot(
    df: DataFrame, order: Sequence[str], score: str = "score", issues: str = "issue_count", status: str = "status"
) -> DataFrame:
    """One row: the last scores and the counts of every status over all rows."""
    judged = last_records(df.where(ref(status) == "judged"), order)
    scores = judged.agg(
        F.count("*").alias("sampled_count"),
        F.coalesce(F.round(F.avg(score), 2), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.round(ratio(F.count_if(ref(score) <= LOW_SCORE), F.count("*")), 4), F.lit(0.0)).alias("low_score_rate"),
        F.coalesce(F.round(ratio(F.count_if(ref(issues) > 0), F.count("*")), 4), F.lit(0.0)).alias("flagged_rate"),
        F.lit(1).alias("_one"),
    )
    by_status = df.agg(*[F.count_if(ref(status) == s).alias(s) for s in STATUSES], F.lit(1).alias("_one"))
    return scores.join(by_status, "_one").select(
        (F.col("judged") + F.col("not_sampled") + F.col("rule_based") + F.col("llm_disabled") + F.col("failed")).alias(
            "response_count"
        ),
        (F.col("judged") + F.col("not_sampled") + F.col("failed")).alias("eligible_count"),
        (F.col("judged") + F.col("failed")).alias("attempted_count"),
        "sampled_count",
        (F.col("not_sampled") + F.col("rule_based") + F.col("llm_disabled")).alias("skipped_count"),
        F.col("failed").alias("error_count"),
        "avg_score",
        "low_score_rate",
        "flagged_rate",
    )


def call_metrics(
    df: DataFrame,
    order: Sequence[str],
    operation: str = "operation",
    ok: str = "ok",
    latency: str = "latency_ms",
    tokens: str = "total_tokens",
) -> DataFrame:
    """Last calls per operation and together (operation ``__all__``)."""
    rows = last_records(df, order)
    per = rows.groupBy(ref(operation).alias("operation")).agg(
        F.count("*").alias("count"),
        F.count_if(~ref(ok)).alias("errors"),
        F.sum(latency).alias("_ms"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("total_tokens"),
    )
    whole = per.agg(F.lit("__all__").alias("operation"), *[F.sum(c).alias(c) for c in ("count", "errors", "_ms", "total_tokens")])
    return per.unionByName(whole.where(F.col("count").isNotNull())).select(
        "operation",
        "count",
        "errors",
        F.round(F.col("errors") / F.col("count"), 4).alias("error_rate"),
        F.round(F.col("_ms") / F.col("count"), 2).alias("avg_latency_ms"),
        "total_tokens",
    )


def repair_stats(
    df: DataFrame, order: Sequence[str], problems: str = "n_problems_in", fixed: str = "n_fixed", dropped: str = "n_dropped"
) -> DataFrame:
    rows = last_records(df, order)
    return rows.agg(
        F.count("*").alias("repair_attempts"),
        F.coalesce(F.sum(problems), F.lit(0)).alias("total_problems"),
        F.coalesce(F.sum(fixed), F.lit(0)).alias("total_fixed"),
        F.coalesce(F.sum(dropped), F.lit(0)).alias("total_dropped"),
        F.coalesce(F.round(ratio(F.sum(fixed), F.sum(problems)), 4), F.lit(0.0)).alias("fix_rate"),
    )


def count_by_reason(df: DataFrame, order: Sequence[str], reason: str = "reason") -> DataFrame:
    rows = last_records(df, order, LAST_FALLBACKS)
    return rows.groupBy(ref(reason).alias("reason")).agg(F.count("*").alias("count"))


# ---- latency ----


def _picked(values: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and index-picked percentiles of groups of at most ``LAST_RECORDS`` rows each."""
    by = [ref(k) for k in keys]
    ranked = values.select(
        *by,
        "value",
        (F.row_number().over(Window.partitionBy(*by).orderBy("value")) - 1).alias("i"),
        F.count("*").over(Window.partitionBy(*by)).alias("n"),
    )
    at50, at95 = F.floor(F.col("n") * 0.5), F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(F.avg("value"), 1).alias("avg_ms"),
        F.max(F.when(F.col("i") == at50, F.col("value"))).alias("p50_ms"),
        F.max(F.when(F.col("i") == at95, F.col("value"))).alias("p95_ms"),
    )


def latency_snapshot(df: DataFrame, order: Sequence[str], phases: Sequence[str]) -> DataFrame:
    """Per phase column and their sum (``t_total``) over the last turns."""
    rows = last_records(df, order)
    values = {p: F.round(ref(p), 1) for p in phases}
    total = ref(phases[0])
    for p in phases[1:]:
        total = total + ref(p)
    values["t_total"] = F.round(total, 1)
    return _picked(long_form(rows, values).withColumnRenamed("column", "phase"), ["phase"])


def latency_by_key(df: DataFrame, key: str, order: Sequence[str], latency: str = "latency_ms") -> DataFrame:
    """Last records of each key, for the keys that were used most recently."""
    require_columns(df, key, latency, *order)
    recent = F.struct(*[ref(o) for o in order])
    keys = df.groupBy(ref(key).alias("key")).agg(F.max(recent).alias("_last")).orderBy(F.col("_last").desc()).limit(MAX_KEYS)
    rows = df.select(ref(key).alias("key"), F.round(ref(latency), 1).alias("value"), *[ref(o).alias(f"_o{i}") for i, o in enumerate(order)])
    newest = Window.partitionBy("key").orderBy(*[F.col(f"_o{i}").desc() for i in range(len(order))])
    last = rows.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= LAST_RECORDS)
    return _picked(last.join(F.broadcast(keys.select("key")), "key", "left_semi"), ["key"])  # at most MAX_KEYS keys


# ---- feedback and conversations ----


def feedback_stats(df: DataFrame, rating: str = "rating") -> DataFrame:
    up = F.count_if(ref(rating) == "up")
    return df.agg(
        F.count("*").alias("total"),
        up.alias("up"),
        F.count_if(ref(rating) == "down").alias("down"),
        F.coalesce(F.round(ratio(up, F.count("*")), 3), F.lit(0.0)).alias("up_rate"),
    )


def negative_feedback(df: DataFrame, order: Sequence[str], limit: int = 50, rating: str = "rating") -> DataFrame:
    return last_records(df.where(ref(rating) == "down"), order, limit)


def promote_feedback(feedback: DataFrame, turns: DataFrame) -> DataFrame:
    """Thumbs-down entries with their assistant turn and the user turn right before it.

    ``feedback``: feedback_id, conversation_id, turn_idx, rating, comment.
    ``turns``: conversation_id, turn_idx, role, content. Two joins on (conversation, turn), so
    one long conversation is spread over its turns.
    """
    down = feedback.where("rating = 'down'").select("feedback_id", "conversation_id", "turn_idx", "comment")
    said = turns.where("role = 'assistant'").select("conversation_id", "turn_idx", F.col("content").alias("assistant_message"))
    asked = turns.where("role = 'user'").select(
        "conversation_id", (F.col("turn_idx") + 1).alias("turn_idx"), F.col("content").alias("user_message")
    )
    out = down.join(said, ["conversation_id", "turn_idx"], "left").join(asked, ["conversation_id", "turn_idx"], "left")
    return out.select(
        "feedback_id",
        "conversation_id",
        "turn_idx",
        F.when(F.col("assistant_message").isNotNull(), F.col("user_message")).alias("user_message"),
        "assistant_message",
        "comment",
        F.lit(None).cast("string").alias("expected_tool"),
    )


TURNS_JSON = (
    "conversation_id string, turns array<struct<role:string,content:string,dataset_id:string,timestamp:double>>"
)


def conversation_turns(df: DataFrame, data: str = "data") -> DataFrame:
    """Turns of stored JSON conversations: ``conversation_id, turn_idx, role, content, dataset_id, timestamp``."""
    parsed = df.select(F.from_json(ref(data), TURNS_JSON).alias("c")).where("c IS NOT NULL")
    return parsed.select("c.conversation_id", F.posexplode("c.turns").alias("turn_idx", "t")).select(
        F.coalesce("conversation_id", F.lit("unknown")).alias("conversation_id"), "turn_idx", "t.*"
    )


def sample_turns(df: DataFrame, n: int, now: float, max_age_days: float, data: str = "data", updated: str = "updated_at") -> DataFrame:
    """Freshest assistant turns with text among the newest conversations."""
    recent = df.where(ref(updated) > now - max_age_days * 86_400).orderBy(ref(updated).desc()).limit(MAX_CONVERSATIONS)
    turns = conversation_turns(recent, data).where("role = 'assistant'").where(F.trim(F.coalesce("content", F.lit(""))) != "")
    stamp = F.coalesce("timestamp", F.lit(0.0))
    return (
        turns.withColumn("timestamp", stamp)
        .orderBy(F.col("timestamp").desc(), "conversation_id", F.col("turn_idx").desc())
        .limit(n)
        .select("conversation_id", "turn_idx", "content", "dataset_id", "timestamp")
    )


def recent_history(turns: DataFrame, n: int = HISTORY_TURNS, conversation: str = "conversation_id", turn: str = "turn_idx") -> DataFrame:
    """Last n turns of every conversation."""
    newest = Window.partitionBy(ref(conversation)).orderBy(ref(turn).desc())
    return turns.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")


def capped_turns(turns: DataFrame, conversation: str = "conversation_id", turn: str = "turn_idx") -> DataFrame:
    return recent_history(turns, MAX_TURNS, conversation, turn)


def drop_expired(df: DataFrame, now: Column, updated: str, days: int = TTL_DAYS) -> DataFrame:
    return df.where(ref(updated) >= now - F.make_dt_interval(F.lit(days)))


def latest_result_per_tool(df: DataFrame, order: Sequence[str], conversation: str, tool: str, ok: str, result: str) -> DataFrame:
    """Last successful result of each tool in each conversation, by one aggregate."""
    place = F.struct(*[ref(o) for o in order])
    return (
        df.where(ref(ok))
        .groupBy(ref(conversation).alias("conversation_id"), ref(tool).alias("tool"))
        .agg(F.max_by(ref(result), place).alias("result"))
    )


# ---- runs and models ----


def list_runs(
    df: DataFrame,
    dataset_id: str | None = None,
    target_col: str | None = None,
    model_type: str | None = None,
    limit: int = 100,
    metrics_schema: str | None = None,
    order: Sequence[str] = ("created_at", "run_id"),
) -> DataFrame:
    """Newest runs that match, metrics JSON parsed when a schema is given."""
    for name, value in (("dataset_id", dataset_id), ("target_col", target_col), ("model_type", model_type)):
        if value is not None:
            df = df.where(ref(name) == value)
    out = last_records(df, order, limit)
    return out.withColumn("metrics", F.from_json("metrics", metrics_schema)) if metrics_schema else out


def run_history(df: DataFrame, limit: int = 20, order: Sequence[str] = ("created_at", "run_id")) -> DataFrame:
    return last_records(df, order, limit)


def promote(models: DataFrame, model_id: str) -> DataFrame:
    """Registry with ``model_id`` as the one champion of its (dataset, target)."""
    row = models.where(F.col("model_id") == model_id).select("dataset_id", "target_col").first()
    if row is None:
        raise ValueError(f"unknown model {model_id}")
    same = F.col("dataset_id").eqNullSafe(F.lit(row["dataset_id"])) & (F.col("target_col") == row["target_col"])
    return models.withColumn("is_champion", F.when(same, F.col("model_id") == model_id).otherwise(F.col("is_champion")))


def champions(models: DataFrame) -> DataFrame:
    """Champion of every (dataset, target); the newest model where none is promoted."""
    return models.groupBy("dataset_id", "target_col").agg(
        F.max_by("model_id", F.struct("is_champion", "created_at", "model_id")).alias("model_id")
    )


def retain_latest(models: DataFrame, cap: int = MODEL_CAP) -> DataFrame:
    """Newest models of every (dataset, target)."""
    newest = Window.partitionBy("dataset_id", "target_col").orderBy(F.col("created_at").desc(), F.col("model_id").desc())
    return models.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= cap).drop("_r")


def find_previous(models: DataFrame) -> DataFrame:
    """Newest stored model of every (dataset, target)."""
    return models.groupBy("dataset_id", "target_col").agg(
        F.max_by("model_id", F.struct("created_at", "model_id")).alias("model_id"),
        F.max_by("metric", F.struct("created_at", "model_id")).alias("metric"),
    )


def compare_to_previous(models: DataFrame, new: DataFrame, lower_is_better: bool = False) -> DataFrame:
    """``dataset_id, target_col, previous_id, previous_metric, metric, delta, improved`` of new models."""
    prev = find_previous(models).select(
        "dataset_id", "target_col", F.col("model_id").alias("previous_id"), F.col("metric").alias("previous_metric")
    )
    gain = F.col("previous_metric") - F.col("metric") if lower_is_better else F.col("metric") - F.col("previous_metric")
    return new.select("dataset_id", "target_col", "metric").join(prev, ["dataset_id", "target_col"]).select(
        "dataset_id", "target_col", "previous_id", "previous_metric", "metric", F.round(gain, 4).alias("delta"),
        (gain > 0).alias("improved"),
    )

