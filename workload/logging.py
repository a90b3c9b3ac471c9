"""Log analytics: events and conversations stand in for the log tables."""

from pyspark.sql import functions as F

from tablewise.operators import logs
from workload.registry import query

_ORDER = ["ts", "event_id"]

_JUDGE = """WITH j AS (SELECT event_id, ts, (1 + (event_id * 7) % 5)::INT AS score, (event_id % 3)::INT AS issue_count,
  CASE event_type WHEN 'click' THEN 'judged' WHEN 'view' THEN 'not_sampled' WHEN 'purchase' THEN 'rule_based' WHEN 'signup' THEN 'llm_disabled' ELSE 'failed' END AS status FROM events)"""


def judge_log(t):
    kind = F.col("event_type")
    status = (
        F.when(kind == "click", "judged").when(kind == "view", "not_sampled").when(kind == "purchase", "rule_based").when(kind == "signup", "llm_disabled").otherwise("failed")
    )
    return t.events.select(
        "event_id", "ts", (1 + F.pmod(F.col("event_id") * 7, F.lit(5))).cast("int").alias("score"),
        F.pmod("event_id", F.lit(3)).cast("int").alias("issue_count"), status.alias("status"),
    )


@query(
    "quality_trend_days",
    _JUDGE
    + """ SELECT ts::DATE::VARCHAR AS day, round(avg(score), 2) AS avg_score, count(*) AS n, min(score) AS min_score, max(score) AS max_score FROM j
    WHERE ts > (SELECT max(ts) FROM j) - INTERVAL 20 DAY GROUP BY 1""",
)
def _(t):
    log = judge_log(t)
    newest = log.agg(F.max("ts").alias("m")).first()["m"]
    return logs.quality_trend(log, F.lit(newest), 20, ts="ts").withColumn("day", F.col("day").cast("string"))


@query(
    "judge_snapshot_events",
    _JUDGE
    + """, l AS (SELECT * FROM j WHERE status = 'judged' ORDER BY ts DESC, event_id DESC LIMIT 200), s AS (SELECT count(*) FILTER (WHERE status = 'judged') AS a,
      count(*) FILTER (WHERE status = 'not_sampled') AS b, count(*) FILTER (WHERE status = 'rule_based') AS c, count(*) FILTER (WHERE status = 'llm_disabled') AS d, count(*) FILTER (WHERE status = 'failed') AS e FROM j)
    SELECT a + b + c + d + e AS response_count, a + b + e AS eligible_count, a + e AS attempted_count, (SELECT count(*) FROM l) AS sampled_count, b + c + d AS skipped_count, e AS error_count,
      (SELECT round(avg(score), 2) FROM l) AS avg_score, (SELECT round(avg((score <= 3)::INT), 4) FROM l) AS low_score_rate, (SELECT round(avg((issue_count > 0)::INT), 4) FROM l) AS flagged_rate FROM s""",
)
def _(t):
    return logs.judge_snapshot(judge_log(t), _ORDER)


def call_log(t):
    return t.events.select(
        "event_id", "ts", F.col("event_type").alias("operation"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"),
        F.col("user_id").alias("total_tokens"),
    )


@query(
    "call_metrics_events",
    """WITH l AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200), g AS (SELECT event_type AS operation, count(*) AS count, count(*) FILTER (WHERE event_type = 'error') AS errors,
      sum(value) AS ms, sum(user_id)::BIGINT AS total_tokens FROM l GROUP BY 1 UNION ALL SELECT '__all__', count(*), count(*) FILTER (WHERE event_type = 'error'), sum(value), sum(user_id)::BIGINT FROM l)
    SELECT operation, count, errors, round(errors::DOUBLE / count, 4) AS error_rate, round(ms / count, 2) AS avg_latency_ms, total_tokens FROM g""",
)
def _(t):
    return logs.call_metrics(call_log(t), _ORDER)


@query(
    "repair_stats_events",
    """WITH l AS (SELECT event_id % 4 AS p, event_id % 3 AS f, event_id % 2 AS d FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200))
    SELECT count(*) AS repair_attempts, sum(p)::BIGINT AS total_problems, sum(f)::BIGINT AS total_fixed, sum(d)::BIGINT AS total_dropped, round(sum(f)::DOUBLE / sum(p), 4) AS fix_rate FROM l""",
)
def _(t):
    log = t.events.select(
        "event_id", "ts", F.pmod("event_id", F.lit(4)).alias("n_problems_in"), F.pmod("event_id", F.lit(3)).alias("n_fixed"), F.pmod("event_id", F.lit(2)).alias("n_dropped")
    )
    return logs.repair_stats(log, _ORDER)


@query(
    "fallbacks_by_reason",
    "SELECT event_type AS reason, count(*) AS count FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) GROUP BY 1",
)
def _(t):
    return logs.count_by_reason(t.events.select("event_id", "ts", F.col("event_type").alias("reason")), _ORDER)


_PHASES = """WITH l AS (SELECT round(value, 1) AS t_plan, round(value * 2, 1) AS t_execute, round(value + user_id, 1) AS t_synthesis, round(value + value * 2 + (value + user_id), 1) AS t_total
  FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)), v AS ("""


@query(
    "latency_snapshot_phases",
    _PHASES
    + " UNION ALL ".join(f"SELECT '{p}' AS phase, {p} AS v FROM l" for p in ("t_plan", "t_execute", "t_synthesis", "t_total"))
    + """), r AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY phase) AS n FROM v)
    SELECT phase, count(*) AS n, round(avg(v), 1) AS avg_ms, max(v) FILTER (WHERE i = floor(n * 0.5)) AS p50_ms, max(v) FILTER (WHERE i = least(floor(n * 0.95), n - 1)) AS p95_ms FROM r GROUP BY phase""",
)
def _(t):
    log = t.events.select(
        "event_id", "ts", F.col("value").alias("t_plan"), (F.col("value") * 2).alias("t_execute"), (F.col("value") + F.col("user_id")).alias("t_synthesis")
    )
    return logs.latency_snapshot(log, _ORDER, ["t_plan", "t_execute", "t_synthesis"])


@query(
    "latency_by_user",
    """WITH k AS (SELECT user_id FROM (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS q FROM events) WHERE q = 1 ORDER BY ts DESC, event_id DESC LIMIT 50),
    l AS (SELECT user_id AS key, round(value, 1) AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS q FROM events) WHERE q <= 200 AND user_id IN (SELECT user_id FROM k)),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM l)
    SELECT key, count(*) AS n, round(avg(v), 1) AS avg_ms, max(v) FILTER (WHERE i = floor(n * 0.5)) AS p50_ms, max(v) FILTER (WHERE i = least(floor(n * 0.95), n - 1)) AS p95_ms FROM r GROUP BY key""",
)
def _(t):
    return logs.latency_by_key(t.events, "user_id", _ORDER, "value")


_FEEDBACK = """WITH f AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'signup' THEN 'up' WHEN 'error' THEN 'down' END AS rating FROM events WHERE event_type IN ('signup', 'error'))"""


def feedback(t):
    rows = t.events.where(F.col("event_type").isin("signup", "error"))
    return rows.select("event_id", "ts", "user_id", F.when(F.col("event_type") == "signup", "up").otherwise("down").alias("rating"))


@query(
    "feedback_stats_events",
    _FEEDBACK
    + " SELECT count(*) AS total, count(*) FILTER (WHERE rating = 'up') AS up, count(*) FILTER (WHERE rating = 'down') AS down, round(avg((rating = 'up')::INT), 3) AS up_rate FROM f",
)
def _(t):
    return logs.feedback_stats(feedback(t))


@query(
    "negative_feedback_newest",
    _FEEDBACK + " SELECT event_id, user_id, rating FROM f WHERE rating = 'down' ORDER BY ts DESC, event_id DESC LIMIT 50",
)
def _(t):
    return logs.negative_feedback(feedback(t), _ORDER).select("event_id", "user_id", "rating")


@query(
    "promote_feedback_turns",
    """SELECT event_id AS feedback_id, c.conv_id AS conversation_id, c.turn AS turn_idx, CASE WHEN p.role = 'user' AND c.role = 'assistant' THEN p.text END AS user_message,
      CASE WHEN c.role = 'assistant' THEN c.text END AS assistant_message, 'k' || (event_id % 10) AS comment, NULL::VARCHAR AS expected_tool
    FROM events e JOIN conversations c ON c.conv_id = e.event_id % (SELECT max(conv_id) + 1 FROM conversations) AND c.turn = e.user_id % 6
    LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 WHERE e.event_type = 'error'""",
)
def _(t):
    span = t.conversations.agg((F.max("conv_id") + 1).alias("m")).first()["m"]
    votes = t.events.where("event_type = 'error'").select(
        F.col("event_id").alias("feedback_id"), F.pmod("event_id", F.lit(span)).alias("conversation_id"), F.pmod("user_id", F.lit(6)).alias("turn_idx"),
        F.lit("down").alias("rating"), F.concat(F.lit("k"), F.pmod("event_id", F.lit(10))).alias("comment"),
    )
    turns = t.conversations.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("turn_idx"), "role", F.col("text").alias("content"))
    known = votes.join(turns.select("conversation_id", "turn_idx"), ["conversation_id", "turn_idx"], "left_semi")
    return logs.promote_feedback(known, turns)


@query(
    "sample_turns_newest",
    """WITH r AS (SELECT * FROM conversations WHERE conv_id * 1000 + turn > (SELECT max(conv_id * 1000 + turn) FROM conversations) - 86400 * 30 ORDER BY conv_id * 1000 + turn DESC LIMIT 200)
    SELECT conv_id::VARCHAR AS conversation_id, 0 AS turn_idx, text AS content, NULL::VARCHAR AS dataset_id, (conv_id * 1000 + turn)::DOUBLE AS timestamp FROM r WHERE role = 'assistant' AND trim(text) <> '' ORDER BY timestamp DESC LIMIT 20""",
)
def _(t):
    stamp = (F.col("conv_id") * 1000 + F.col("turn")).cast("double")
    turn = F.struct("role", F.col("text").alias("content"), stamp.alias("timestamp"))
    blobs = t.conversations.select(
        F.to_json(F.struct(F.col("conv_id").cast("string").alias("conversation_id"), F.array(turn).alias("turns"))).alias("data"), stamp.alias("updated_at")
    )
    now = blobs.agg(F.max("updated_at").alias("m")).first()["m"]
    return logs.sample_turns(blobs, 20, now, 30)


@query(
    "recent_history_turns",
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6",
)
def _(t):
    return logs.recent_history(t.conversations, conversation="conv_id", turn="turn").select("conv_id", "turn", "role")


@query(
    "capped_turns_conversations",
    "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 20",
)
def _(t):
    return logs.capped_turns(t.conversations, "conv_id", "turn").select("conv_id", "turn")


@query(
    "drop_expired_events",
    "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
)
def _(t):
    newest = t.events.agg(F.max("ts").alias("m")).first()["m"]
    return logs.drop_expired(t.events, F.lit(newest), "ts").select("event_id")


@query(
    "latest_result_per_tool",
    """SELECT user_id AS conversation_id, event_type AS tool, value AS result FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value > 20) WHERE r = 1""",
)
def _(t):
    return logs.latest_result_per_tool(t.events.withColumn("ok", F.col("value") > 20), _ORDER, "user_id", "event_type", "ok", "value")


_RUNS = "SELECT event_id AS run_id, ts AS created_at, event_type AS dataset_id, 't' || (user_id % 10) AS target_col, CASE WHEN event_id % 2 = 0 THEN 'linear' ELSE 'forest' END AS model_type, props AS metrics, value FROM events"


def runs(t):
    return t.events.select(
        F.col("event_id").alias("run_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("dataset_id"),
        F.concat(F.lit("t"), F.pmod("user_id", F.lit(10))).alias("target_col"), F.when(F.pmod("event_id", F.lit(2)) == 0, "linear").otherwise("forest").alias("model_type"),
        F.col("props").alias("metrics"), "value",
    )


@query(
    "list_runs_filtered",
    f"SELECT run_id, dataset_id, target_col, model_type, CAST(metrics->>'$.k' AS INT) AS k FROM ({_RUNS}) WHERE dataset_id = 'purchase' AND model_type = 'linear' ORDER BY created_at DESC, run_id DESC LIMIT 100",
)
def _(t):
    out = logs.list_runs(runs(t), dataset_id="purchase", model_type="linear", metrics_schema="k int")
    return out.select("run_id", "dataset_id", "target_col", "model_type", F.col("metrics.k").alias("k"))


@query("run_history_newest", f"SELECT run_id, dataset_id FROM ({_RUNS}) ORDER BY created_at DESC, run_id DESC LIMIT 20")
def _(t):
    return logs.run_history(runs(t)).select("run_id", "dataset_id")


def models(t):
    r = runs(t)
    return r.select(F.col("run_id").alias("model_id"), "dataset_id", "target_col", "created_at", F.col("value").alias("metric"), (F.pmod("run_id", F.lit(97)) == 0).alias("is_champion"))


_MODELS = f"WITH m AS (SELECT run_id AS model_id, dataset_id, target_col, created_at, value AS metric, run_id % 97 = 0 AS is_champion FROM ({_RUNS}))"


@query(
    "promote_champion",
    _MODELS
    + """, p AS (SELECT dataset_id, target_col, model_id FROM m WHERE model_id = (SELECT min(model_id) FROM m WHERE dataset_id = 'click'))
    SELECT m.model_id, CASE WHEN m.dataset_id = p.dataset_id AND m.target_col = p.target_col THEN m.model_id = p.model_id ELSE is_champion END AS is_champion FROM m, p""",
)
def _(t):
    m = models(t)
    first = m.where("dataset_id = 'click'").agg(F.min("model_id").alias("i")).first()["i"]
    return logs.promote(m, first).select("model_id", "is_champion")


@query(
    "champion_per_target",
    _MODELS
    + " SELECT dataset_id, target_col, model_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, target_col ORDER BY is_champion DESC, created_at DESC, model_id DESC) AS r FROM m) WHERE r = 1",
)
def _(t):
    return logs.champions(models(t))


@query(
    "retain_latest_models",
    _MODELS
    + " SELECT dataset_id, target_col, model_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, target_col ORDER BY created_at DESC, model_id DESC) AS r FROM m) WHERE r <= 10",
)
def _(t):
    return logs.retain_latest(models(t)).select("dataset_id", "target_col", "model_id")


@query(
    "find_previous_model",
    _MODELS
    + " SELECT dataset_id, target_col, model_id, metric FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, target_col ORDER BY created_at DESC, model_id DESC) AS r FROM m) WHERE r = 1",
)
def _(t):
    return logs.find_previous(models(t))


@query(
    "compare_to_previous_model",
    _MODELS
    + """, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, target_col ORDER BY created_at DESC, model_id DESC) AS r FROM m) WHERE r = 1),
    n AS (SELECT dataset_id, target_col, round(avg(metric), 4) AS metric FROM m GROUP BY ALL)
    SELECT dataset_id, target_col, p.model_id AS previous_id, p.metric AS previous_metric, n.metric AS metric, round(n.metric - p.metric, 4) AS delta, n.metric - p.metric > 0 AS improved FROM n JOIN p USING (dataset_id, target_col)""",
)
def _(t):
    m = models(t)
    new = m.groupBy("dataset_id", "target_col").agg(F.round(F.avg("metric"), 4).alias("metric"))
    return logs.compare_to_previous(m, new)
