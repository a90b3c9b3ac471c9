"""Log analytics over streams: the same measures with watermarks and windows.

Each function turns a streaming log into a streaming aggregate. Every batch writes one parquet
version, so a restarted query repeats a version instead of adding rows: ``into_updates`` the
windows a batch changed, ``into_table`` the whole of a result of few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tablewise.functions.columns import ratio, ref

WATERMARK = "2 days"


def read_log(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def daily_quality(log: DataFrame, ts: str = "timestamp", score: str = "score", watermark: str = WATERMARK) -> DataFrame:
    timed = log.withColumn("_ts", ref(ts).cast("timestamp")).withWatermark("_ts", watermark)
    return (
        timed.groupBy(F.window("_ts", "1 day"))
        .agg(
            F.round(F.avg(ref(score)), 2).alias("avg_score"),
            F.count("*").alias("n"),
            F.min(ref(score)).alias("min_score"),
            F.max(ref(score)).alias("max_score"),
        )
        .select(F.to_date("window.start").alias("day"), "avg_score", "n", "min_score", "max_score")
    )


def windowed_calls(
    log: DataFrame, ts: str, operation: str, ok: str, latency: str, window: str = "1 hour", watermark: str = WATERMARK
) -> DataFrame:
    timed = log.withColumn("_ts", ref(ts).cast("timestamp")).withWatermark("_ts", watermark)
    return (
        timed.groupBy(F.window("_ts", window), ref(operation).alias("operation"))
        .agg(
            F.count("*").alias("count"),
            F.count_if(~ref(ok)).alias("errors"),
            F.round(F.avg(ref(latency)), 2).alias("avg_latency_ms"),
        )
        .select(F.col("window.start").alias("window_start"), "operation", "count", "errors", "avg_latency_ms")
    )


def running_feedback(log: DataFrame, rating: str = "rating") -> DataFrame:
    up = F.count_if(ref(rating) == "up")
    return log.groupBy().agg(
        F.count("*").alias("total"), up.alias("up"), F.count_if(ref(rating) == "down").alias("down"), F.round(ratio(up, F.count("*")), 3).alias("up_rate")
    )


def reasons(log: DataFrame, reason: str = "reason") -> DataFrame:
    return log.groupBy(ref(reason).alias("reason")).agg(F.count("*").alias("count"))


def into_table(result: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the complete result of each update under ``folder/version=<n>``."""

    def write(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/version={version}")

    writer = result.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def into_updates(result: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep what each batch changed under ``folder/version=<n>``.

    For windowed aggregates: update mode writes only the windows a batch touched and drops those
    behind the watermark from the state. ``latest_rows`` reads the newest value of every window.
    """

    def write(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/version={version}")

    writer = result.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def latest_rows(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """Newest row of every key that ``into_updates`` wrote."""
    rows = spark.read.parquet(folder)
    values = [ref(c) for c in rows.columns if c not in (*keys, "version")]
    newest = rows.groupBy(*[ref(k) for k in keys]).agg(F.max_by(F.struct(*values), "version").alias("_row"))
    return newest.select(*[ref(k) for k in keys], "_row.*")


def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    versions = spark.read.parquet(folder)
    newest = versions.agg(F.max("version").alias("v")).first()["v"]
    return versions.where(F.col("version") == newest).drop("version")


# ---- last records of each key ----

#: Records that are kept of a key, and how long a key without new ones is remembered.
KEEP = 200
KEEP_FOR = "30 days"
RING = "us array<long>, id array<long>, value array<double>"


def _milliseconds(spark: SparkSession, interval: str) -> int:
    return int(spark.range(1).select(F.expr(f"unix_millis(timestamp_seconds(0) + INTERVAL {interval})")).first()[0])


def last_latencies(
    log: DataFrame, key: str, ts: str, order_id: str, latency: str, keep: int = KEEP, watermark: str = WATERMARK, keep_for: str = KEEP_FOR
) -> DataFrame:
    """``key, n, avg_ms, p50_ms, p95_ms`` of the last ``keep`` records of each key, anew whenever a key gets records.

    The state of a key is a ring of its newest records by time, then ``order_id``; a record that comes late but
    within the watermark takes its place in it. Records without a time are left out. A key is forgotten when the watermark
    is ``keep_for`` past its newest record. Percentiles are the values at floor(n * p), as in the batch measure.
    """
    hold = _milliseconds(log.sparkSession, keep_for)
    rows = log.select(
        ref(key).cast("string").alias("key"), ref(ts).cast("timestamp").alias("_ts"), ref(order_id).cast("long").alias("id"),
        F.round(ref(latency).cast("double"), 1).alias("value"),
    ).where("_ts IS NOT NULL")
    rows = rows.withColumn("us", F.unix_micros("_ts")).withWatermark("_ts", watermark)

    def update(group, chunks, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        us, ids, values = (list(x) for x in state.get) if state.exists else ([], [], [])
        ring = list(zip(us, ids, values))
        for chunk in chunks:  # a batch of any size passes through in parts
            fresh = zip(chunk["us"].tolist(), chunk["id"].fillna(-1).astype("int64").tolist(), chunk["value"].tolist())
            ring = sorted([*ring, *fresh], key=lambda r: (r[0], r[1]))[-keep:]
        state.update(tuple([r[i] for r in ring] for i in range(3)))
        state.setTimeoutTimestamp(max(ring[-1][0] // 1000 + hold, state.getCurrentWatermarkMs() + 1))
        known = sorted(r[2] for r in ring if r[2] is not None and r[2] == r[2])
        n = len(known)
        if n:
            at = [known[int(n * 0.5)], known[min(int(n * 0.95), n - 1)]]
            yield pd.DataFrame({"key": [group[0]], "n": [n], "avg_ms": [sum(known) / n], "p50_ms": [at[0]], "p95_ms": [at[1]]})

    found = rows.groupBy("key").applyInPandasWithState(
        update, "key string, n long, avg_ms double, p50_ms double, p95_ms double", RING, "update", GroupStateTimeout.EventTimeTimeout
    )
    return found.withColumn("avg_ms", F.round("avg_ms", 1))


def phase_latencies(
    log: DataFrame, ts: str, order_id: str, phases: Sequence[str], keep: int = KEEP, watermark: str = WATERMARK, keep_for: str = KEEP_FOR
) -> DataFrame:
    """The same for each phase column and their sum (``t_total``) over the last turns; ``key`` is the phase."""
    total = ref(phases[0])
    for p in phases[1:]:
        total = total + ref(p)
    pairs = [F.struct(F.lit(p).alias("phase"), ref(p).cast("double").alias("ms")) for p in phases]
    pairs.append(F.struct(F.lit("t_total").alias("phase"), total.cast("double").alias("ms")))
    long = log.select(ref(ts).alias("ts"), ref(order_id).alias("id"), F.explode(F.array(*pairs)).alias("p"))
    return last_latencies(long.select("ts", "id", "p.phase", "p.ms"), "phase", "ts", "id", "ms", keep, watermark, keep_for)
