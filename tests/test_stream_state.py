"""Last records of each key on a stream against the batch measure, version by version."""

import pytest
from pyspark.sql import functions as F

from tablewise.operators import logs
from tablewise.streaming.logs import into_updates, last_latencies, latest_rows, phase_latencies, read_log

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in three files, in order of time but for some late ones."""
    folder = str(tmp_path_factory.mktemp("log"))
    events = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("user", F.pmod("user_id", F.lit(3)))
    ends = events.approxQuantile("event_id", [0.4, 0.7], 0.0)
    late = F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0
    part = F.when(F.col("event_id") <= ends[0], 0).when(F.col("event_id") <= ends[1], 1).otherwise(2)
    part = F.when(late & (part < 2), part + 1).otherwise(part)
    cut = events.withColumn("part", part).persist()
    files = []
    for k in range(3):
        cut.where(F.col("part") == k).drop("part").coalesce(1).write.parquet(f"{folder}/{k}")
        files.append(cut.where(F.col("part") <= k).drop("part"))
    return folder, files


def replay(spark, folder, made, tmp_path, measure, keys, versions):
    """Feeds one part at a time to the same checkpoint, as a query that is stopped and restarted does."""
    out = []
    schema = versions[0].schema
    jvm_fs = spark._jvm.org.apache.hadoop.fs
    source = str(tmp_path / "in")
    fs = jvm_fs.Path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm_fs.Path(source))
    for k in range(3):
        for status in fs.listStatus(jvm_fs.Path(f"{folder}/{k}")):
            name = status.getPath().getName()
            if name.startswith("part-"):
                jvm_fs.FileUtil.copy(fs, status.getPath(), fs, jvm_fs.Path(f"{source}/{k}-{name}"), False, spark._jsc.hadoopConfiguration())
        query = into_updates(measure(read_log(spark, source, schema)), str(tmp_path / made), str(tmp_path / f"{made}-state"))
        query.awaitTermination(120)
        assert query.exception() is None
        out.append({r[keys]: (r.n, r.avg_ms, r.p50_ms, r.p95_ms) for r in latest_rows(spark, str(tmp_path / made), [keys]).collect()})
    return out


def batch(rows, name):
    return {str(r[name]): (r.n, r.avg_ms, r.p50_ms, r.p95_ms) for r in rows.collect()}


def test_latency_by_key_equals_batch_at_every_version(spark, parts, tmp_path):
    folder, versions = parts
    got = replay(
        spark, folder, "keys", tmp_path, lambda s: last_latencies(s, "user", "ts", "event_id", "value", watermark="4000 days"), "key", versions
    )
    for have, upto in zip(got, versions):
        assert have == batch(logs.latency_by_key(upto, "user", ["ts", "event_id"], "value"), "key")
    assert any(v[0] == 200 for v in got[-1].values())


def test_latency_by_phase_equals_batch(spark, parts, tmp_path):
    folder, versions = parts
    phases = ["t_plan", "t_execute"]
    with_phases = lambda df: df.select("ts", "event_id", F.col("value").alias("t_plan"), (F.col("value") * 2).alias("t_execute"))
    got = replay(
        spark, folder, "phases", tmp_path, lambda s: phase_latencies(with_phases(s), "ts", "event_id", phases, watermark="4000 days"), "key", versions
    )
    for have, upto in zip(got, versions):
        assert have == batch(logs.latency_snapshot(with_phases(upto), ["ts", "event_id"], phases), "phase")


def test_keys_are_forgotten_and_late_records_dropped(spark, tmp_path):
    """With a short watermark, records behind it do not count, and a key that got none for long starts anew."""
    day = 86_400
    steps = [
        [(1, 0, "a", 10.0), (2, 0, "b", 20.0)],
        [(3, 100 * day, "b", 30.0)],  # the watermark passes a's time to live
        [(4, 200 * day, "b", 40.0)],
        [(5, 200 * day, "a", 50.0), (6, 1 * day, "b", 999.0)],  # a is new, 6 is late
    ]
    schema = "event_id long, s long, user string, value double"
    source = str(tmp_path / "in")
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(source)
        log = read_log(spark, source, spark.read.parquet(source).schema)
        found = last_latencies(log, "user", "ts", "event_id", "value", watermark="1 day", keep_for="10 days")
        query = into_updates(found, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination(120)
        assert query.exception() is None
    got = {r.key: (r.n, r.p95_ms) for r in latest_rows(spark, str(tmp_path / "out"), ["key"]).collect()}
    assert got["a"] == (1, 50.0) and got["b"][1] == 40.0
