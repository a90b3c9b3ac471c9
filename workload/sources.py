"""Round trips through every file format, annotations, insights and streams."""

import os
import tempfile

from pyspark.sql import functions as F

from tablewise.operators import insights
from tablewise.sources import datasets, tables
from tablewise.streaming import logs as stream_logs
from workload.registry import query


def scratch(t) -> str:
    """New folder for derived files: below the shared checkpoint folder where one is set."""
    conf = t.spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir") or t.spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tablewise-{os.urandom(6).hex()}"
    return tempfile.mkdtemp(prefix="tablewise-run-")


@query("csv_round_trip_customer", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = f"{scratch(t)}/customer"
    tables.write_scored_csv(t.customer, path)
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return tables.read_csv(t.spark, path, schema)


@query("json_round_trip_supplier", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(t):
    path = f"{scratch(t)}/supplier"
    tables.write_jsonl_append(t.supplier, path)
    return tables.read_json(t.spark, path, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", lines=True)


@query("uri_round_trip_part", "SELECT * FROM part")
def _(t):
    path = f"{scratch(t)}/part.parquet"
    t.part.write.parquet(path)
    return tables.read_uri(t.spark, path)


@query("jsonl_append_twice", "SELECT n_nationkey, count(*) * 2 AS n FROM nation GROUP BY 1")
def _(t):
    path = f"{scratch(t)}/log"
    tables.write_jsonl_append(t.nation, path)
    tables.write_jsonl_append(t.nation, path)
    return t.spark.read.schema("n_nationkey int, n_name string").json(path).groupBy("n_nationkey").agg(F.count("*").alias("n"))


@query("corpus_round_trip_pages", "SELECT page_id, length(html) AS n FROM pages")
def _(t):
    """One text file per page, read back as documents."""
    path = f"{scratch(t)}/corpus"
    body = t.pages.select("page_id", F.translate("html", "\n\r", "  ").alias("value"))
    tables.write_corpus(body, path, "page_id", "value")
    files = tables.read_corpus(t.spark, path)
    return files.select(
        F.regexp_extract("source", "page_id=([0-9]+)", 1).cast("long").alias("page_id"), F.length("text").cast("long").alias("n")
    )


@query(
    "dataset_registry_tables",
    """SELECT 'orders.csv' AS filename, count(*) AS n_rows, 6 AS n_cols FROM orders UNION ALL SELECT 'customer data.parquet', count(*), 5 FROM customer""",
)
def _(t):
    store = datasets.Datasets(t.spark, scratch(t))
    store.register(t.orders, "orders.csv")
    store.register(t.customer, "customer data.parquet", make_active=False)
    return store.list().select("filename", "n_rows", "n_cols")


@query("materialized_eda_supplier")
def _(t):
    store = datasets.Datasets(t.spark, scratch(t))
    i = store.register(t.supplier, "supplier.parquet")
    store.materialize_eda(i, ["s_suppkey"])
    return t.spark.read.parquet(f"{store.folder}/eda_profile").select("name", "dtype", "missing", "unique")


@query(
    "annotation_documents_nations",
    """SELECT r_name AS dataset, '# ' || r_name || chr(10) || chr(10) || 'Nations of ' || r_name || coalesce(chr(10) || chr(10) ||
       string_agg('- **' || n_name || '**: nation ' || n_nationkey, chr(10) ORDER BY '- **' || n_name || '**: nation ' || n_nationkey) FILTER (WHERE n_nationkey % 5 <> 0), '') AS text
       FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def _(t):
    note = F.when(F.pmod("n_nationkey", F.lit(5)) == 0, "  ").otherwise(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")))
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("dataset"), F.concat(F.lit("Nations of "), F.col("r_name")).alias("description"), F.col("n_name").alias("column"), note.alias("note")
    )
    return datasets.annotation_documents(rows)


@query("auto_insights_orders")
def _(t):
    return insights.auto_insights(t.orders, ["o_orderkey"])


@query("analysis_context_orders")
def _(t):
    return insights.analysis_context(t.orders, ["o_orderkey"])


# ---- streams: the events file read as a stream ----


def _stream(t):
    return stream_logs.read_log(t.spark, f"{t.folder}/event[s].parquet", t.events.schema)


def _windows(t, result, *keys):
    folder = scratch(t)
    stream_logs.into_updates(result, f"{folder}/out", f"{folder}/state").awaitTermination()
    return stream_logs.latest_rows(t.spark, f"{folder}/out", keys)


def _finished(t, result):
    folder = scratch(t)
    stream_logs.into_table(result, f"{folder}/out", f"{folder}/state").awaitTermination()
    return stream_logs.latest_version(t.spark, f"{folder}/out")


@query(
    "stream_daily_quality",
    "SELECT ts::DATE::VARCHAR AS day, round(avg(value), 2) AS avg_score, count(*) AS n, min(value) AS min_score, max(value) AS max_score FROM events GROUP BY 1",
)
def _(t):
    out = _windows(t, stream_logs.daily_quality(_stream(t), "ts", "value"), "day")
    return out.withColumn("day", F.col("day").cast("string"))


@query(
    "stream_windowed_calls",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS operation, count(*) AS count, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(user_id), 2) AS avg_latency_ms
       FROM events GROUP BY ALL""",
)
def _(t):
    log = _stream(t).withColumn("ok", F.col("event_type") != "error")
    out = _windows(t, stream_logs.windowed_calls(log, "ts", "event_type", "ok", "user_id"), "window_start", "operation")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "stream_running_feedback",
    """SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'signup') AS up, count(*) FILTER (WHERE event_type = 'error') AS down, round(avg((event_type = 'signup')::INT), 3) AS up_rate
       FROM events WHERE event_type IN ('signup', 'error')""",
)
def _(t):
    log = _stream(t).where(F.col("event_type").isin("signup", "error"))
    rating = F.when(F.col("event_type") == "signup", "up").otherwise("down")
    return _finished(t, stream_logs.running_feedback(log.withColumn("rating", rating)))


@query("stream_reasons", "SELECT event_type AS reason, count(*) AS count FROM events GROUP BY 1")
def _(t):
    return _finished(t, stream_logs.reasons(_stream(t), "event_type"))
