"""Readers, writers and normalisation of tables."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.functions.columns import FLOATING, ref, require_columns, text_columns
from tablewise.plans.shape import planned_bytes

SAMPLE_ROWS = 50
#: Files that a folder of a corpus gets, and bytes of documents that a task reads (about).
FOLDER_FILES = 1_000
CORPUS_TASK_BYTES = 32 << 20
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _clean_name(name: str) -> str:
    return name.replace("\n", " ").replace("\t", " ").strip()


def normalize(df: DataFrame) -> DataFrame:
    """Trim column names, read all-numeric text columns as numbers, and turn infinities into NULL.

    One aggregate decides for all text columns together: a column is numeric only if every
    non-null value parses.
    """
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        name = _clean_name(c)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    df = df.toDF(*names)
    texts = text_columns(df)
    numeric: dict[str, str] = {}
    if texts:
        parts = []
        for i, c in enumerate(texts):
            value = F.trim(ref(c))
            parts += [
                F.count(value).alias(f"n{i}"),
                F.count(value.try_cast("double")).alias(f"d{i}"),
                F.count(F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("bigint"))).alias(f"l{i}"),
            ]
        row = df.agg(*parts).first()
        for i, c in enumerate(texts):
            if row[f"n{i}"] and row[f"n{i}"] == row[f"d{i}"]:
                numeric[c] = "bigint" if row[f"l{i}"] == row[f"n{i}"] else "double"
    out = df.select(*[F.trim(ref(c)).try_cast(numeric[c]).alias(c) if c in numeric else ref(c) for c in df.columns])

    def finite(c: str):
        return F.when(~F.abs(ref(c)).isin(float("inf")), ref(c)).alias(c)

    return out.select(*[finite(c) if isinstance(out.schema[c].dataType, FLOATING) else ref(c) for c in out.columns])


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """Header CSV. Give ``schema`` on large inputs: inference reads the data once more.

    ``multi_line`` allows line feeds inside quotes, at the price of one task for a whole file.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return normalize(df)


def read_parquet(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    limit: int | None = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    df = spark.read.parquet(path)
    if columns is not None:
        require_columns(df, *columns)
        keep = [c for c in df.columns if c in set(columns)]
        df = df.select(*[ref(c) for c in keep])
    return df if limit is None else sample_rows(df, limit, order_by)


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = True) -> DataFrame:
    """One JSON object (or array of them) a line, which splits large files over tasks; without ``lines`` documents
    that span lines, each file in one task."""
    reader = spark.read.option("multiLine", not lines)
    return normalize((reader.schema(schema) if schema else reader).json(path))


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    properties: Mapping[str, str] | None = None,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 8,
) -> DataFrame:
    """Result of a SQL query on a database; bounds on a column split the read over tasks."""
    reader = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column and bounds:
        reader = (
            reader.option("dbtable", f"({query}) q")
            .option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    else:
        reader = reader.option("query", query)
    df = reader.load()
    if df.isEmpty():
        raise ValueError("query returned no rows")
    return normalize(df)


def detect_format(uri: str, content_type: str = "") -> str:
    """parquet or json by extension or content type, else csv."""
    path = urlsplit(uri).path.lower()
    kind = content_type.lower()
    if path.endswith(".parquet"):
        return "parquet"
    if path.endswith(".json") or "json" in kind:
        return "json"
    return "csv"


def read_uri(spark: SparkSession, uri: str, content_type: str = "", **options) -> DataFrame:
    """Any location Hadoop can read; the format follows the name, and ``options`` go to its reader."""
    kind = detect_format(uri, content_type)
    if kind == "parquet":
        return normalize(spark.read.parquet(uri))
    return (read_json if kind == "json" else read_csv)(spark, uri, **options)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``source, text``: every .txt and .md file below a folder as one document. Each task lists many folders, where
    Spark alone would start one for each of up to 10,000, and reads many files, where each would count for 4 MB."""
    before = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        files = (
            spark.read.option("wholetext", True)
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.{txt,md}")
            .text(path)
        )
    finally:
        spark.conf.set(LISTING_TASKS, before)
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-planned_bytes(files) // CORPUS_TASK_BYTES))
    files = files.coalesce(tasks)
    return files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def _one_file_each(folder: str, label: str):
    """Write the rows of a task, sorted by name, as files: their texts as lines. A file appears under its name when whole."""

    def run(batches):
        task, last, files, out, temp, path = TaskContext.get(), None, 0, None, "", ""
        for rows in batches:
            for name, text in zip(rows.column(0).to_pylist(), rows.column(1).cast(pa.large_binary())):
                if out is None or name != last:
                    if out is not None:
                        out.close()
                        os.replace(temp, path)
                    home = f"{folder}/{task.partitionId():05d}-{files // FOLDER_FILES:05d}"
                    if files % FOLDER_FILES == 0:
                        os.makedirs(home, exist_ok=True)
                    shown = "__HIVE_DEFAULT_PARTITION__" if name is None else quote(name, safe=" ")
                    path, temp = f"{home}/{label}={shown}.txt", f"{home}/.{task.taskAttemptId()}"
                    out, last, files = open(temp, "wb"), name, files + 1
                out.write((text.as_py() or b"") + b"\n")
        if out is not None:
            out.close()
            os.replace(temp, path)
        yield pa.RecordBatch.from_arrays([pa.array([files])], ["files"])

    return run


def write_corpus(df: DataFrame, path: str, name_col: str, text_col: str) -> None:
    """One .txt file for each value of a column, ``name_col=value`` in its path; rows of one value are lines of one file.

    A folder that is mounted is written by the tasks themselves: Hadoop's local file system starts several processes for
    each file. Elsewhere Spark writes a partition folder for each value."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file":
        # tasks move their own files into place; the driver would move one after the other
        write = df.select(ref(name_col), ref(text_col)).repartition(ref(name_col)).write.option("mapreduce.fileoutputcommitter.algorithm.version", 2)
        write.option("compression", "none").partitionBy(name_col).text(path)
        return
    if fs.exists(target):
        raise FileExistsError(path)
    folder = fs.makeQualified(target).toUri().getPath()
    # a null and an empty name are one, as in partition folders
    name = F.nullif(ref(name_col).cast("string"), F.lit("")).alias("name")
    named = df.select(name, ref(text_col).alias("text")).repartition("name")
    # equal rows for a task that runs again, so that it writes the same files
    files = named.sortWithinPartitions("name", "text").mapInArrow(_one_file_each(folder, name_col), "files long")
    files.agg(F.sum("files")).first()
    os.makedirs(folder, exist_ok=True)


def sample_rows(df: DataFrame, limit: int = SAMPLE_ROWS, order_by: Sequence[str] | None = None) -> DataFrame:
    """First rows by an explicit order; without one the rows are any."""
    if order_by:
        df = df.orderBy(*[ref(c) for c in order_by])
    return df.limit(limit)


def write_scored_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All rows, one file per partition."""
    df.write.mode(mode).option("header", True).csv(path)


def write_jsonl_append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
