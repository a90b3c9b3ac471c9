"""Plan size, stable intermediate tables, wide-to-long reshaping and null-safe joins."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid
from collections.abc import Iterable, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import ref

IN_MEMORY_BYTES_KEY = "spark.tablewise.inMemoryBytes"
IN_MEMORY_BYTES_DEFAULT = 64 * 1024 * 1024
SHUFFLE_ROWS = 50_000
#: Values that a task may hash before they are shuffled; 90 bytes each when all differ.
SPLIT_VALUES = 2_000_000
# Threads that change the session's settings take turns, or one would put back what another has set.
_SETTINGS = threading.RLock()
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_REMOVING: dict[int, list] = {}


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; no job runs. Filters and aggregates keep the size
    of what they read and joins multiply it, so it errs on the large side."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_in_memory(df: DataFrame) -> bool:
    """True when one task may hold the distinct values of ``df``."""
    limit = int(df.sparkSession.conf.get(IN_MEMORY_BYTES_KEY, str(IN_MEMORY_BYTES_DEFAULT)))
    return planned_bytes(df) <= limit


PLAIN_NODES = ("Project", "Filter", "LogicalRelation", "SubqueryAlias", "LocalRelation", "DataSourceV2ScanRelation")


def is_plain_scan(df: DataFrame) -> bool:
    """True when a plan only reads, filters and projects: reading it again column by column
    costs no more than reading it once."""
    nodes = [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() not in PLAIN_NODES:
            return False
        children = node.children()
        nodes.extend(children.apply(i) for i in range(children.size()))
    return True


def spread(df: DataFrame) -> DataFrame:
    """One partition per core for a scan that comes in fewer, such as a file of one row group.

    Only for work that is heavy per row; a scan with partitions enough is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if is_plain_scan(df) and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def shared_folder(spark) -> str:
    """The folder all executors see, as the session names it in ``spark.checkpoint.dir``.

    Only a single-machine session may go without: it gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file:" + tempfile.mkdtemp(prefix="tablewise-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _remove(jvm, conf, paths: list[str]) -> None:
    for path in paths:
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # the session may be gone with its folder
            return


def path_exists(spark, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove_path(spark, path: str) -> bool:
    """Delete a file or folder with all it holds; whether there was one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def remove_at_exit(spark, path: str) -> None:
    """Delete a scratch folder when the driver ends."""
    sc = spark.sparkContext
    if id(sc) not in _SCRATCH:
        _SCRATCH[id(sc)] = []
        atexit.register(_remove, sc._jvm, sc._jsc.hadoopConfiguration(), _SCRATCH[id(sc)])
    _SCRATCH[id(sc)].append(path)


_SCRATCH: dict[int, list[str]] = {}


@contextmanager
def shuffles_removed(spark):
    """Shuffle files go as soon as the query that wrote them ends. Else they stay until the driver collects its garbage,
    which does not depend on how much disk they take. Nothing that runs inside may be run again as the same plan."""
    key = id(spark.sparkContext)
    with _SETTINGS:
        # threads share the setting: the last one to leave puts it back
        inside = _REMOVING.setdefault(key, [0, "false"])
        if not inside[0]:
            inside[1] = spark.conf.get(REMOVE_SHUFFLES, "false")
            spark.conf.set(REMOVE_SHUFFLES, "true")
        inside[0] += 1
    try:
        yield
    finally:
        with _SETTINGS:
            inside[0] -= 1
            if not inside[0]:
                spark.conf.set(REMOVE_SHUFFLES, inside[1])


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, lost executors cost
    no recomputation, and later reads see the same rows. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tablewise-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``stored`` made, once nothing reads them any more."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path is not None:
            remove_path(table.sparkSession, path)


@contextmanager
def shuffles_for(spark, rows: int):
    """Fewer shuffle partitions for small tables that many short jobs go over: about one for ``SHUFFLE_ROWS`` rows, no
    fewer than the cores and no more than the session has. Jobs must run inside."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), max(spark.sparkContext.defaultParallelism, rows // SHUFFLE_ROWS + 1))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of the files and tables that a plan reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


@contextmanager
def short_splits(df: DataFrame, values: int):
    """Scans of at most ``SPLIT_VALUES`` of so many values a task, as far as row groups allow, for aggregates that hash
    about every value they read. Splits are never longer than the session's. Jobs must run inside."""
    if values <= SPLIT_VALUES:
        yield
        return
    spark, key = df.sparkSession, "spark.sql.files.maxPartitionBytes"
    with _SETTINGS:
        before = spark.conf.get(key)
        longest = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)  # it may carry a unit
        spark.conf.set(key, str(min(longest, max(1, scanned_bytes(df) * SPLIT_VALUES // values))))
        try:
            yield
        finally:
            spark.conf.set(key, before)


def steady(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later reads see the same rows in the same partitions even after
    executors are lost. Spark's cleaner removes its files once the frame is gone, where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on; the folder goes when the driver ends."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
        remove_at_exit(df.sparkSession, sc.getCheckpointDir())
    return df.checkpoint()


def rows_from_aggregate(agg: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn a one-row (per group) aggregate into one row per struct."""
    return agg.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def grouped_rows_from_aggregate(agg: DataFrame, by: Sequence[str], structs: Sequence[Column]) -> DataFrame:
    return agg.select(*[ref(b) for b in by], F.explode(F.array(*structs)).alias("_r")).select(
        *[ref(b) for b in by], "_r.*"
    )


def long_form(df: DataFrame, values: dict[str, Column], keep: Iterable[Column | str] = ()) -> DataFrame:
    """One row per input row and named value: ``keep..., column, value``."""
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), v.alias("value")) for n, v in values.items()])
    kept = [ref(k) if isinstance(k, str) else k for k in keep]
    wide = df.select(*kept, F.explode(pairs).alias("_p"))
    return wide.select(*[ref(c) for c in wide.columns if c != "_p"], "_p.column", "_p.value")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that lets NULL keys meet; the keys of the left side are kept."""
    renamed = right.select(*[ref(c).alias(f"_rk_{c}") if c in keys else ref(c) for c in right.columns])
    cond = None
    for k in keys:
        term = ref(k).eqNullSafe(ref(f"_rk_{k}"))
        cond = term if cond is None else cond & term
    return left.join(renamed, cond, how).drop(*[f"_rk_{k}" for k in keys])


def one_row(spark, schema: str, values: Sequence) -> DataFrame:
    """DataFrame of one finished result row."""
    return spark.createDataFrame([tuple(values)], schema)
