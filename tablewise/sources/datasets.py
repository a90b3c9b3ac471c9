"""Registered datasets: parquet folders, their metadata, annotations and stored first looks."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.functions.columns import ref
from tablewise.operators.sql import ACTIVE_VIEW, safe_view_name
from tablewise.plans.shape import path_exists
from tablewise.sources.tables import normalize

META_SCHEMA = "dataset_id string, filename string, path string, n_rows bigint, n_cols int, columns array<string>, registered_at double"
ACTIVE_SCHEMA = "dataset_id string, set_at double"
EDA_INSIGHTS = 8


class Datasets:
    """A folder of datasets. Every table is one parquet directory, metadata rows are appended.

    The active dataset is stored as well: a new session on the folder goes on with it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.active = spark, folder.rstrip("/"), None
        if path_exists(spark, f"{self.folder}/active"):
            chosen = spark.read.schema(ACTIVE_SCHEMA).parquet(f"{self.folder}/active").agg(F.max_by("dataset_id", "set_at")).first()[0]
            self._show(chosen)

    def register(self, df: DataFrame, filename: str, make_active: bool = True) -> str:
        dataset_id = uuid.uuid4().hex
        path = f"{self.folder}/tables/{dataset_id}"
        normalize(df).write.parquet(path)
        stored = self.spark.read.parquet(path)
        row = (dataset_id, filename, path, stored.count(), len(stored.columns), stored.columns, time.time())
        self.spark.createDataFrame([row], META_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/meta")
        if make_active:
            self.set_active(dataset_id)
        return dataset_id

    def list(self) -> DataFrame:
        return self.spark.read.schema(META_SCHEMA).parquet(f"{self.folder}/meta").orderBy("registered_at", "dataset_id")

    def meta(self, dataset_id: str | None = None) -> dict:
        dataset_id = dataset_id or self.active
        row = self.list().where(F.col("dataset_id") == dataset_id).first()
        if row is None:
            raise ValueError(f"unknown dataset {dataset_id}")
        return row.asDict()

    def load(self, dataset_id: str | None = None) -> DataFrame:
        return self.spark.read.parquet(self.meta(dataset_id)["path"])

    def set_active(self, dataset_id: str) -> None:
        self._show(dataset_id)
        row = self.spark.createDataFrame([(dataset_id, time.time())], ACTIVE_SCHEMA)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/active")

    def _show(self, dataset_id: str) -> None:
        df = self.spark.read.parquet(self.meta(dataset_id)["path"])
        df.createOrReplaceTempView(ACTIVE_VIEW)
        self.active = dataset_id

    def views(self) -> dict[str, DataFrame]:
        """Other datasets by safe view name, for SQL."""
        out: dict[str, DataFrame] = {}
        for r in self.list().collect():  # one row per dataset
            if r["dataset_id"] != self.active:
                out[safe_view_name(r["filename"], r["dataset_id"], set(out))] = self.spark.read.parquet(r["path"])
        return out

    def materialize_eda(self, dataset_id: str, key: list[str]) -> None:
        """Store profile and first insights beside the dataset; a failure leaves its message."""
        from tablewise.operators.insights import auto_insights
        from tablewise.operators.profile import profile_dataset

        df = self.load(dataset_id)
        for name, make in (("profile", profile_dataset), ("insights", lambda d: auto_insights(d, key, EDA_INSIGHTS))):
            target = f"{self.folder}/eda_{name}/dataset_id={dataset_id}"
            try:
                make(df).write.mode("overwrite").parquet(target)
            except Exception as exc:
                note = self.spark.createDataFrame([(dataset_id, name, str(exc)[:500])], "dataset_id string, part string, error string")
                note.write.mode("append").parquet(f"{self.folder}/eda_errors")


def annotation_documents(annotations: DataFrame) -> DataFrame:
    """``dataset, text``: one markdown document per dataset from its column notes.

    ``annotations``: dataset, description, column, note. Blank notes are left out.
    """
    note = F.trim(F.coalesce("note", F.lit("")))
    line = F.when(note != "", F.concat(F.lit("- **"), ref("column"), F.lit("**: "), note))
    grouped = annotations.groupBy("dataset").agg(
        F.max(F.trim(F.coalesce("description", F.lit("")))).alias("_about"),
        F.array_sort(F.collect_list(line)).alias("_lines"),  # one entry per column of a dataset
    )
    head = F.concat(F.lit("# "), F.col("dataset").cast("string"))
    parts = F.array(head, F.nullif(F.col("_about"), F.lit("")), F.nullif(F.array_join("_lines", "\n"), F.lit("")))
    return grouped.select("dataset", F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n").alias("text"))
