"""Nearest neighbours as a model: the training vectors are a stored table, scoring is a search in it."""

from __future__ import annotations

from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.plans.nearest import nearest
from tablewise.plans.shape import stored


class Neighbours(Estimator):
    """Stores ``_label`` and ``_features`` of the training rows; nothing else is learnt."""

    def __init__(self, task: str, n_labels: int = 2, k: int = 5):
        super().__init__()
        self.task, self.n_labels, self.k = task, n_labels, k

    def _fit(self, df: DataFrame) -> NeighbourModel:
        rows = df.select(F.monotonically_increasing_id().alias("_id"), "_label", vector_to_array("_features").alias("_v"))
        return NeighbourModel(stored(rows), self.task, self.n_labels, self.k)


class NeighbourModel(Transformer, MLReadable, MLWritable):
    """Adds ``_prediction``; a classifier also ``_probability``, the share of each label among the
    k nearest training rows."""

    def __init__(self, rows: DataFrame | None = None, task: str = "classification", n_labels: int = 2, k: int = 5):
        super().__init__()
        self.rows, self.task, self.n_labels, self.k = rows, task, n_labels, k

    def _transform(self, df: DataFrame) -> DataFrame:
        asked = stored(df.withColumn("_query", F.monotonically_increasing_id()))  # ids must not change between two reads
        vectors = asked.select("_query", vector_to_array("_features").alias("_v"))
        hits = nearest(self.rows, vectors, self.k, "_id", "_v", "_query", "_v", metric="euclidean")
        known = hits.join(self.rows.select(F.col("_id").alias("item_id"), "_label"), "item_id")
        found = known.groupBy(F.col("query_id").alias("_query"))
        if self.task == "regression":
            answers = found.agg(F.avg("_label").alias("_prediction"))
        else:
            shares = F.array(*[F.count_if(F.col("_label") == i) / F.count("*") for i in range(self.n_labels)])
            answers = found.agg(shares.alias("_p")).select(
                "_query",
                array_to_vector("_p").alias("_probability"),
                (F.array_position("_p", F.array_max("_p")) - 1).cast("double").alias("_prediction"),
            )
        return asked.join(answers, "_query", "left").drop("_query")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: NeighbourModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sc, {"task": m.task, "n_labels": m.n_labels, "k": m.k})
        m.rows.write.parquet(f"{path}/rows")


class _Reader(MLReader):
    def load(self, path: str) -> NeighbourModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sc)
        return NeighbourModel(self.sparkSession.read.parquet(f"{path}/rows"), meta["task"], meta["n_labels"], meta["k"])
