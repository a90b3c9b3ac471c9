"""Exact top-k neighbours without pairs of rows.

Vectors are compared block against block with matrix products of bounded size; a block gives back at
most k candidates per query, and Spark keeps the best k of those. A query set whose size is proven
small travels with the tasks over one scan of the corpus. For a larger one both sides are dealt to the
nearest of some pivots drawn from the corpus. How far the queries of a cell can be from their k-th neighbour
follows from distances to pivots alone; by the triangle inequality corpus rows beyond that are not
copied to the cell. What is copied meets the cell's queries in groups of bounded size.

Before that, equal vectors are put together: equal queries are asked once, and of equal items no more than the k with
the smallest ids can be among the best k. Feature vectors of few columns repeat often.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablewise.functions.columns import ref
from tablewise.plans.jobs import list_matrix
from tablewise.plans.shape import stored

BROADCAST_QUERIES_BYTES = 32 * 1024 * 1024
BLOCK_ROWS = 20_000
#: Bytes of one matrix product; a task holds about three times that beside the rows of a group.
PRODUCT_BYTES = 16 * 1024 * 1024
#: Most pivots, and most distances to pivots that are looked at on the driver.
PIVOTS, NEAR_DISTANCES = 256, 1 << 18
#: Squared distances this close count as equal, since scores are rounded before they are compared.
SLACK = 1e-5
SCORE_DIGITS = 6


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores of one query, ids breaking ties."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        cand = np.flatnonzero(scores >= floor)
    else:
        cand = np.arange(len(scores))
    return cand[np.lexsort((ids[cand], -scores[cand]))][:k]


def _match(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, metric: str, skip_self: bool) -> pd.DataFrame:
    """The k best of these items for each of these queries, by products of at most ``PRODUCT_BYTES``."""
    step = max(1, PRODUCT_BYTES // (8 * max(1, len(c))))
    parts = [_product(qid[i : i + step], q[i : i + step], cid, c, k, metric, skip_self) for i in range(0, len(q), step)]
    return pd.concat(parts, ignore_index=True)


def _product(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, metric: str, skip_self: bool) -> pd.DataFrame:
    scores = q @ c.T
    if metric != "dot":  # in place: a product is the largest thing that a task holds
        scores *= -2
        scores += (q * q).sum(1)[:, None]
        scores += (c * c).sum(1)[None, :]
        np.maximum(scores, 0.0, out=scores)
        np.sqrt(scores, out=scores)
        np.negative(scores, out=scores)
    np.round(scores, SCORE_DIGITS, out=scores)
    if skip_self:
        scores[qid[:, None] == cid[None, :]] = -np.inf
    out_q, out_c, out_s = [], [], []
    for i in range(len(qid)):
        pick = _best(scores[i], cid, k)
        pick = pick[np.isfinite(scores[i][pick])]
        out_q.append(np.repeat(qid[i : i + 1], len(pick)))
        out_c.append(cid[pick])
        out_s.append(scores[i][pick])
    return pd.DataFrame({"query_id": np.concatenate(out_q), "item_id": np.concatenate(out_c), "score": np.concatenate(out_s)})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _arrow_matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    if len(set(lists.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors must be of one length")
    return list_matrix(lists)


def nearest(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    corpus_id: str = "item_id",
    corpus_vec: str = "vector",
    query_id: str = "query_id",
    query_vec: str = "vector",
    metric: str = "dot",
    skip_self: bool = False,
    max_query_bytes: int = BROADCAST_QUERIES_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, item_id, score, rank``: the k best items per query (dot or euclidean).

    Euclidean scores are negative distances. Scores carry six digits so that copies tie and
    the smaller id wins. A row without a vector takes part in nothing.
    """
    c = corpus.select(ref(corpus_id).alias("item_id"), ref(corpus_vec).alias("v")).where("v IS NOT NULL")
    q = queries.select(ref(query_id).alias("query_id"), ref(query_vec).alias("v")).where("v IS NOT NULL")
    schema = T.StructType(
        [
            T.StructField("query_id", q.schema["query_id"].dataType),
            T.StructField("item_id", c.schema["item_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    if _query_bytes(q) <= max_query_bytes:
        return top_per_query(_scan(c, q, k, metric, skip_self, schema), k)
    if skip_self:  # ids decide which pairs count, also where they repeat
        return top_per_query(_in_groups(c, q, k, metric, True, block_rows, schema), k)
    few, asked = _few_of_equal(c, k), _asked_once(q)
    reps = asked.select(F.col("_rep").alias("query_id"), "v")
    schema = T.StructType([T.StructField("query_id", T.LongType()), *schema.fields[1:]])
    if _query_bytes(reps) <= max_query_bytes:
        found = _scan(few, reps, k, metric, False, schema)
    else:
        found = _in_groups(few, reps, k, metric, False, block_rows, schema)
    best = top_per_query(found, k).select(F.col("query_id").alias("_rep"), "item_id", "score")
    own = q.join(asked, "v").select("query_id", "_rep")
    return top_per_query(own.join(best, "_rep").select("query_id", "item_id", "score"), k)


def _query_bytes(q: DataFrame) -> int:
    size = q.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    return size["n"] * size["d"] * 8


def _few_of_equal(c: DataFrame, k: int) -> DataFrame:
    """Of the items with one vector the k with the smallest ids; Spark cuts them before the shuffle."""
    order = Window.partitionBy("v").orderBy(F.col("item_id").asc_nulls_last())
    return c.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def _asked_once(q: DataFrame) -> DataFrame:
    """``v, _rep``: every different vector with a number, stored so that the numbers stay."""
    return stored(q.groupBy("v").agg(F.count(F.lit(1)).alias("_n")).select("v", F.monotonically_increasing_id().alias("_rep")))


def _scan(c: DataFrame, q: DataFrame, k: int, metric: str, skip_self: bool, schema: T.StructType) -> DataFrame:
    """The best of every batch of items for all queries, which travel with the tasks."""
    rows = q.collect()  # at most max_query_bytes
    if not rows:
        return c.sparkSession.createDataFrame([], schema)
    ids = np.array([r["query_id"] for r in rows])
    vectors = np.array([r["v"] for r in rows], dtype="float64")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield _match(ids, vectors, b["item_id"].to_numpy(), _matrix(b["v"]), k, metric, skip_self)

    return c.mapInPandas(scan, schema)


def _in_groups(
    c: DataFrame, q: DataFrame, k: int, metric: str, skip_self: bool, block_rows: int, schema: T.StructType
) -> DataFrame:
    """The best of every group of items and queries that may hold neighbours of each other."""
    left, right, by = _voronoi_groups(c, q, k + skip_self, metric, block_rows)
    names = [f.name for f in schema.fields]

    def couple(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return wanted.empty_table()
        qid, cid = b["query_id"].to_pandas().to_numpy(), a["item_id"].to_pandas().to_numpy()
        found = _match(qid, _arrow_matrix(b["v"]), cid, _arrow_matrix(a["v"]), k, metric, skip_self)
        return pa.Table.from_pandas(found[names], schema=wanted, preserve_index=False)

    wanted = to_arrow_schema(schema)
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(couple, schema)


class _Space:
    """Vectors as points whose order by distance is the order by score. Inner products become distances when
    items get one more coordinate that makes them equally long."""

    def __init__(self, metric: str, longest: float):
        self.dot, self.longest = metric == "dot", longest

    def points(self, vectors: np.ndarray, items: bool) -> np.ndarray:
        if not self.dot:
            return vectors
        more = np.sqrt(np.maximum(self.longest - (vectors * vectors).sum(1), 0.0)) if items else np.zeros(len(vectors))
        return np.concatenate([vectors, more[:, None]], 1)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points * points).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (points @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def _in_cells(rows: DataFrame, space: _Space, pivots: np.ndarray, items: bool) -> DataFrame:
    """Rows with the number of their nearest pivot and the distance to it, as a stored table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                far = _distances(space.points(_matrix(b["v"]), items), pivots)
                cell = far.argmin(1)
                yield b.assign(cell=cell.astype("int32"), far=far[np.arange(len(b)), cell])

    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
    return stored(rows.mapInPandas(run, schema))


def cell_reach(pivots: np.ndarray, near: dict[int, np.ndarray], widest: dict[int, float], k: int) -> dict[int, float]:
    """For each cell of queries an upper bound of the distance from any of them to its k-th neighbour. ``near``
    has the least distances of items to each pivot, ``widest`` the largest one of the cell's queries."""
    between = _distances(pivots, pivots)
    cells = np.concatenate([np.full(len(d), j) for j, d in near.items()])
    far = np.concatenate(list(near.values()))
    reach = {}
    for i, wide in widest.items():
        bound = wide + between[i, cells] + far
        reach[i] = float(np.partition(bound, k - 1)[k - 1]) if len(bound) >= k else math.inf
    return reach


def _voronoi_groups(c: DataFrame, q: DataFrame, k: int, metric: str, block_rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Corpus rows and query rows with the keys of the bounded groups in which they meet."""
    spark = c.sparkSession
    square = F.aggregate(F.transform("v", lambda x: x.cast("double")), F.lit(0.0), lambda acc, x: acc + x * x)
    size = c.agg(F.count("*").alias("n"), F.coalesce(F.max(square), F.lit(0.0)).alias("longest")).first()
    space = _Space(metric, size["longest"])
    number = int(min(PIVOTS, max(1, math.isqrt(size["n"])), max(1, NEAR_DISTANCES // max(1, k))))
    drawn = c.orderBy(F.xxhash64("item_id"), "item_id").limit(number).collect()  # at most PIVOTS rows
    if not drawn:
        none = c.select("item_id", "v", F.lit(0).alias("i"))
        return none, q.select("query_id", "v", F.lit(0).alias("i")), ["i"]
    pivots = space.points(np.array([r["v"] for r in drawn], dtype="float64"), True)
    items, asked = _in_cells(c, space, pivots, True), _in_cells(q, space, pivots, False)
    order = Window.partitionBy("cell").orderBy("far")
    close = items.select("cell", "far", F.row_number().over(order).alias("r")).where(F.col("r") <= k)
    near: dict[int, list[float]] = {}
    for r in close.select("cell", "far").collect():  # at most NEAR_DISTANCES rows
        near.setdefault(r["cell"], []).append(r["far"])
    spans = {r["cell"]: r for r in items.groupBy("cell").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.count("*").alias("n")).collect()}
    wide = {r["cell"]: r for r in asked.groupBy("cell").agg(F.max("far").alias("hi"), F.count("*").alias("n")).collect()}
    reach = cell_reach(pivots, {j: np.array(v) for j, v in near.items()}, {i: r["hi"] for i, r in wide.items()}, k)
    between = _distances(pivots, pivots)
    routes = []
    for i, w in wide.items():
        # scores are rounded, and distances are roots of differences
        limit = max(math.sqrt(reach[i] ** 2 + SLACK), reach[i] + 2e-6) + 1e-7 * (1 + math.sqrt(size["longest"]))
        low, high = between[i] - w["hi"] - limit, between[i] + w["hi"] + limit
        met = [j for j, s in spans.items() if s["hi"] >= low[j] and s["lo"] <= high[j]]
        blocks = max(1, math.ceil(sum(spans[j]["n"] for j in met) / block_rows))
        turns = max(1, math.ceil(w["n"] / block_rows))
        routes += [(j, i, float(low[j]), float(high[j]), blocks, turns) for j in met]
    # one row for each two cells: at most PIVOTS * PIVOTS
    route = F.broadcast(spark.createDataFrame(routes, "cell int, i int, low double, high double, blocks int, turns int"))
    copies = items.join(route, "cell").where("far BETWEEN low AND high")
    left = copies.select(
        "item_id", "v", "i", F.pmod(F.xxhash64("item_id"), F.col("blocks")).cast("int").alias("b"),
        F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("t"),
    )
    sides = route.select(F.col("i").alias("cell"), "blocks", "turns").distinct()
    right = asked.join(F.broadcast(sides), "cell").select(
        "query_id", "v", F.col("cell").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"),
        F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int").alias("t"),
    )
    return left, right, ["i", "b", "t"]


def copied_rows(corpus: DataFrame, queries: DataFrame, k: int, corpus_id="item_id", corpus_vec="vector", query_id="query_id", query_vec="vector", metric="dot", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row: corpus rows that the cells of queries get, and that all pairs of blocks would copy."""
    c = corpus.select(ref(corpus_id).alias("item_id"), ref(corpus_vec).alias("v")).where("v IS NOT NULL")
    q = queries.select(ref(query_id).alias("query_id"), ref(query_vec).alias("v")).where("v IS NOT NULL")
    left, right, _ = _voronoi_groups(c, q, k, metric, block_rows)
    cells = right.select("i").distinct().count()
    every = F.lit(cells) * F.lit(c.count())
    return left.agg(F.count("*").alias("rows_copied")).withColumn("rows_of_all_cells", every.cast("long"))


def top_per_query(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
