"""Shared plans against NumPy and pandas, with hot groups and several partitionings."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablewise.operators.features import text_vectors
from tablewise.plans import nearest as searches
from tablewise.plans import quantiles, shape
from tablewise.plans.nearest import copied_rows, nearest
from tablewise.plans.ordering import row_index, running_sums, value_ranks
from tablewise.plans.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    n = 3000
    return pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 40, n).astype(str)),
            "x": np.round(rng.normal(size=n), 2),
            "id": np.arange(n),
        }
    )


@pytest.mark.parametrize("parts", [1, 8])
def test_quantiles_equal_numpy_on_both_paths(spark, distributed, skewed, parts):
    df = spark.createDataFrame(skewed).repartition(parts)
    row = exact_quantiles(df, ["x"], [0.0, 0.05, 0.5, 0.95, 1.0]).first()
    assert np.allclose(row["quantiles"], np.quantile(skewed["x"], [0.0, 0.05, 0.5, 0.95, 1.0]))
    got = {r["g"]: r["quantiles"][0] for r in exact_quantiles(df, ["x"], [0.3], ["g"]).collect()}
    want = skewed.groupby("g")["x"].quantile(0.3)
    assert np.allclose([got[k] for k in want.index], want.to_numpy())


def test_running_sums_and_index_keep_order_in_a_hot_group(spark, skewed):
    df = spark.createDataFrame(skewed).repartition(8)
    out = running_sums(df.withColumn("one", F.lit(1)), ["x", "id"], ["one"], ["g"]).toPandas()
    want = skewed.sort_values(["x", "id"]).assign(b=lambda d: d.groupby("g").cumcount())
    merged = out.merge(want[["id", "b"]], on="id")
    assert (merged["one_before"] == merged["b"]).all()
    idx = row_index(df, ["x", "id"]).orderBy("row_idx").toPandas()
    assert (idx["id"].to_numpy() == skewed.sort_values(["x", "id"])["id"].to_numpy()).all()


def test_average_ranks(spark, skewed):
    out = value_ranks(spark.createDataFrame(skewed), "x").toPandas().set_index("x")["avg_rank"]
    want = skewed["x"].rank()
    assert np.allclose(out.loc[skewed["x"]].to_numpy(), want.to_numpy())


@pytest.mark.parametrize("limit", [10**9, 0])
@pytest.mark.parametrize("metric", ["dot", "euclidean"])
def test_nearest_equals_brute_force(spark, limit, metric):
    rng = np.random.default_rng(1)
    c, q = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    cdf = spark.createDataFrame(pd.DataFrame({"item_id": range(300), "vector": c.tolist()}))
    qdf = spark.createDataFrame(pd.DataFrame({"query_id": range(40), "vector": q.tolist()}))
    out = nearest(cdf, qdf, 4, metric=metric, max_query_bytes=limit, block_rows=64).toPandas()
    score = q @ c.T if metric == "dot" else -np.linalg.norm(q[:, None] - c[None], axis=2)
    for i in range(40):
        want = np.argsort(-score[i], kind="stable")[:4]
        assert out[out.query_id == i].sort_values("rank")["item_id"].tolist() == want.tolist()


@pytest.mark.parametrize("metric", ["dot", "euclidean"])
@pytest.mark.parametrize("skip", [False, True])
def test_pivots_lose_no_neighbour(spark, metric, skip, monkeypatch):
    """Clustered points with copies, ties and unequal lengths, products of few rows, against all pairs."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 20, (12, 5))
    items = np.round(np.concatenate([c + rng.normal(0, 0.4, (60, 5)) for c in centres] + [centres[:1].repeat(20, 0)]), 3)
    queries = np.concatenate([items[::7], rng.normal(0, 30, (10, 5)), np.zeros((1, 5))])
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)] + [(9999, None)], "item_id long, vector array<double>")
    qdf = spark.createDataFrame([(i * 7 if i * 7 < len(items) else 10_000 + i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vector array<double>")
    monkeypatch.setattr("tablewise.plans.nearest.PRODUCT_BYTES", 4096)
    out = nearest(cdf, qdf, 6, metric=metric, skip_self=skip, max_query_bytes=0, block_rows=100).toPandas()
    for qid, v in ((r.query_id, np.array(r.vector)) for r in qdf.collect()):
        score = items @ v if metric == "dot" else -np.sqrt(((items - v) ** 2).sum(1))
        score = np.round(score, 6)
        if skip and qid < len(items):
            score[qid] = -np.inf
        want = np.lexsort((np.arange(len(items)), -score))[:6]
        mine = out[out.query_id == qid].sort_values("rank")
        assert np.allclose(mine.score, score[want], atol=2e-6)
        if metric == "euclidean" and not skip:
            assert mine.item_id.tolist()[:1] == want.tolist()[:1]
    if metric == "euclidean":
        near = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items[::5])], "query_id long, vector array<double>")
        cost = copied_rows(cdf, near, 6, metric=metric, block_rows=100).first()
        assert cost.rows_copied < cost.rows_of_all_cells / 4


def test_many_values_in_a_small_file_are_not_merged_in_one_task(spark, tmp_path, monkeypatch):
    from tablewise.operators import profile
    from tablewise.plans import quantiles

    spark.range(20_000).selectExpr("id", "id % 7 AS few", "cast(null AS double) AS none").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda: profile.numeric_summary(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" in plan()
    want = sorted(map(str, profile.numeric_summary(df).collect()))
    monkeypatch.setattr(quantiles, "INLINE_VALUES", 50_000)
    assert "percentile(" not in plan()
    assert sorted(map(str, profile.numeric_summary(df).collect())) == want


def test_small_forest_fits_remember_places(spark):
    from tablewise.operators import train

    for task in ("regression", "classification"):
        assert train.estimator(task, "random_forest", 1000, params={"trees": 300, "depth": 30, "leaf": 1}).getCacheNodeIds()
        assert not train.estimator(task, "random_forest", train.CACHED_PLACES).getCacheNodeIds()


def test_forest_walk_in_levels():
    import numpy as np

    from tablewise.operators.mine import _depths, _grow, _in_levels

    rng = np.random.default_rng(3)
    pool = np.stack([rng.integers(0, 5, 700), rng.normal(size=700)], 1).astype(float)
    x = np.concatenate([pool, [[np.inf, -np.inf], [-np.inf, np.inf], [2.0, 0.0]]])
    raw = [tuple(map(np.array, _grow(pool, np.random.default_rng(i), rows))) for i, rows in enumerate((1, 2, 50, 256))]
    want = np.zeros(len(x))
    for f, t, left, v in raw:
        for i, row in enumerate(x):
            node = 0
            while f[node] >= 0:
                node = left[node] + int(row[f[node]] > t[node])
            want[i] += v[node]
    assert np.array_equal(_depths(x, [_in_levels(*r) for r in raw]), want)


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    from tablewise.sources.tables import LISTING_TASKS, read_corpus

    few = 4 * spark.sparkContext.defaultParallelism
    for i in range(2 * few):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a.txt").write_text(f"text {i}")
    before, tracker = spark.conf.get(LISTING_TASKS), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    files = read_corpus(spark, str(tmp_path))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert max(tracker.getStageInfo(s).numTasks for s in stages) <= few
    assert spark.conf.get(LISTING_TASKS) == before
    assert {r.text for r in files.collect()} == {f"text {i}" for i in range(2 * few)}


def _forks():
    with open("/proc/stat") as stat:
        return int(next(line for line in stat if line.startswith("processes")).split()[1])


@pytest.mark.parametrize("folder_files", [1_000, 3])
def test_corpus_files_need_no_processes_and_few_tasks(spark, tmp_path, monkeypatch, folder_files):
    import workload
    from tablewise.sources import tables

    monkeypatch.setattr(tables, "FOLDER_FILES", folder_files, raising=False)
    rows = [(i, f"<p>\r\n{i} é</p>" * (i % 4)) for i in range(400)] + [(7, "again"), (7, None), (900, None), (901, ""), (902, "é\n" * 40_000)]
    table = spark.createDataFrame(rows, "page_id long, html string").repartition(5)
    table.write.parquet(str(tmp_path / "pages.parquet"))
    spark.range(1).mapInArrow(lambda batches: batches, "id long").count()
    before = _forks()
    read = workload.QUERIES["corpus_round_trip_pages"](spark, str(tmp_path))
    assert _forks() - before < 400
    assert read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    # rows of one page are lines of its file, and the reader gives each line
    assert sorted(tuple(r) for r in read.collect()) == sorted((i, len(html or "")) for i, html in rows)


def test_corpus_files_hold_all_rows_of_a_name(spark, tmp_path):
    from tablewise.sources.tables import read_corpus, write_corpus

    rows = spark.createDataFrame([("a/b c%", "x"), ("é=1", "y\nz"), (None, "none"), ("", "empty"), (None, None)], "name string, text string")
    write_corpus(rows, str(tmp_path / "some"), "name", "text")
    files = {f.name: f.read_text() for f in (tmp_path / "some").rglob("*") if f.is_file()}
    assert files == {"name=a%2Fb c%25.txt": "x\n", "name=%C3%A9%3D1.txt": "y\nz\n", "name=__HIVE_DEFAULT_PARTITION__.txt": "\nempty\nnone\n"}
    write_corpus(rows.limit(0), f"file:{tmp_path}/none", "name", "text")
    assert read_corpus(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileExistsError):
        write_corpus(rows, str(tmp_path / "some"), "name", "text")


def test_quantiles_of_a_scan_sort_few_slices(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=20_000).round(2), np.full(5_000, 0.5)])
    rng.shuffle(x)
    y = np.where(rng.random(len(x)) < 0.1, np.nan, rng.normal(size=len(x)))
    table = pa.table({"x": x, "y": pa.array(y, mask=np.isnan(y)), "none": pa.nulls(len(x), pa.float64())})
    pq.write_table(table, tmp_path / "t.parquet", row_group_size=500)
    df = spark.read.parquet(str(tmp_path / "t.parquet"))
    monkeypatch.setattr(quantiles, "INLINE_VALUES", 0)
    monkeypatch.setattr(quantiles, "SLICE_VALUES", 1_000)
    monkeypatch.setattr(shape, "SPLIT_VALUES", 5_000)
    sorted_rows = []
    picked = quantiles.null_safe_join

    def joined(left, right, keys, *how):
        out = picked(left, right, keys, *how)
        sorted_rows.append((out.count(), left.count()))
        return out

    monkeypatch.setattr(quantiles, "null_safe_join", joined)
    probs = [0.0, 0.01, 0.5, 0.95, 1.0]
    got = {r["column"]: r["quantiles"] for r in exact_quantiles(df, ["x", "y", "none"], probs).collect()}
    assert set(got) == {"x", "y"}
    np.testing.assert_allclose(got["x"], np.quantile(x, probs))
    np.testing.assert_allclose(got["y"], np.quantile(y[~np.isnan(y)], probs))
    assert sorted_rows[0][0] * 2 < sorted_rows[0][1]


def test_short_splits_cut_scans_and_end(spark, tmp_path, monkeypatch):
    pq.write_table(pa.table({"x": np.random.default_rng(1).normal(size=40_000)}), tmp_path / "t.parquet", row_group_size=1_000)
    monkeypatch.setattr(shape, "SPLIT_VALUES", 2_000)
    read, key = lambda: spark.read.parquet(str(tmp_path / "t.parquet")), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    with shape.short_splits(read(), 40_000):
        assert read().rdd.getNumPartitions() >= 15
        assert max(read().rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) <= 4_000
    assert spark.conf.get(key) == before
    with shape.short_splits(read(), 2_000):
        assert spark.conf.get(key) == before


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_equal_vectors_are_asked_and_kept_once(spark, monkeypatch, small):
    """Few different vectors on both sides, ids that repeat or are missing, a query side too large to travel as it is."""
    rng = np.random.default_rng(11)
    grid = rng.integers(0, 3, (9, 3)).astype(float)
    items = [(int(i % 290), grid[j].tolist()) for i, j in enumerate(rng.integers(0, 9, 300))]
    queries = [(None if i == 7 else int(i), grid[j].tolist()) for i, j in enumerate(rng.integers(0, 9, 60))]
    searched = []

    def seen(name):
        real = getattr(searches, name)

        def run(c, q, *rest):
            searched.append((name, c.count(), q.count()))
            return real(c, q, *rest)

        monkeypatch.setattr(searches, name, run)

    seen("_scan")
    seen("_in_groups")
    sizes = iter([1 << 30, 1 << 30 if not small else 0])
    monkeypatch.setattr(searches, "_query_bytes", lambda q: next(sizes))
    c = spark.createDataFrame(items, "item_id long, v array<double>")
    q = spark.createDataFrame(queries, "query_id long, v array<double>")
    got = nearest(c, q, 4, "item_id", "v", "query_id", "v", metric="euclidean", max_query_bytes=small).collect()
    different = len({tuple(v) for _, v in queries})
    assert searched == [("_scan" if small else "_in_groups", searched[0][1], different)]
    assert searched[0][1] <= 4 * len({tuple(v) for _, v in items})
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["item_id"], r["score"]))
    assert len(by) == 60
    for i, v in queries:
        far = sorted((round(float(np.linalg.norm(np.array(v) - np.array(w))), 6), j) for j, w in items)[:4]
        assert [(j, -d) for d, j in far] == [(j, s) for _, j, s in sorted(by[i])]


@pytest.mark.parametrize("metric", ["dot", "euclidean"])
def test_a_product_is_held_once(metric):
    rng = np.random.default_rng(2)
    q, c = rng.normal(size=(500, 8)), rng.normal(size=(4000, 8))
    tracemalloc.start()
    searches._product(np.arange(500), q, np.arange(4000), c, 3, metric, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * 8 * 500 * 4000


def test_text_vectors_read_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        read.add(1)
        return None if i == 5 else f"word{i % 7} other{i % 3} word{i % 4}"

    df = spark.range(60).select(text("id").alias("text"))
    fitted = text_vectors(df, "text", dims=4, features=64)
    assert read.value <= 2 * 60  # once in the filter for missing texts, once for the words
    assert len(fitted.stages) == 4
    assert len(fitted.transform(df.where("text IS NOT NULL")).first()["text__vector"]) == 4
