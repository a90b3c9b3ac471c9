"""Chunks and search over documents; benchmark passages are the queries."""

from pyspark.sql import functions as F

from tablewise.functions.columns import word_tokens
from tablewise.operators import keyword, retrieve
from tablewise.plans.nearest import nearest
from tablewise.plans.shape import stored
from workload.profiling import _rounded
from workload.registry import query


@query(
    "token_counts_documents",
    """SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::INT AS tokens,
       len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::INT AS distinct_tokens FROM documents""",
)
def _(t):
    w = word_tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(w).alias("tokens"), F.size(F.array_distinct(w)).alias("distinct_tokens"))


@query(
    "bm25_index_documents",
    """SELECT doc_id, term, count(*) AS tf, any_value(n)::INT AS doc_len FROM (SELECT doc_id, unnest(w) AS term, len(w) AS n FROM
       (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)) GROUP BY doc_id, term""",
)
def _(t):
    return retrieve.bm25_index(t.documents, "doc_id", "text")


@query(
    "document_frequency_documents",
    """SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term""",
)
def _(t):
    return retrieve.document_frequency(retrieve.bm25_index(t.documents, "doc_id", "text"))


def _bm25_ctes(source: str, queries: str, k: int) -> str:
    return f"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {source}),
  z AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS al FROM w),
  p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(w) AS term, len(w) AS dl FROM w) GROUP BY doc_id, term),
  i AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM p, z GROUP BY term),
  q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {queries}) GROUP BY ALL),
  s AS (SELECT query_id, doc_id AS item_id, round(sum((qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al)))::DECIMAL(28, 12)), 6)::DOUBLE AS score
        FROM q JOIN p USING (term) JOIN i USING (term), z GROUP BY query_id, doc_id),
  kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= {k})"""


@query("bm25_search_benchmark", "WITH " + _bm25_ctes("documents", "benchmark", 6) + " SELECT query_id, item_id, score, rank FROM kw")
def _(t):
    return retrieve.bm25_search(t.documents, t.benchmark, query_id="item_id", query_text="text")


@query("bm25_search_stored_index", "WITH " + _bm25_ctes("documents", "benchmark", 6) + " SELECT query_id, item_id, score, rank FROM kw")
def _(t):
    index = stored(retrieve.bm25_index(t.documents, "doc_id", "text"))
    return retrieve.search_index(index, t.documents.count(), t.benchmark, query_id="item_id", query_text="text")


_CENTROIDS = """c AS (SELECT label, list(v ORDER BY d) AS v FROM (SELECT label, d, avg(embedding[d]::DOUBLE) AS v FROM embeddings,
  (SELECT unnest(range(1, 65)) AS d) GROUP BY label, d) GROUP BY label),
  u AS (SELECT label AS query_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM c)"""


def centroids(t):
    """Mean direction of each label, dimension by dimension so that no group is collected."""
    dims = t.embeddings.select("label", F.posexplode("embedding").alias("d", "x"))
    means = dims.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("v"))
    return vectors.select(F.col("label").alias("query_id"), retrieve.unit(F.col("v")).alias("vector"))


@query(
    "cosine_topk_centroids",
    "WITH "
    + _CENTROIDS
    + """, s AS (SELECT query_id, vec_id AS item_id, round(list_inner_product(v, embedding::DOUBLE[]), 6) AS score FROM embeddings, u)
    SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM s) WHERE rank <= 10""",
)
def _(t):
    return retrieve.cosine_topk(t.embeddings, centroids(t), 10, "vec_id", "embedding")


@query(
    "blend_query_vectors",
    """SELECT d.vec_id, len(d.embedding)::INT AS dims, round(list_inner_product(d.embedding::DOUBLE[], b.v), 6) AS with_query FROM embeddings d JOIN (
         SELECT vec_id, list_transform(s, lambda x: x / sqrt(list_sum(list_transform(s, lambda y: y * y)))) AS v FROM (
           SELECT e.vec_id, list_transform(range(1, 65), lambda i: e.embedding[i]::DOUBLE + h.embedding[i]::DOUBLE) AS s FROM embeddings e JOIN embeddings h ON h.vec_id = e.vec_id + 1)) b USING (vec_id)""",
)
def _(t):
    e = t.embeddings
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("answer"))
    out = retrieve.blend_query_vectors(e.join(nxt, "vec_id"), "embedding", "answer")
    dot = F.aggregate(F.zip_with("embedding", "vector", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", F.size("embedding").alias("dims"), F.round(dot, 6).alias("with_query"))


def _vector_docs(t):
    return t.documents.join(t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left")


def _vector_queries(t):
    v = t.embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vector"))
    return t.benchmark.withColumnRenamed("text", "query").join(v, "item_id", "left")


_COLUMNS = {"query_id": "item_id", "query_text": "query"}


def _hybrid_sql(k):
    return (
        "WITH dv AS (SELECT doc_id, text, embedding AS v FROM documents LEFT JOIN embeddings ON doc_id = vec_id), "
        "qv AS (SELECT item_id, text, embedding AS v FROM benchmark LEFT JOIN embeddings ON item_id = vec_id), "
        + _bm25_ctes("dv", "qv", 3 * k)
        + f""", cs AS (SELECT qv.item_id AS query_id, dv.doc_id AS item_id, round(list_inner_product(qv.v::DOUBLE[], dv.v::DOUBLE[]), 6) AS score FROM dv, qv WHERE dv.v IS NOT NULL AND qv.v IS NOT NULL),
  cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM cs) WHERE r <= {3 * k}),
  m AS (SELECT query_id, max(score) AS top FROM kw GROUP BY query_id),
  h AS (SELECT query_id, item_id, round(0.7 * coalesce(cp.score, 0) + 0.3 * coalesce(kw.score / greatest(top, 1e-9), 0), 6) AS score
        FROM cp FULL JOIN kw USING (query_id, item_id) LEFT JOIN m USING (query_id)),
  r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM h) WHERE rank <= {k})"""
    )


@query("hybrid_search_benchmark", _hybrid_sql(6) + " SELECT query_id, item_id, round(score, 4) AS score, rank FROM r")
def _(t):
    return _rounded(retrieve.hybrid_search(_vector_docs(t), _vector_queries(t), **_COLUMNS), "score")


@query("retrieve_with_floor", _hybrid_sql(6) + " SELECT query_id, item_id, round(score, 4) AS score, rank FROM r WHERE score >= 0.25")
def _(t):
    return _rounded(retrieve.retrieve(_vector_docs(t), _vector_queries(t), **_COLUMNS), "score")


def _closeness(q, passage):
    """A stand-in scorer: shared distinct words over the query's distinct words."""
    a, b = F.array_distinct(word_tokens(q)), F.array_distinct(word_tokens(passage))
    return F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)), 6)


@query(
    "retrieve_reranked",
    _hybrid_sql(24)
    + """, f AS (SELECT r.query_id, r.item_id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(qv.text), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(dv.text), '[a-z0-9]+'))))::DOUBLE
      / greatest(len(list_distinct(regexp_extract_all(lower(qv.text), '[a-z0-9]+'))), 1), 6) AS score FROM r JOIN qv ON qv.item_id = r.query_id JOIN dv ON dv.doc_id = r.item_id WHERE r.score >= 0.25)
    SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM f) WHERE rank <= 6""",
)
def _(t):
    return retrieve.retrieve(_vector_docs(t), _vector_queries(t), scorer=_closeness, **_COLUMNS)


@query(
    "retrieval_eval_labels",
    "WITH "
    + _CENTROIDS
    + """, s AS (SELECT query_id, vec_id, label, round(list_inner_product(v, embedding::DOUBLE[]), 6) AS score FROM embeddings, u),
    r AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
    p AS (SELECT query_id, min(rank) FILTER (WHERE label = query_id AND rank <= 5) AS f, count(*) FILTER (WHERE label = query_id AND rank <= 5) AS m FROM r GROUP BY query_id)
    SELECT count(*) AS n_queries, round(avg(coalesce((f <= 1)::INT, 0)), 3) AS recall_at_1, round(avg(coalesce((f <= 3)::INT, 0)), 3) AS recall_at_3,
    round(avg(coalesce((f <= 5)::INT, 0)), 3) AS recall_at_5, round(avg(m / 5.0), 3) AS precision_at_k, round(avg(coalesce(1.0 / f, 0)), 3) AS mrr FROM p""",
)
def _(t):
    hits = retrieve.cosine_topk(t.embeddings, centroids(t), 5, "vec_id", "embedding")
    labelled = hits.join(t.embeddings.select(F.col("vec_id").alias("item_id"), F.col("label").alias("source")), "item_id")
    expected = t.embeddings.select(F.col("label").alias("query_id"), F.col("label").alias("source")).distinct()
    return retrieve.retrieval_eval(labelled, expected)


@query("chunk_documents")
def _(t):
    return retrieve.chunk_documents(t.documents, "text", "doc_id")


@query("chunk_documents_summary")
def _(t):
    rows = retrieve.chunk_documents(t.documents, "text", "doc_id", 400, 60)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))


# A chunk table both engines can build: one chunk per conversation turn.
def _turn_chunks(t):
    return t.conversations.select(
        F.col("conv_id").alias("source"),
        F.col("turn").alias("chunk"),
        F.concat_ws("#chunk=", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("source_id"),
        "text",
    )


@query(
    "self_recall_queries_turns",
    r"""WITH s AS (SELECT conv_id AS source, turn AS chunk, unnest(p) AS query, generate_subscripts(p, 1) AS pos FROM (
      SELECT conv_id, turn, list_transform(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[.!?\n]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS p FROM conversations WHERE turn < 5))
    SELECT source, query FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY chunk, pos) AS r FROM s WHERE query <> '' AND length(query) BETWEEN 30 AND 200
      AND len(list_filter(regexp_split_to_array(query, '\s+'), lambda x: x <> '')) >= 5 AND length(regexp_replace(query, '[^\p{L}]', '', 'g'))::DOUBLE / length(query) >= 0.5) WHERE r = 1""",
)
def _(t):
    return retrieve.self_recall_queries(_turn_chunks(t), max_sources=None)


@query("index_stats_turns", "SELECT count(*) AS total_chunks, count(DISTINCT conv_id) AS unique_sources FROM conversations")
def _(t):
    return retrieve.index_stats(_turn_chunks(t))


@query(
    "index_samples_turns",
    r"""SELECT conv_id AS source, conv_id || '#chunk=' || turn AS source_id, replace(substr(text, 1, 200), chr(10), ' ') AS text_preview FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r = 1 ORDER BY conv_id LIMIT 20""",
)
def _(t):
    return retrieve.index_samples(_turn_chunks(t))


@query("bm25_search_blocks", "WITH " + _bm25_ctes("documents", "benchmark", 6) + " SELECT query_id, item_id, score, rank FROM kw")
def _(t):
    return keyword.search_blocks(retrieve.keyword_index(t.documents), t.benchmark, 6, "item_id", "text")


@query(
    "nearest_by_pivots_embeddings",
    """WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
    SELECT query_id, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM d) WHERE rank <= 3""",
)
def _(t):
    hits = nearest(t.embeddings, t.embeddings, 3, "vec_id", "embedding", "vec_id", "embedding", skip_self=True, max_query_bytes=0)
    return _rounded(hits, "score").select("query_id", "rank", "score")
