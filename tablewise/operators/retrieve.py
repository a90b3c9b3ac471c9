"""Text chunks, keyword and vector search, retrieval evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.columns import ref, require_between, require_columns, word_tokens
from tablewise.operators.keyword import KeywordIndex, best_documents, build_index, search_blocks
from tablewise.plans.nearest import SCORE_DIGITS, nearest, top_per_query
from tablewise.plans.shape import spread, stored

# Fixed parameters.
BM25_WEIGHT = 0.3
POOL_FACTOR = 3
RERANK_FACTOR = 4
MIN_SCORE = 0.25
TOP_K = 6
MAX_CHARS, OVERLAP = 1200, 150
QUERY_CHARS = (30, 200)
QUERY_WORDS = 5
QUERY_SOURCES, QUERY_CHUNKS = 15, 5
PREVIEW_CHARS, PREVIEW_SOURCES = 200, 20


# ---- chunking ----


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _strings(*values: Column) -> Column:
    return F.array(*values) if values else F.array().cast("array<string>")


def _merged_sentences(text: Column, max_chars: int) -> Column:
    """Sentences joined by a space as long as they fit."""
    start = F.struct(_strings().alias("done"), F.lit("").alias("open"))

    def add(acc: Column, sentence: Column) -> Column:
        fits = F.length(acc["open"]) + 1 + F.length(sentence) <= max_chars
        return (
            F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), sentence.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(" "), sentence).alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(_strip(acc["open"]))).alias("done"), sentence.alias("open")))
        )

    def close(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(_strip(acc["open"]))))

    return F.aggregate(F.split(text, r"(?<=[.!?])(?U)\s+"), start, add, close)


def _cut(unit: Column, max_chars: int, overlap: int) -> Column:
    """Pieces of a unit that no boundary can split, stepping so that they overlap."""
    starts = F.sequence(F.lit(1), F.length(unit), F.lit(max(1, max_chars - overlap)))
    return F.transform(starts, lambda s: _strip(F.substring(unit, s, F.lit(max_chars))))


def chunks(text: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Array of chunks of a text: paragraphs are merged up to ``max_chars``, longer ones fall
    back to sentences and then to plain cuts; each chunk repeats the tail of the one before."""
    paragraphs = F.filter(F.transform(F.split(_strip(text), r"\n{2,}"), _strip), lambda p: p != "")
    units = F.flatten(
        F.transform(
            paragraphs,
            lambda p: F.when(F.length(p) <= max_chars, F.array(p)).otherwise(_merged_sentences(p, max_chars)),
        )
    )
    start = F.struct(_strings().alias("done"), F.lit("").alias("open"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    def add(acc: Column, unit: Column) -> Column:
        gap = F.when(acc["open"] == "", 0).otherwise(2)
        fits = F.length(acc["open"]) + gap + F.length(unit) <= max_chars
        joined = F.when(acc["open"] == "", unit).otherwise(F.concat(acc["open"], F.lit("\n\n"), unit))
        return (
            F.when(fits, F.struct(acc["done"].alias("done"), joined.alias("open")))
            .when(F.length(unit) <= max_chars, F.struct(flushed(acc).alias("done"), unit.alias("open")))
            .otherwise(
                F.struct(F.concat(flushed(acc), _cut(unit, max_chars, overlap)).alias("done"), F.lit("").alias("open"))
            )
        )

    raw = F.aggregate(units, start, add, flushed)
    if overlap <= 0:
        return F.filter(raw, lambda c: c != "")

    def with_tail(chunk: Column, i: Column, all_chunks: Column) -> Column:
        tail = _strip(F.right(F.try_element_at(all_chunks, i), F.lit(overlap)))
        plain = (i == 0) | (tail == "") | F.startswith(chunk, tail)
        return F.when(plain, F.when(i == 0, chunk).otherwise(_strip(chunk))).otherwise(
            _strip(F.concat(tail, F.lit("\n\n"), chunk))
        )

    # The inner lambda needs the whole array: bind it through a one-element transform.
    tailed = F.transform(
        F.array(raw), lambda a: F.transform(a, lambda c, i: F.when(i == 0, c).otherwise(with_tail(c, F.greatest(i, F.lit(1)), a)))
    )[0]
    return F.filter(tailed, lambda c: c != "")


def chunk_documents(
    df: DataFrame, text_col: str, source_col: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP
) -> DataFrame:
    """``source, chunk, source_id, text``: one row per chunk, ids read ``source#chunk=i``."""
    require_columns(df, text_col, source_col)
    body = F.coalesce(F.col("_t"), F.lit(""))
    texts = spread(df.select(ref(source_col).alias("source"), ref(text_col).alias("_t")))
    pieces = texts.select(F.col("source").alias("source"), F.posexplode(chunks(body, max_chars, overlap)).alias("chunk", "text"))
    return pieces.select(
        "source", "chunk", F.concat(F.col("source").cast("string"), F.lit("#chunk="), F.col("chunk")).alias("source_id"), "text"
    )


# ---- keyword search ----


def _token_rows(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """``<name>, doc_len, term``: one row per token.

    The token array is built and measured below the explode; measuring it above would repeat
    the split for every token.
    """
    texts = spread(docs.select(ref(id_col).alias(name), ref(text_col).alias("_t")))
    split = texts.select(name, word_tokens(F.col("_t")).alias("_w"))
    sized = split.select(name, "_w", F.size("_w").alias("doc_len"))
    # The outer form keeps the optimizer from testing the array (a second split) before the explode.
    return sized.select(name, "doc_len", F.explode_outer("_w").alias("term")).where(F.col("term").isNotNull())


def bm25_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, term, tf, doc_len``. Write it bucketed by term to search it repeatedly."""
    rows = _token_rows(docs, id_col, text_col, "doc_id")
    return rows.groupBy("doc_id", "doc_len", "term").agg(F.count("*").alias("tf")).select("doc_id", "term", "tf", "doc_len")


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def bm25_search(
    docs: DataFrame,
    queries: DataFrame,
    top_k: int = TOP_K,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id: str = "query_id",
    query_text: str = "query",
) -> DataFrame:
    """``query_id, item_id, score, rank`` for all queries at once.

    The documents are tokenised once, into stored postings. For many searches make a ``keyword_index``.
    """
    index = stored(bm25_index(docs, id_col, text_col))
    return search_index(index, docs.count(), queries, top_k, query_id, query_text)


def keyword_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> KeywordIndex:
    return build_index(bm25_index(docs, id_col, text_col), docs.count())


def search_index(
    index: DataFrame, documents: int, queries: DataFrame, top_k: int = TOP_K, query_id: str = "query_id", query_text: str = "query"
) -> DataFrame:
    """Search the postings of :func:`bm25_index`, of which ``documents`` is the number of documents.

    Document frequencies, lengths and scores all come from the postings; repeated query terms add up.
    Scores are summed in fixed point, so that they do not depend on the order of the rows.
    """
    total = index.agg(F.sum("tf")).first()[0] or 0
    average = total / documents if total else 1.0
    asked = (
        queries.select(ref(query_id).alias("query_id"), F.explode(word_tokens(ref(query_text))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )
    terms = asked.select("term").distinct()
    wanted = index.join(terms, "term", "left_semi")
    df = F.col("df")
    weights = document_frequency(wanted).select("term", F.ln((documents - df + 0.5) / (df + 0.5) + 1).alias("idf"))
    return best_documents(index, average, stored(asked.join(weights, "term")), top_k)


# ---- vector and hybrid search ----


def cosine_topk(
    corpus: DataFrame,
    queries: DataFrame,
    top_k: int = TOP_K,
    id_col: str = "item_id",
    vec_col: str = "vector",
    query_id: str = "query_id",
    query_vec: str = "vector",
) -> DataFrame:
    """Inner product of unit vectors."""
    return nearest(corpus, queries, top_k, id_col, vec_col, query_id, query_vec)


def unit(vec: Column) -> Column:
    """Vector scaled to length one; a zero vector stays as it is."""
    v = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def blend_query_vectors(df: DataFrame, query_vec: str, answer_vec: str, name: str = "vector") -> DataFrame:
    """Direction halfway between a query and a hypothetical answer; the query alone without one."""
    q, a = ref(query_vec), ref(answer_vec)
    both = unit(F.zip_with(q, a, lambda x, y: x.cast("double") + y.cast("double")))
    return df.withColumn(name, F.when(a.isNull(), F.transform(q, lambda x: x.cast("double"))).otherwise(both))


def hybrid_search(
    docs: DataFrame,
    queries: DataFrame,
    top_k: int = TOP_K,
    bm25_weight: float = BM25_WEIGHT,
    id_col: str = "doc_id",
    text_col: str = "text",
    vec_col: str = "vector",
    query_id: str = "query_id",
    query_text: str = "query",
    query_vec: str = "query_vector",
    index: KeywordIndex | None = None,
) -> DataFrame:
    """Both searches give a pool of three times ``top_k``; scores of the union are blended, the
    keyword side relative to its best score per query, a missing side counting as 0. ``index`` is a
    keyword index of the same documents; without one they are tokenised here."""
    require_between("bm25_weight", bm25_weight, 0.0, 1.0)
    pool = top_k * POOL_FACTOR
    by_vec = cosine_topk(docs, queries, pool, id_col, vec_col, query_id, query_vec)
    if index is None:
        by_word = bm25_search(docs, queries, pool, id_col, text_col, query_id, query_text)
    else:
        by_word = search_blocks(index, queries, pool, query_id, query_text)
    # At most ``pool`` rows per query on either side.
    best = F.max("score").over(Window.partitionBy("query_id"))
    word = by_word.select("query_id", "item_id", (F.col("score") / F.greatest(best, F.lit(1e-9))).alias("word"))
    vec = by_vec.select("query_id", "item_id", F.col("score").alias("cosine"))
    mixed = vec.join(word, ["query_id", "item_id"], "full").select(
        "query_id",
        "item_id",
        F.round(
            (1 - bm25_weight) * F.coalesce("cosine", F.lit(0.0)) + bm25_weight * F.coalesce("word", F.lit(0.0)), SCORE_DIGITS
        ).alias("score"),
    )
    return top_per_query(mixed, top_k)


def rerank(
    hits: DataFrame, scorer: Callable[[Column, Column], Column] | None, top_k: int = TOP_K, query_text="query", text="text"
) -> DataFrame:
    """Order candidates by a user's (query, passage) scorer; without one they pass through."""
    if scorer is None:
        return hits.where(F.col("rank") <= top_k)
    return top_per_query(hits.drop("rank").withColumn("score", scorer(ref(query_text), ref(text)).cast("double")), top_k)


def retrieve(
    docs: DataFrame,
    queries: DataFrame,
    top_k: int = TOP_K,
    min_score: float = MIN_SCORE,
    scorer: Callable[[Column, Column], Column] | None = None,
    **columns,
) -> DataFrame:
    """Hybrid hits at or above the floor; with a scorer a wider pool is filtered, then reordered."""
    wide = top_k * RERANK_FACTOR if scorer is not None else top_k
    hits = hybrid_search(docs, queries, wide, **columns).where(F.col("score") >= min_score)
    if scorer is None:
        return hits
    doc_id, text = columns.get("id_col", "doc_id"), columns.get("text_col", "text")
    q_id, q_text = columns.get("query_id", "query_id"), columns.get("query_text", "query")
    full = hits.join(docs.select(ref(doc_id).alias("item_id"), ref(text).alias("text")), "item_id").join(
        queries.select(ref(q_id).alias("query_id"), ref(q_text).alias("query")), "query_id"
    )
    return rerank(full, scorer, top_k).select("query_id", "item_id", "score", "rank")


# ---- evaluation ----


def retrieval_eval(hits: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """One row: recall at 1, 3 and 5, precision at k and mean reciprocal rank.

    ``hits``: query_id, rank, source. ``expected``: query_id, source (one row per right source).
    """
    right = expected.select("query_id", ref("source").alias("source"), F.lit(1).alias("_hit")).distinct()
    marked = hits.where(F.col("rank") <= k).join(right, ["query_id", "source"], "left")
    per = marked.groupBy("query_id").agg(
        F.min(F.when(F.col("_hit") == 1, F.col("rank"))).alias("first"), F.count("_hit").alias("found")
    )
    q = right.select("query_id").distinct().join(per, "query_id", "left")

    def recall(at: int) -> Column:
        return F.round(F.avg(F.coalesce((F.col("first") <= at).cast("double"), F.lit(0.0))), 3).alias(f"recall_at_{at}")

    return q.agg(
        F.count("*").alias("n_queries"),
        recall(1),
        recall(3),
        recall(5),
        F.round(F.avg(F.coalesce("found", F.lit(0)) / k), 3).alias("precision_at_k"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 3).alias("mrr"),
    )


def self_recall_queries(chunk_rows: DataFrame, max_sources: int | None = QUERY_SOURCES) -> DataFrame:
    """``source, query``: the first prose-like sentence of a source's first five chunks."""
    low, high = QUERY_CHARS
    sentences = F.transform(F.split(_strip(F.col("text")), r"[.!?\n]"), _strip)
    rows = chunk_rows.where(F.col("chunk") < QUERY_CHUNKS).select(
        "source", "chunk", F.posexplode(sentences).alias("pos", "query")
    )
    words = F.size(F.filter(F.split("query", r"\s+"), lambda w: w != ""))
    letters = F.length(F.regexp_replace("query", r"[^\p{L}]", ""))
    good = F.length("query").between(low, high) & (words >= QUERY_WORDS) & (letters / F.length("query") >= 0.5)
    out = (
        rows.where(F.col("query") != "")
        .where(good)
        .groupBy("source")
        .agg(F.min_by("query", F.struct("chunk", "pos")).alias("query"))
    )
    return out if max_sources is None else out.orderBy("source").limit(max_sources)


def index_stats(chunk_rows: DataFrame) -> DataFrame:
    return chunk_rows.agg(F.count("*").alias("total_chunks"), F.count_distinct("source").alias("unique_sources"))


def index_samples(chunk_rows: DataFrame) -> DataFrame:
    """First chunk of up to twenty sources, shortened for display."""
    first = chunk_rows.groupBy("source").agg(
        F.min_by("source_id", "chunk").alias("source_id"), F.min_by("text", "chunk").alias("text")
    )
    return first.orderBy("source").limit(PREVIEW_SOURCES).select(
        "source", "source_id", F.translate(F.substring("text", 1, PREVIEW_CHARS), "\n", " ").alias("text_preview")
    )
