"""Search over blocks of postings against scoring everything."""

import random

import pytest

from tablewise.operators import keyword, retrieve


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    common, rare = ["the", "of", "and", "to", "in"], [f"word{i}" for i in range(400)]
    rows = []
    for i in range(600):
        n = rng.choice([0, 1, 5, 40, 40, 200])
        rows.append((i, " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(n))))
    rows += [(1000 + i, rows[50][1]) for i in range(30)] + [(2000, None), (2001, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_blocks_find_what_scoring_all_finds(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword, "BLOCK_POSTINGS", 16)
    rng = random.Random(1)
    asked = ["the", "the of", "word7", "word7 word8 the the", "unknown", "", "and word9 of to in word1", "word3 " * 4]
    asked += [" ".join(f"word{rng.randint(0, 420)}" for _ in range(12)) + " the and of" for _ in range(12)]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    want = retrieve.bm25_search(docs, queries, 5).collect()
    index = retrieve.keyword_index(docs)
    key = lambda rows: sorted((r.query_id, r["rank"], r.item_id, r.score) for r in rows)
    assert key(keyword.search_blocks(index, queries, 5).collect()) == key(want)
    keyword.write_index(index, str(tmp_path / "index"))
    again = keyword.open_index(spark, str(tmp_path / "index"))
    assert key(keyword.search_blocks(again, queries, 5).collect()) == key(want)
    with_vectors = docs.selectExpr("doc_id", "text", "array(1.0D, doc_id / 1000.0D) AS vector")
    both = queries.selectExpr("query_id", "query", "array(0.6D, 0.8D) AS query_vector")
    plain = retrieve.hybrid_search(with_vectors, both)
    assert key(retrieve.hybrid_search(with_vectors, both, index=index).collect()) == key(plain.collect())


def test_frequent_words_pair_few_documents(spark, docs):
    index = retrieve.keyword_index(docs)
    queries = spark.createDataFrame([(0, "word7 the"), (1, "word8 of and"), (2, "word100 in")], "query_id int, query string")
    cost = keyword.search_cost(index, queries, 5).first()
    assert cost.pairs_scored * 2 < cost.pairs_sharing_a_word


def test_scoring_makes_no_rows_of_pairs(spark, docs, monkeypatch):
    queries = spark.createDataFrame([(i, f"the of and word{i}") for i in range(40)] + [(None, "the")], "query_id int, query string")
    odd = docs.union(spark.createDataFrame([(None, "the word1"), (None, "of of word2 the"), (7, "the and word3"), (7, "the and word3")], docs.schema))
    key = lambda rows: sorted((r.query_id or -1, r["rank"], r.item_id or -1, r.score) for r in rows)
    found = retrieve.bm25_search(odd, queries, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "MapInArrow" in plan
    want = key(found.collect())
    monkeypatch.setattr(keyword, "BLOCK_ROWS", 7)
    monkeypatch.setattr(keyword, "SCORE_BYTES", 8 * 41 * 2)
    monkeypatch.setattr(keyword, "PRODUCTS", 3)
    assert key(retrieve.bm25_search(odd, queries, 5).collect()) == want
    assert key(keyword.search_blocks(retrieve.keyword_index(odd), queries, 5).collect()) == want
    monkeypatch.setattr(keyword, "BROADCAST_TERMS", 0)
    assert key(retrieve.bm25_search(odd, queries, 5).collect()) == want
    assert key(keyword.search_blocks(retrieve.keyword_index(odd), queries, 5).collect()) == want


def test_rare_terms_are_one_block_each(spark, docs):
    index = retrieve.keyword_index(docs)
    assert index.terms.agg({"df": "max"}).first()[0] <= keyword.BLOCK_POSTINGS
    assert index.blocks.count() == index.terms.count()
    assert index.blocks.selectExpr("sum(size(held))").first()[0] == index.postings.count()
