"""The SQL surface: every relational family a user reaches through ``sql_query``.

Both engines get the same text where the dialects agree; where they differ the text is given twice.
"""

import re

from pyspark.sql import functions as F

from tablewise.operators.sql import sql_query
from tablewise.sources import tables as source_tables
from workload.registry import query


def sql_pair(name: str, main: str, spark_sql: str, duck_sql: str | None = None, extra: tuple[str, ...] = ()):
    """``main`` is the active table ``t``; extra tables keep their names."""

    def run(t):
        return sql_query(getattr(t, main), spark_sql, {x: getattr(t, x) for x in extra})

    query(name, duck_sql or re.sub(r"FROM t(?=\s*($|\n|[A-Z)]))", f"FROM {main} t", spark_sql))(run)


sql_pair(
    "sql_project_filter_case",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'big' WHEN l_quantity > 20 THEN 'mid' ELSE 'low' END AS size_class,
       round(l_extendedprice * (1 - l_discount), 6) AS net FROM t WHERE l_returnflag IN ('A', 'R') AND l_shipdate BETWEEN
       TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30' AND l_linestatus LIKE 'F%'""",
)
sql_pair(
    "sql_inner_join_chain",
    "orders",
    """SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM t JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    extra=("customer", "nation"),
)
sql_pair(
    "sql_left_right_full_join",
    "customer",
    """SELECT 'left' AS side, count(*) AS n, count(o_orderkey) AS matched FROM t LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000
       UNION ALL SELECT 'right', count(*), count(c_custkey) FROM t RIGHT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 0
       UNION ALL SELECT 'full', count(*), count(c_custkey) FROM t FULL JOIN orders ON c_custkey = o_custkey AND c_acctbal > 5000""",
    """SELECT 'left' AS side, count(*) AS n, count(o_orderkey) AS matched FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000
       UNION ALL SELECT 'right', count(*), count(c_custkey) FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 0
       UNION ALL SELECT 'full', count(*), count(c_custkey) FROM customer FULL JOIN orders ON c_custkey = o_custkey AND c_acctbal > 5000""",
    extra=("orders",),
)
sql_pair(
    "sql_small_cross_join",
    "region",
    "SELECT r_name, n_name FROM t CROSS JOIN nation WHERE r_regionkey <> n_regionkey",
    extra=("nation",),
)
sql_pair(
    "sql_semi_anti_join",
    "customer",
    """SELECT c_custkey, c_mktsegment FROM t WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
       AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)""",
    extra=("orders",),
)
sql_pair(
    "sql_range_join",
    "part",
    """SELECT b.band, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM t JOIN
       (SELECT 1 AS band, 0 AS lo, 10 AS hi UNION ALL SELECT 2, 11, 30 UNION ALL SELECT 3, 31, 50) b ON p_size >= b.lo AND p_size <= b.hi GROUP BY b.band""",
)
sql_pair(
    "sql_aggregate_distinct_filter_having",
    "lineitem",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(sum(l_quantity), 2) AS qty,
       count(*) FILTER (WHERE l_discount > 0.05) AS discounted, round(avg(l_extendedprice) FILTER (WHERE l_tax > 0.04), 4) AS taxed_price
       FROM t GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""",
)
sql_pair(
    "sql_grouping_sets_cube_rollup",
    "lineitem",
    """SELECT 'sets' AS kind, l_returnflag, l_linestatus, count(*) AS n FROM t GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())
       UNION ALL SELECT 'cube', l_returnflag, l_linestatus, count(*) FROM t GROUP BY CUBE (l_returnflag, l_linestatus)
       UNION ALL SELECT 'rollup', l_returnflag, l_linestatus, count(*) FROM t GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
)
sql_pair(
    "sql_windows",
    "orders",
    """SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rk,
       lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev,
       lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt,
       round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running,
       round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving
       FROM t""",
)
sql_pair(
    "sql_order_limit_offset",
    "orders",
    "SELECT o_orderkey, o_totalprice FROM t ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10",
)
sql_pair(
    "sql_top_k_per_group",
    "orders",
    """SELECT o_orderpriority, o_orderkey, rk FROM (SELECT o_orderpriority, o_orderkey,
       row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM t ) x WHERE rk <= 3""",
)
sql_pair(
    "sql_set_operations",
    "customer",
    """SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey AS k FROM t UNION SELECT s_nationkey FROM supplier) u
       UNION ALL SELECT 'union_all', count(*) FROM (SELECT c_nationkey AS k FROM t UNION ALL SELECT s_nationkey FROM supplier) u
       UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey AS k FROM t INTERSECT SELECT s_nationkey FROM supplier) u
       UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey AS k FROM t EXCEPT SELECT o_custkey FROM orders) u""",
    extra=("supplier", "orders"),
)
sql_pair(
    "sql_subqueries_cte",
    "orders",
    """WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM t GROUP BY o_custkey)
       SELECT o.o_custkey, o.o_orderkey, (SELECT round(avg(o_totalprice), 4) FROM t ) AS overall FROM t o JOIN big b ON o.o_custkey = b.o_custkey
       WHERE o.o_totalprice = b.top AND o.o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM t i WHERE i.o_orderpriority = o.o_orderpriority)""",
    """WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey)
       SELECT o.o_custkey, o.o_orderkey, (SELECT round(avg(o_totalprice), 4) FROM orders) AS overall FROM orders o JOIN big b ON o.o_custkey = b.o_custkey
       WHERE o.o_totalprice = b.top AND o.o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_orderpriority = o.o_orderpriority)""",
)
sql_pair(
    "sql_scalar_functions",
    "events",
    """SELECT event_id, upper(event_type) AS kind, substr(event_type, 1, 3) AS head, length(event_type) AS len, date_format(ts, 'yyyy-MM') AS month,
       hour(ts) AS h, abs(value) AS v, round(sqrt(abs(value)), 4) AS root, floor(value) AS fl, CAST(get_json_object(props, '$.k') AS INT) AS k,
       array_max(array(user_id, event_id)) AS top, concat_ws('-', event_type, CAST(user_id AS STRING)) AS tag FROM t""",
    """SELECT event_id, upper(event_type) AS kind, substr(event_type, 1, 3) AS head, length(event_type) AS len, strftime(ts, '%Y-%m') AS month,
       hour(ts) AS h, abs(value) AS v, round(sqrt(abs(value)), 4) AS root, floor(value)::BIGINT AS fl, CAST(props->>'$.k' AS INT) AS k,
       list_max([user_id, event_id]) AS top, concat_ws('-', event_type, CAST(user_id AS VARCHAR)) AS tag FROM events""",
)
sql_pair(
    "sql_array_map_functions",
    "embeddings",
    """SELECT vec_id, size(embedding) AS dims, round(CAST(element_at(embedding, 1) AS DOUBLE), 5) AS first,
       size(filter(embedding, x -> x > 0)) AS positives, map('label', label)['label'] AS label FROM t""",
    """SELECT vec_id, len(embedding)::INT AS dims, round(embedding[1]::DOUBLE, 5) AS first,
       len(list_filter(embedding, lambda x: x > 0))::INT AS positives, label FROM embeddings""",
)


# ---- sources on the given tables ----


@query(
    "read_parquet_columns",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100",
)
def _(t):
    return source_tables.read_parquet(t.spark, f"{t.folder}/orders.parquet", ["o_orderkey", "o_totalprice"], 100, ["o_orderkey"])


@query("sample_rows_customer", "SELECT * FROM customer ORDER BY c_custkey LIMIT 50")
def _(t):
    return source_tables.sample_rows(t.customer, order_by=["c_custkey"])


@query(
    "normalize_text_numbers",
    """SELECT event_id AS "event id", (value * 2)::DOUBLE AS amount, CASE WHEN user_id % 50 = 0 THEN 'n/a' ELSE user_id::VARCHAR END AS "user",
       CASE WHEN value > 0 THEN value END AS ratio FROM events""",
)
def _(t):
    raw = t.events.select(
        F.col("event_id").alias(" event\tid "),
        (F.col("value") * 2).cast("string").alias("amount "),
        F.when(F.col("user_id") % 50 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("user"),
        F.when(F.col("value") > 0, F.col("value")).otherwise(F.lit(float("inf"))).alias("ratio"),
    )
    return source_tables.normalize(raw)
