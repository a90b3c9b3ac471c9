import pytest

from tablewise.operators.sql import sql_query


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(1, "reflect"), (2, "other")], "a long, note string")


def test_literals_and_expressions_are_allowed(table):
    assert sql_query(table, "SELECT a FROM t WHERE note = 'reflect'").first()["a"] == 1
    query = "WITH c AS (SELECT a FROM t) SELECT max(a) AS m FROM c WHERE a IN (SELECT a FROM T)"
    assert sql_query(table, query).first()["m"] == 2


def test_other_tables_are_unknown(spark, table):
    table.createOrReplaceGlobalTempView("secret")
    for query in (
        "SELECT * FROM global_temp.secret",
        "SELECT a FROM t WHERE a IN (SELECT a FROM global_temp.secret)",
        "SELECT (SELECT max(a) FROM default.saved) AS m FROM t",
        "WITH c AS (SELECT * FROM saved) SELECT * FROM c",
    ):
        with pytest.raises(ValueError):
            sql_query(table, query)
    spark.catalog.dropGlobalTempView("secret")


def test_names_are_known_by_scope_and_not_by_text(spark, table):
    spark.sql("CREATE DATABASE IF NOT EXISTS kept")
    table.write.mode("overwrite").saveAsTable("saved")
    try:
        for query in (
            "WITH saved AS (SELECT * FROM saved) SELECT * FROM saved",
            "SELECT a, 'CTE [saved]' AS x FROM saved",
            "WITH c AS (SELECT a FROM t), d AS (SELECT * FROM e), e AS (SELECT 1 AS a) SELECT * FROM d",
            "SELECT * FROM (WITH inner_name AS (SELECT 1 AS a) SELECT * FROM inner_name) JOIN inner_name USING (a)",
            "SELECT * FROM IDENTIFIER('sav' || 'ed')",
            "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM saved)",
            "SELECT a FROM t, LATERAL (SELECT max(a) AS m FROM saved)",
            "TABLE saved",
            "SELECT * FROM t UNION ALL SELECT * FROM saved",
            "SELECT TRANSFORM(a) USING 'cat' AS (b) FROM t",
        ):
            with pytest.raises(ValueError):
                sql_query(table, query)
    finally:
        spark.sql("DROP TABLE saved")
        spark.sql("DROP DATABASE kept")
    assert sql_query(table, "SELECT a FROM t WHERE note <> 'UnresolvedRelation [zz]' AND note <> 'CTE [q]'").count() == 2
    assert sql_query(table, "WITH t AS (SELECT a + 1 AS a FROM t) SELECT max(a) AS m FROM t").first()["m"] == 3
    recursive = "WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 4) SELECT sum(i) AS s FROM n"
    assert sql_query(table, recursive).first()["s"] == 10
    assert sql_query(table, "SELECT e FROM t LATERAL VIEW explode(array(a, a)) x AS e").count() == 4
    assert sql_query(table, "SELECT * FROM range(3)").count() == 3
    nested = "WITH c AS (SELECT a FROM t) SELECT a, (SELECT max(a) FROM c WHERE c.a <= t.a) AS m FROM t WHERE a IN (SELECT a FROM c)"
    assert sql_query(table, nested).count() == 2


def test_method_calls_are_refused_anywhere(table):
    for query in (
        "SELECT reflect('java.lang.System', 'exit', 0) FROM t",
        "SELECT a FROM t WHERE a = (SELECT max(length(java_method('java.util.UUID', 'randomUUID'))) FROM t)",
    ):
        with pytest.raises(ValueError):
            sql_query(table, query)


def test_one_csv_file_is_read_in_several_tasks(spark, tmp_path):
    from tablewise.sources.tables import read_csv

    path = tmp_path / "rows.csv"
    path.write_text("a,b\n" + "".join(f"{i},text of row {i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = read_csv(spark, str(path), "a int, b string")
        assert df.rdd.getNumPartitions() > 2 and df.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
