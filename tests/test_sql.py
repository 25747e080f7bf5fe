import pytest
from conftest import rows
from pyspark.sql import functions as F

from plumbline import RunConfig, SqlQuery, check_read_only, run_checks, run_queries, sql_session
from plumbline.operators.sqlcheck import (
    batch_status,
    date_range,
    is_read_only,
    numeric_summary,
    query_dataset,
    sql_result_rows,
    sql_results,
    summarize_sql,
    value_distribution,
)

ALLOWED = [
    "\n\tSELECT 1\n", "\u00a0with a as (select 1 as x) select x from a", "SELECT 1", "  select * from dataset ;", "WITH a AS (SELECT 1 AS x) SELECT x FROM a", "select(1)",
]
REFUSED = [
    "", " ; ", "DELETE FROM dataset", "selectx FROM dataset", "/* hi */ SELECT 1", "SELECT 1; DROP TABLE dataset",
    "SELECT 'drop'", "SELECT `set` FROM dataset", "SELECT reflect('java.lang.Runtime', 'getRuntime')",
    "SELECT java_method('x', 'y')", "SELECT TRANSFORM (x) USING 'cat' FROM dataset", "INSERT INTO dataset VALUES (1)",
]


@pytest.fixture(scope="module")
def sales(spark):
    """Bottles filled by a mill."""
    return spark.createDataFrame(
        [("rye", 7, 0.25), ("oat", 40, None), ("rye", 8, float("nan")), ("oat", 2, float("nan"))],
        "grain string, bottles int, x double",
    )


@pytest.mark.parametrize("sql", ALLOWED)
def test_read_only_queries_pass(spark, sql):
    check_read_only(sql)
    assert spark.createDataFrame([(sql,)], "q string").select(is_read_only(F.col("q"))).first()[0]


@pytest.mark.parametrize("sql", REFUSED)
def test_other_queries_are_refused(spark, sql):
    with pytest.raises(ValueError):
        check_read_only(sql)
    df = spark.createDataFrame([(sql,)], "q string")
    assert not df.select(is_read_only(F.col("q"))).first()[0]


def test_grouped_sum(sales):
    query = "SELECT grain, SUM(bottles) AS filled, COUNT(*) AS fills FROM dataset GROUP BY grain ORDER BY filled"
    [found] = run_queries(sales, [SqlQuery("q", query)])
    assert (found.status, found.row_count, found.columns) == ("passed", 2, ["grain", "filled", "fills"])
    assert found.rows == [{"grain": "rye", "filled": "15", "fills": "2"}, {"grain": "oat", "filled": "42", "fills": "2"}]


def test_missing_values_become_empty_text(sales):
    [found] = run_queries(sales, [SqlQuery("q", "SELECT x, array(bottles) AS a FROM dataset ORDER BY bottles")])
    assert found.rows == [{"x": "", "a": "[2]"}, {"x": "0.25", "a": "[7]"}, {"x": "", "a": "[8]"}, {"x": "", "a": "[40]"}]


def test_preview_is_limited_and_all_rows_are_counted(spark):
    df = spark.range(120)
    [found] = run_queries(df, [SqlQuery("q", "SELECT id FROM dataset ORDER BY id DESC")])
    assert (found.row_count, len(found.rows), found.rows[0]) == (120, 50, {"id": "119"})
    [found] = run_queries(df, [SqlQuery("q", "SELECT id FROM dataset")], max_rows=0)
    assert (found.row_count, found.rows) == (120, [])
    [found] = run_queries(df, [SqlQuery("q", "SELECT id FROM t WHERE id < 0")], table_name="t")
    assert (found.row_count, found.rows) == (0, [])
    with pytest.raises(ValueError):
        run_queries(df, [], max_rows=-1)


def test_batch(spark, sales):
    good = SqlQuery("good", "SELECT COUNT(DISTINCT grain) AS n FROM dataset")
    failing = [
        SqlQuery("column", "SELECT nope FROM dataset"),
        SqlQuery("runtime", "SELECT CAST(grain AS int) AS x FROM dataset"),
        SqlQuery("write", "DROP TABLE dataset"),
        SqlQuery("two", "SELECT 1; SELECT 2"),
    ]
    assert batch_status(run_queries(sales, [])) == "passed"
    assert batch_status(run_queries(sales, [good])) == "passed"
    assert batch_status(run_queries(sales, failing)) == "failed"
    results = run_queries(sales, [good, *failing])
    assert batch_status(results) == "warning"
    assert [r.status for r in results] == ["passed"] + ["failed"] * 4
    assert all(r.error_message for r in results[1:])
    assert rows(summarize_sql(sql_results(spark, results))) == [("dataset", "warning", 5, 4)]
    assert rows(sql_result_rows(spark, results), "query_name", "row_number", "row") == [("good", 1, {"n": "2"})]


def test_nothing_else_can_be_read(spark, sales, tmp_path):
    path = str(tmp_path / "other")
    spark.range(3).write.parquet(path)
    spark.range(3).createOrReplaceTempView("hidden")
    spark.sql(f"CREATE TABLE secret USING parquet LOCATION '{path}'")
    try:
        foreign = [
            f"SELECT * FROM parquet.`{path}`",
            "SELECT * FROM hidden",
            "SELECT * FROM secret",
            "SELECT * FROM default.secret",
            "SELECT 1 WHERE EXISTS (SELECT 1 FROM secret)",
            "WITH a AS (SELECT * FROM secret) SELECT 1 AS one FROM dataset",
            "SELECT (SELECT max(id) FROM secret) AS m FROM dataset",
            "SELECT * FROM (WITH secret AS (SELECT 1 AS a) SELECT a FROM secret) AS t, secret",
        ]
        results = run_queries(sales, [SqlQuery(f"q{i}", sql) for i, sql in enumerate(foreign)])
        assert [r.status for r in results] == ["failed"] * len(foreign)
        # A table under check that comes from the catalog may be read, others still not.
        table = spark.table("secret")
        own = run_queries(table, [SqlQuery("q", "SELECT id FROM dataset")])
        assert own[0].row_count == 3
    finally:
        spark.sql("DROP TABLE secret")


def test_lazy_result_outlives_its_session(sales):
    with sql_session(sales) as session:
        found = query_dataset(session, "SELECT grain FROM dataset")
    assert found.count() == 4


def test_generated_summaries(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-02"), (" 3 ", "2023-01-01"), ("1d", "2025"), (None, None)], "n string, `d.y` string"
    )
    assert rows(numeric_summary(df, ["n"])) == [("n", 1.0, 3.0, 2.0)]
    assert [tuple(map(str, r)) for r in rows(date_range(df, ["d.y"]))] == [("d.y", "2023-01-01", "2024-01-02")]
    assert [tuple(r) for r in value_distribution(df, "n").collect()][0] == (None, 1)
    with pytest.raises(ValueError):
        value_distribution(df, "nope")


def test_settings_of_the_caller_hold_inside(spark, sales):
    spark.conf.set("spark.sql.caseSensitive", "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with sql_session(sales) as session:
            assert session.conf.get("spark.sql.caseSensitive") == "true"
            assert session.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
            assert session.conf.get("spark.sql.runSQLOnFiles") == "false"
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_large_result_is_computed_once(spark, sales):
    """Count and rows shown are of one execution."""
    runs = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda n: runs.add(1) or n, "bigint")
    df = spark.range(200).repartition(2).select(seen("id").alias("n"))
    [found] = run_queries(df, [SqlQuery("q", "SELECT n FROM dataset")], max_rows=3)
    assert (found.row_count, len(found.rows)) == (200, 3)
    assert runs.value == 200


# As many tasks as there are cores, so that the others of a batch wait for its end.
ENDLESS = "SELECT count_if(xxhash64(id) = 3) AS n FROM range(0, 4000000000000000, 1, 8)"


def test_a_query_without_end_is_cancelled_alone(spark):
    df = spark.range(1000).selectExpr("id", "pmod(id, 3) AS k")
    queries = [
        SqlQuery("endless", ENDLESS),
        SqlQuery("counted", "SELECT count(*) AS n FROM dataset"),
        SqlQuery("grouped", "SELECT k, count(*) AS n FROM dataset GROUP BY k ORDER BY k"),
    ]
    cancelled, *others = run_queries(df, queries, max_seconds=6)
    assert (cancelled.status, cancelled.row_count) == ("failed", 0)
    assert cancelled.error_message == "cancelled after 6 seconds"
    alone = run_queries(df, queries[1:])
    assert others == alone and {r.status for r in others} == {"passed"}
    assert batch_status([cancelled, *others]) == "warning"
    assert len(spark.sparkContext.getJobTags()) == 0
    assert spark.range(5).count() == 5


def test_time_limits_of_runs(spark):
    df = spark.range(20).selectExpr("id", "pmod(id, 3) AS k")
    queries = [SqlQuery("endless", ENDLESS), SqlQuery("counted", "SELECT count(*) AS n FROM dataset")]
    result = run_checks(df, RunConfig(sql_queries=queries), max_query_seconds=4)
    found = {r.query_name: r.status for r in result.sql_results.collect()}
    assert found == {"endless": "failed", "counted": "passed"}
    assert result.sql_summary.first().status == "warning"
    refused = run_queries(df, queries[1:], max_seconds=0)
    assert refused[0].status == "failed"
