import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from plumbline import (
    RunConfig,
    describe_table,
    describe_tables,
    preview,
    run_queries,
    sample_values,
    suggest_config,
    suggest_configs,
    suggest_keys,
    suggest_queries,
    suggest_rules,
    suggest_types,
)
from plumbline.operators.suggest import described_samples, suggestion_notes


def described(spark, *columns):
    """Columns given as (name, type, samples)."""
    return spark.createDataFrame(
        [("t", i, name, kind, list(samples)) for i, (name, kind, samples) in enumerate(columns)],
        "dataset string, position int, column_name string, data_type string, sample_values array<string>",
    )


@pytest.mark.parametrize(
    ("name", "kind", "samples", "expected"),
    [
        ("Signup Date", "string", ["x"], "date"),
        ("created_at", "bigint", ["1"], "date"),
        ("event-time", "string", [], "date"),
        ("dated", "string", ["x"], "string"),
        ("age", "string", ["1"], "integer"),
        ("page", "string", ["x"], "string"),
        ("is_open", "string", ["x"], "boolean"),
        ("island", "string", ["x"], "string"),
        ("has-stock", "int", ["3"], "boolean"),
        ("user flag", "string", ["x"], "boolean"),
        ("answer", "string", [" Yes", "no"], "boolean"),
        ("answer", "string", ["yes", "perhaps"], "string"),
        ("answer", "string", [], "string"),
        ("ok", "boolean", ["true"], "boolean"),
        ("Total Price", "string", ["5"], "numeric"),
        ("amount", "bigint", ["5"], "numeric"),
        ("order_qty", "double", ["5.0"], "integer"),
        ("x", "smallint", ["5"], "integer"),
        ("x", "decimal(10,2)", ["5.00"], "numeric"),
        ("x", "float", ["5.0"], "numeric"),
        ("x", "timestamp_ntz", ["2024-01-01 00:00:00"], "date"),
        ("x", "string", ["z"], "string"),
        ("Âge", "string", ["z"], "string"),
    ],
)
def test_expected_types(spark, name, kind, samples, expected):
    df = described(spark, (name, kind, samples))
    assert rows(suggest_types(df), "expected_type") == [(expected,)]


def test_nested_columns_are_left_out(spark):
    df = described(spark, ("price", "array<float>", ["[1.0]"]), ("m", "map<string,int>", []), ("id", "struct<a:int>", []))
    assert rows(suggest_types(df)) == []
    assert rows(suggest_rules(df), "rule_name") == [("id_required",)]
    assert rows(suggest_queries(df), "query_name") == [("total_rows",)]


def test_keys(spark):
    df = described(spark, ("name", "string", []), ("Order ID", "int", []), ("user_id", "int", []))
    assert rows(suggest_keys(df)) == [("t", "Order ID")]
    assert rows(suggest_keys(described(spark, ("idea", "int", []), ("paid", "int", [])))) == [("t", None)]
    assert rows(suggest_keys(described(spark, ("tax_identifier", "int", [])))) == [("t", "tax_identifier")]


def test_rules_and_their_order(spark):
    df = described(
        spark, ("id", "int", []), ("age", "int", []), ("total cost", "double", []), ("paid_at", "string", []),
        ("ID", "int", []), ("date_of_age_id_value", "string", []),
    )
    found = suggest_rules(df).orderBy("position", "rule_order")
    assert [(r.rule_name, r.column_name, r.rule_type, r.min_value, r.max_value, r.allow_null) for r in found.collect()] == [
        ("id_required", "id", "not_null", None, None, False),
        ("age_valid_range", "age", "range", 0.0, 120.0, True),
        ("total_cost_non_negative", "total cost", "non_negative", None, None, True),
        ("paid_at_not_future", "paid_at", "not_future_date", None, None, True),
        ("date_of_age_id_value_required", "date_of_age_id_value", "not_null", None, None, False),
        ("date_of_age_id_value_valid_range", "date_of_age_id_value", "range", 0.0, 120.0, True),
        ("date_of_age_id_value_non_negative", "date_of_age_id_value", "non_negative", None, None, True),
        ("date_of_age_id_value_not_future", "date_of_age_id_value", "not_future_date", None, None, True),
    ]


def test_query_limits(spark):
    df = described(
        spark, *[(f"c{i}", "string", ["x"]) for i in range(5)], *[(f"n{i}", "int", ["7"]) for i in range(5)],
        *[(f"d{i}_at", "string", ["x"]) for i in range(4)], ("region", "int", ["9"]),
    )
    names = [r.query_name for r in suggest_queries(df).orderBy("kind_order", "position").collect()]
    assert names == [
        "total_rows", "c0_distribution", "c1_distribution", "c2_distribution", "n0_numeric_summary",
        "n1_numeric_summary", "n2_numeric_summary", "d0_at_date_range", "d1_at_date_range",
    ]
    assert suggest_queries(df, 0, 0, 0).count() == 1
    assert suggest_queries(df, 10, 10, 10).count() == 1 + 6 + 6 + 4


def test_suggested_queries_run_on_awkward_names(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-01", "a", 5), ("1d", "2024", None, None)],
        "`a``ge` string, `signup date` string, `x.y` string, `total value` int",
    )
    config = suggest_config(describe_table(df))
    results = {r.query_name: r for r in run_queries(df, config.sql_queries)}
    assert {r.status for r in results.values()} == {"passed"}
    assert results["signup_date_date_range"].rows == [{"min_date": "2024-01-01", "max_date": "2024-01-01"}]
    assert results["total_value_numeric_summary"].rows == [{"min_value": "5.0", "max_value": "5.0", "avg_value": "5.0"}]


def test_description_covers_every_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    found = {r.column_name: (r.data_type, r.sample_values) for r in describe_table(df, "x").collect()}
    assert found == {"a": ("int", ["1", "2"]), "b": ("string", [])}


def test_many_tables_at_once(spark):
    tables = {"one": spark.range(3).withColumnRenamed("id", "user_id"), "two": spark.sql("SELECT 'x' AS city")}
    columns = describe_tables(tables)
    configs = suggest_configs(columns)
    assert configs["one"].duplicate_key_columns == ["user_id"]
    assert configs["two"].duplicate_key_columns is None
    assert [q.query_name for q in configs["two"].sql_queries] == ["total_rows", "city_distribution"]
    assert suggest_config(columns, "three") == RunConfig("three")
    assert suggestion_notes(configs["two"])[0] == "no key found, whole rows are compared"
    assert suggestion_notes(configs["one"])[0] == "key: user_id"


def test_boolean_words_are_looked_for_in_all_values(spark):
    """The five smallest are all words for a boolean, one further value is none."""
    words = ["0", "1", "N", "NO", "Y", "yes", "zebra"]
    df = spark.createDataFrame([(w, w if w != "zebra" else None) for w in words], "mark string, vote string")
    found = {r.column_name: r.expected_type for r in suggest_types(describe_table(df)).collect()}
    assert found == {"mark": "string", "vote": "boolean"}


def test_a_description_is_one_pass_and_has_the_samples(spark, tmp_path):
    data = [(i, ["yes", " No", None][i % 3], None, float("nan"), [i]) for i in range(50)]
    df = spark.createDataFrame(data, "`a.b` int, flag string, none string, d double, l array<int>")
    df.write.parquet(str(tmp_path / "t"))
    for table in (spark.read.parquet(str(tmp_path / "t")), df.limit(0)):
        described = describe_table(table)
        assert rows(described_samples(described)) == rows(sample_values(table))
        given = {r.position: r.boolean_words for r in described.collect()}
        empty = table.count() == 0
        assert given == {0: empty, 1: True, 2: True, 3: True, 4: empty}
    assert plan_of(describe_table(spark.read.parquet(str(tmp_path / "t")))).count("FileScan") == 1


def test_preview_tells_names_apart_by_case(spark):
    df = spark.createDataFrame([(1, 9), (2, 8)], "b int, B int")
    assert [tuple(r) for r in preview(df, 1, ["B"]).collect()] == [(2, 8)]


def test_only_texts_are_compared_with_words_for_a_boolean(spark):
    """Numbers, days and booleans are told by their values, which costs a fraction of that."""
    kinds = "i int, l bigint, d double, t timestamp, day date, b boolean"
    df = spark.createDataFrame([(0, 1, 1.0, None, None, True), (1, 2, None, None, None, False)], kinds)
    df = df.withColumns({"t": F.lit("2024-01-01").cast("timestamp"), "day": F.lit("2024-01-01").cast("date")})
    plan = plan_of(describe_table(df))
    assert "trim(" not in plan and "lower(" not in plan
    found = {r.column_name: r.boolean_words for r in describe_table(df).collect()}
    assert found == {"i": True, "l": False, "d": False, "t": False, "day": False, "b": True}
    decimals = spark.sql("SELECT CAST(1 AS DECIMAL(3,0)) AS whole, CAST(1 AS DECIMAL(3,1)) AS tenths")
    assert [r.boolean_words for r in describe_table(decimals).orderBy("position").collect()] == [True, False]
