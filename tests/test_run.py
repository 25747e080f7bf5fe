from dataclasses import replace
from datetime import date
from pathlib import Path

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from plumbline import (
    Rule,
    RunConfig,
    SqlQuery,
    auto_run,
    read_csv,
    read_result,
    run_checks,
    summarize_verification,
    verify,
    verify_run,
    write_result,
)

DAY = date(2026, 1, 1)

# Devices in a house: four values are missing, nothing else is wrong.
SMALL = """device_id,room,installed_date,price,checks_count
11,attic,2021-06-01,12.5,3
12,cellar,2021-07-09,8.0,
13,attic,,30.25,5
14,garage,2022-02-11,4.75,1
15,,2022-02-12,19.0,0
16,cellar,2023-10-30,7.5,2
17,porch,2023-11-02,,4
18,attic,2024-01-20,15.0,9
"""

# An id that comes three times, five missing values, a word, a large and a negative number as age, text
# as a date, a date to come, a price below zero, and a word that is no boolean.
MESSY = """device_id,room,machine_age,installed_date,price,is_online
21,attic,4,2021-06-01,12.5,yes
22,cellar,7,2021-07-09,8,no
22,cellar,7,2021-07-10,8,no
22,porch,1,2021-08-01,2,yes
23,,old,2022-02-11,30.25,yes
24,garage,150,last spring,19,unsure
25,attic,-2,2031-05-05,-7.5,no
26,cellar,,2023-10-30,,yes
,porch,3,2023-11-02,5,no
27,attic,9,2024-01-20,15,yes
28,garage,12,,6.25,no
29,attic,2,2024-03-03,11,yes
"""


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    file = tmp_path_factory.mktemp("small") / "devices.csv"
    file.write_text(SMALL)
    return read_csv(spark, str(file))


@pytest.fixture(scope="module")
def messy(spark, tmp_path_factory):
    file = tmp_path_factory.mktemp("messy") / "devices.csv"
    file.write_text(MESSY)
    return read_csv(spark, str(file))


@pytest.fixture(scope="module")
def messy_run(messy):
    return auto_run(messy, "messy", reference_date=DAY)


def scores(result):
    return [r.score for r in result.score_components.orderBy("position").collect()]


def test_without_configuration(small):
    result = run_checks(small)
    # 10 % of the cells are missing, the types and rules are not checked.
    assert scores(result) == [10, 25, 10, 10, 5]
    assert rows(result.score, "overall_score", "rating") == [(60, "needs_attention")]
    assert result.types is None and result.rules is None and result.sql_results is None
    assert [r.status for r in result.log.orderBy("position").collect()] == [
        "completed", "completed", "completed", "skipped", "skipped", "skipped", "completed",
    ]
    assert [r.component_name for r in result.score_recommendations.orderBy("position").collect()] == [
        "missing_values", "type_validation", "business_rules",
    ]
    checks = rows(verify(small, result), "check_name", "status")
    assert {status for _, status in checks} == {"passed"} and len(checks) == 7


def test_suggested_run_on_a_clean_table(small):
    run = auto_run(small, "devices", reference_date=DAY)
    assert run.config.duplicate_key_columns == ["device_id"]
    assert run.config.expected_schema == {
        "device_id": "integer", "room": "string", "installed_date": "date", "price": "numeric",
        "checks_count": "integer",
    }
    assert [r.rule_name for r in run.config.business_rules] == [
        "device_id_required", "installed_date_not_future", "price_non_negative",
    ]
    assert [q.query_name for q in run.config.sql_queries] == [
        "total_rows", "room_distribution", "device_id_numeric_summary", "price_numeric_summary",
        "checks_count_numeric_summary", "installed_date_date_range",
    ]
    assert scores(run.result) == [10, 25, 20, 20, 10]
    assert rows(run.result.score, "overall_score", "rating") == [(85, "good")]
    assert run.result.type_examples.count() == run.result.rule_examples.count() == 0
    assert rows(run.result.verification_summary, "status", "checks_run") == [("passed", 7)]


def test_suggested_run_on_a_messy_table(messy_run):
    result = messy_run.result
    assert rows(result.missing_summary, "total_missing_values", "status") == [(5, "warning")]
    assert rows(result.duplicates, "duplicate_row_count", "duplicate_group_count", "duplicate_percentage", "status") == [(3, 1, 25.0, "failed")]
    # 12 rows of 6 columns without the 5 missing values.
    assert rows(result.type_summary, "total_invalid_values", "total_checked_values") == [(3, 67)]
    assert rows(result.rule_summary, "rules_checked", "total_violations") == [(4, 7)]
    assert rows(result.rules, "rule_name", "violation_count") == [
        ("device_id_required", 1), ("installed_date_not_future", 2), ("machine_age_valid_range", 3), ("price_non_negative", 1),
    ]
    assert rows(result.score, "rating") == [("poor",)]
    queries = [r.query_name for r in result.sql_results.orderBy("position").collect()]
    assert queries == [
        "total_rows", "room_distribution", "machine_age_distribution", "is_online_distribution",
        "device_id_numeric_summary", "machine_age_numeric_summary", "price_numeric_summary", "installed_date_date_range",
    ]
    assert rows(result.verification_summary, "status") == [("passed",)]
    assert rows(result.type_examples, "column_name", "row_label", "value") == [
        ("installed_date", "24", "last spring"), ("is_online", "24", "unsure"), ("machine_age", "23", "old"),
    ]
    assert ("device_id_required", "", "<missing>") in rows(result.rule_examples, "rule_name", "row_label", "value")
    assert ("room", 1, "attic") in rows(result.samples, "column_name", "sample_rank", "sample_value")
    severities = dict(rows(result.observations, "source", "severity"))
    assert severities == {
        "missing_values": "warning", "duplicates": "critical", "type_validation": "warning",
        "business_rules": "warning", "bi_readiness_score": "critical", "result_verification": "info",
    }


def test_summaries_from_the_shared_pass_equal_the_queries(messy, messy_run):
    """Suggested ranges are answered without running their SQL; running it gives the same."""
    plain = [replace(q, kind=None, column_name=None) for q in messy_run.config.sql_queries]
    again = run_checks(messy, replace(messy_run.config, sql_queries=plain), reference_date=DAY)
    compared = ("query_name", "row_number", "row")
    assert rows(again.sql_rows, *compared) == rows(messy_run.result.sql_rows, *compared)


def test_report_has_every_section(messy_run):
    report = messy_run.result.report()
    sections = {r.section for r in report.select("section").distinct().collect()}
    assert sections == {
        "overview", "schema", "sample_values", "missing_values", "missing_by_column", "duplicates", "duplicate_examples",
        "type_validation", "type_by_column", "type_examples", "business_rules", "rule_by_rule", "rule_examples",
        "sql_analysis", "sql_queries", "sql_rows", "bi_readiness_score", "score_components", "verification",
        "verification_checks", "run_log", "recommendations",
    }
    found = {(r.section, r.item, r.metric): r.value for r in report.collect()}
    [(overall,)] = rows(messy_run.result.score, "overall_score")
    assert found["bi_readiness_score", "", "overall_score"] == str(overall)
    assert found["duplicate_examples", "1", "duplicate_key"] == '{"device_id":"22"}'
    assert found["missing_by_column", "room", "null_count"] == "1"


def test_advice_of_the_report(small, messy_run):
    assert rows(messy_run.result.report_recommendations, "check_name") == [
        ("business_rules",), ("duplicates",), ("missing_values",), ("type_validation",),
    ]
    clear = run_checks(small.select("device_id"))
    assert rows(clear.report_recommendations, "check_name") == [("all",)]


def test_a_failed_query_is_a_warning(small):
    config = RunConfig(sql_queries=[SqlQuery("bad", "SELECT nope FROM dataset"), SqlQuery("good", "SELECT 1 AS x")])
    result = verify_run(small, run_checks(small, config))
    assert ("sql_execution", "warning") in rows(result.verification, "check_name", "status")
    assert rows(result.verification_summary, "status", "checks_warning") == [("warning", 1)]
    assert dict(rows(result.observations, "source", "severity"))["sql_analysis"] == "warning"


@pytest.mark.parametrize(
    "config",
    [
        RunConfig(duplicate_key_columns=["nope"]),
        RunConfig(expected_schema={"nope": "integer"}),
        RunConfig(business_rules=[Rule("r", "nope", "not_null")]),
    ],
)
def test_a_wrong_configuration_stops_the_run(small, config):
    with pytest.raises(ValueError):
        run_checks(small, config)


@pytest.mark.parametrize(
    ("table", "column", "check_name"),
    [
        ("counts", "row_count", "schema_counts"),
        ("counts", "column_count", "schema_counts"),
        ("missing_summary", "total_missing_values", "missing_values_consistency"),
        ("duplicates", "row_count", "duplicate_row_count"),
        ("duplicates", "duplicate_row_count", "duplicates_recomputation"),
        ("type_summary", "total_invalid_values", "type_validation_total"),
        ("type_summary", "columns_with_invalid_values", "type_validation_affected_columns"),
        ("rule_summary", "total_violations", "business_rules_total"),
        ("rule_summary", "rules_with_violations", "business_rules_affected_rules"),
        ("score", "overall_score", "bi_readiness_score_total"),
    ],
)
def test_changed_results_are_noticed(messy, messy_run, table, column, check_name):
    changed = getattr(messy_run.result, table).withColumn(column, F.col(column) + 1)
    checks = verify(messy, replace(messy_run.result, **{table: changed}))
    assert rows(checks.filter("status = 'failed'"), "check_name") == [(check_name,)]
    assert rows(summarize_verification(checks), "status", "checks_failed") == [("failed", 1)]


def test_further_changes_are_noticed(messy, messy_run):
    result = messy_run.result

    def failed(**changes):
        return rows(verify(messy, replace(result, **changes)).filter("status <> 'passed'"), "check_name", "status")

    more = result.missing.withColumn("null_count", F.col("null_count") + 1)
    total = result.missing_summary.withColumn("total_missing_values", F.lit(5 + 6).cast("long"))
    assert failed(missing=more, missing_summary=total) == [("missing_values_recomputation", "failed")]
    large = result.score_components.withColumn("max_score", F.lit(1))
    assert failed(score_components=large) == [("bi_readiness_score_components", "failed")]
    writing = result.sql_results.withColumn("sql", F.lit("DROP TABLE x"))
    assert failed(sql_results=writing) == [("sql_read_only_validation", "failed")]
    gone = result.duplicates.withColumn("key_columns", F.array(F.lit("gone")))
    assert failed(duplicates=gone) == [("duplicate_key_columns", "failed")]
    assert failed(score=None) == [("bi_readiness_score", "warning")]
    assert failed(types=None, rules=None, sql_results=None) == []


def test_stored_results(spark, messy, messy_run, tmp_path):
    path = str(tmp_path / "results")
    write_result(messy_run.result, path, "a", DAY)
    write_result(messy_run.result, path, "a", date(2026, 1, 2))  # the same run, finished a day later
    write_result(messy_run.result, path, "b", DAY)
    [(overall,)] = rows(messy_run.result.score, "overall_score")
    assert rows(read_result(spark, path, "score", "a"), "overall_score", "run_id", "run_date") == [
        (overall, "a", date(2026, 1, 2))
    ]
    assert read_result(spark, path, "score").count() == 2
    assert read_result(spark, path, "report", "a").count() == messy_run.result.report().count()
    stored = {
        name: read_result(spark, path, name, "a")
        for name in messy_run.result.tables()
        if not name.startswith("verification")
    }
    checks = verify(messy, replace(messy_run.result, **stored))
    assert {s for (s,) in rows(checks, "status")} == {"passed"}


def test_stored_results_of_two_datasets(spark, small, tmp_path):
    path = str(tmp_path / "results")
    first = run_checks(small, RunConfig("first", expected_schema={"price": "numeric"}))
    second = run_checks(small.limit(3), RunConfig("sec ond/2"))
    write_result(first, path, "07", DAY)
    write_result(second, path, "07", DAY)
    assert rows(read_result(spark, path, "counts", "07"), "dataset", "row_count") == [("first", 8), ("sec ond/2", 3)]
    assert read_result(spark, path, "types", "07", "first").count() == 1
    # A repeat that checks no types any more leaves none behind.
    write_result(run_checks(small, RunConfig("first")), path, "07", DAY)
    assert read_result(spark, path, "type_summary", "07").count() == 0 if _has(path, "type_summary") else True
    assert rows(read_result(spark, path, "counts", "07"), "dataset") == [("first",), ("sec ond/2",)]


def _has(path, name):
    return any(Path(path, name).rglob("*.parquet"))


def test_dates_in_other_formats(spark):
    df = spark.createDataFrame([(1, "03/15/2024"), (2, "2024-01-02"), (3, "15.03.2024")], "id int, due_date string")
    plain = auto_run(df, reference_date=DAY, row_id=["id"]).result
    assert rows(plain.type_summary, "total_invalid_values") == [(2,)]
    read = auto_run(df, reference_date=DAY, row_id=["id"], date_formats=("MM/dd/yyyy",)).result
    assert rows(read.type_summary, "total_invalid_values") == [(1,)]
    assert rows(read.rules, "rule_name", "violation_count") == [("due_date_not_future", 1), ("id_required", 0)]
    assert rows(read.type_examples, "row_label", "value") == [("3", "15.03.2024")]
    assert rows(read.verification_summary, "status") == [("passed",)]


def test_shared_answers_are_what_the_sql_returns(spark):
    df = spark.createDataFrame(
        [(1, " 31", "\t2018-04-05"), (2, "\t77\u00a0", "2020-09-09"), (3, "98765432.5", None), (4, "x", "y")],
        "id int, toner_amount string, seen_date string",
    )
    config = auto_run(df, reference_date=DAY).config
    shared = run_checks(df, config, reference_date=DAY)
    alone = run_checks(
        df, replace(config, sql_queries=[replace(q, kind=None) for q in config.sql_queries]), reference_date=DAY
    )
    assert rows(shared.sql_rows, "query_name", "row") == rows(alone.sql_rows, "query_name", "row")
    found = dict(rows(shared.sql_rows, "query_name", "row"))
    assert found["toner_amount_numeric_summary"]["max_value"] == "9.87654325E7"
    assert found["seen_date_date_range"] == {"min_date": "2018-04-05", "max_date": "2020-09-09"}


def test_only_generated_text_is_answered_from_the_pass(small):
    mine = SqlQuery("mine", "SELECT COUNT(*) AS row_count FROM dataset WHERE room = 'attic'", kind="total_rows")
    result = run_checks(small, RunConfig(sql_queries=[mine]))
    assert rows(result.sql_rows, "row") == [({"row_count": "3"},)]


def test_distributions_are_what_the_sql_returns(spark):
    words = [f"w{i % 90}" if i % 7 else None for i in range(900)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, category string")
    config = auto_run(df, reference_date=DAY).config
    generated = [q for q in config.sql_queries if q.kind == "distribution"]
    shared, alone = (
        run_checks(df, RunConfig(sql_queries=queries))
        for queries in (generated, [replace(q, kind=None) for q in generated])
    )
    compared = ("query_name", "row_number", "row")
    assert rows(shared.sql_rows, *compared) == rows(alone.sql_rows, *compared)
    assert rows(shared.sql_results, "row_count", "columns", "status") == rows(alone.sql_results, "row_count", "columns", "status")
    assert shared.sql_rows.count() == 50


def test_options_reach_the_run(small):
    run = auto_run(small, max_numeric_queries=None, max_rows=2, max_categorical_queries=0)
    names = [q.query_name for q in run.config.sql_queries]
    assert len([n for n in names if n.endswith("numeric_summary")]) == 3 and "room_distribution" not in names
    all_rows = run_checks(small, RunConfig(sql_queries=[SqlQuery("q", "SELECT * FROM dataset")]), max_rows=2)
    assert all_rows.sql_rows.count() == 2
    assert rows(all_rows.sql_results, "row_count") == [(8,)]


def test_a_query_over_several_lines_is_verified(small):
    query = SqlQuery("lines", "\n\tSELECT room, COUNT(*) AS n\n\tFROM dataset\n\tGROUP BY room\n")
    result = verify_run(small, run_checks(small, RunConfig(sql_queries=[query])))
    assert rows(result.verification_summary, "status") == [("passed",)]


@pytest.mark.parametrize("schema", ["device_id int, machine_age string", "a array<int>, m map<string,int>"])
def test_empty_tables(spark, schema):
    empty = spark.createDataFrame([], schema)
    run = auto_run(empty, "empty", reference_date=DAY)
    assert one(run.result.counts).row_count == 0
    assert one(run.result.duplicates).status == "passed"
    assert rows(run.result.verification_summary, "status") == [("passed",)]


def test_table_without_columns(spark):
    bare = spark.createDataFrame([(1,), (2,)], "a int").select()
    result = run_checks(bare)
    assert rows(result.facts, "row_count", "column_count", "total_missing_values") == [(2, 0, 0)]
    assert rows(summarize_verification(verify(bare, result)), "status") == [("passed",)]
