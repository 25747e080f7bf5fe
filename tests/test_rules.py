from datetime import date

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from plumbline import (
    Rule,
    RunConfig,
    check_allowed_table,
    check_rules,
    rule_examples,
    rule_summary,
    rules_by_slice,
    run_checks,
    verify_run,
)

DAY = date(2026, 1, 1)


def count(df, rule, **options):
    return one(check_rules(df, [rule], reference_date=DAY, **options)).violation_count


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row int, x string")


def test_clean_table(spark):
    df = spark.createDataFrame(
        [("p-7", 6.5, "oak", 220, "2019-11-30"), ("p-8", 7.0, "elm", 3, "2025-12-31")],
        "plank string, width double, wood string, length int, cut_on string",
    )
    rules = [
        Rule("plank", "plank", "not_null"), Rule("width", "width", "range", 6, 7), Rule("wood", "wood", "allowed_values", allowed_values=["elm", "oak"]),
        Rule("length", "length", "positive"), Rule("cut", "cut_on", "not_future_date"),
    ]
    found = one(rule_summary(df, rules, reference_date=DAY))
    assert (found.status, found.rules_checked, found.rules_with_violations, found.total_violations) == ("passed", 5, 0, 0)
    assert rule_examples(df, rules, reference_date=DAY).count() == 0


def test_not_null(spark):
    df = texts(spark, "a", None, "b", None)
    found = one(check_rules(df, [Rule("r", "x", "not_null")]))
    assert (found.violation_count, found.violation_percentage, found.status, found.severity) == (2, 50.0, "failed", "high")


def test_range(spark):
    # Below, at both ends, above, no number at all, and missing.
    df = texts(spark, "3.99", "4", "\t8.25 ", "8.26", "1e3", "wide", None, None)
    assert count(df, Rule("r", "x", "range", 4, 8.25)) == 4
    assert count(df, Rule("r", "x", "range", min_value=4)) == 2
    assert count(df, Rule("r", "x", "range", max_value=8.25)) == 3
    assert count(df, Rule("r", "x", "range", 4, 8.25, allow_null=False)) == 6


def test_messages_show_the_bounds_exactly(spark):
    df = texts(spark, "-1")
    for low, high, text in ((1234567.5, 99999999, "from 1234567.5 to 99999999"), (0.1, 1e16, "from 0.1 to 10000000000000000")):
        found = one(rule_examples(df, [Rule("r", "x", "range", low, high)], ["row"], reference_date=DAY))
        assert text in found.message


def test_signs(spark):
    df = texts(spark, "0.5", "-0.0", "0", "-7", "-1e-9", "much", None)
    assert count(df, Rule("r", "x", "positive")) == 5
    assert count(df, Rule("r", "x", "non_negative")) == 3


def test_allowed_values_are_trimmed_and_case_sensitive(spark):
    df = texts(spark, "a", " a\t", "A", "b", None)
    assert count(df, Rule("r", "x", "allowed_values", allowed_values=["a ", "c"])) == 2
    many = [str(i) for i in range(500)]
    numbers = spark.range(1000).selectExpr("id AS x")
    assert count(numbers, Rule("r", "x", "allowed_values", allowed_values=many)) == 500


def test_future_dates(spark):
    df = texts(spark, "2024-01-15", "2026-01-01 23:59:59", "2026-01-02", "bad", None)
    assert count(df, Rule("r", "x", "not_future_date")) == 2
    assert one(check_rules(texts(spark, "2024-01-15", "2999-01-01"), [Rule("r", "x", "not_future_date")])).violation_count == 1


def test_nulls_disallowed(spark):
    df = spark.createDataFrame([(None,), (7,), (None,), (90,), (8,)], "floor int")
    assert count(df, Rule("r", "floor", "range", -2, 60, allow_null=False)) == 3


def test_all_missing_column(spark):
    df = texts(spark, None, None)
    for kind in ("range", "positive", "not_future_date"):
        assert count(df, Rule("r", "x", kind, min_value=0)) == 0
        assert count(df, Rule("r", "x", kind, min_value=0, allow_null=False)) == 2


def test_other_types(spark):
    df = spark.sql("SELECT true AS b, date'2030-01-01' AS d, timestamp'2020-01-01 00:00:00' AS t, 5 AS i")
    assert count(df, Rule("r", "b", "positive")) == 0
    assert count(df, Rule("r", "d", "not_future_date")) == 1
    assert count(df, Rule("r", "t", "not_future_date")) == 0
    assert count(df, Rule("r", "i", "not_future_date")) == 0
    assert count(df, Rule("r", "b", "not_future_date")) == 1


def test_examples(spark):
    df = texts(spark, "5", None, "-3", "x", "-9")
    rules = [Rule("no_gap", "x", "not_null"), Rule("from_zero", "x", "range", min_value=0)]
    assert rows(
        rule_examples(df, rules, ["row"]), "rule_name", "example_rank", "row_label", "value", "message"
    ) == [
        ("from_zero", 1, "2", "-3", "expected at least 0"),
        ("from_zero", 2, "3", "x", "expected at least 0"),
        ("from_zero", 3, "4", "-9", "expected at least 0"),
        ("no_gap", 1, "1", "<missing>", "expected a value"),
    ]
    assert rule_examples(df, rules, ["row"], max_examples=1).count() == 2


@pytest.mark.parametrize(
    "rule",
    [
        Rule("r", "nope", "not_null"),
        Rule("r", "X", "not_null"),
        Rule("r", "x", "range"),
        Rule("r", "x", "allowed_values"),
        Rule("r", "x", "allowed_values", allowed_values=[]),
        Rule("r", "x", "unique"),
        Rule("r", "a", "positive"),
    ],
)
def test_rules_are_checked_before_any_job(spark, rule):
    df = spark.sql("SELECT 'v' AS x, array(1) AS a")
    with pytest.raises(ValueError):
        check_rules(df, [rule])
    with pytest.raises(ValueError):
        rule_examples(df, [rule])


def test_summary_status(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id = 0 THEN null ELSE id END AS x")
    found = one(rule_summary(df, [Rule("r", "x", "not_null")]))
    assert (found.status, found.total_violations) == ("warning", 1)
    assert one(rule_summary(df.limit(0), [Rule("r", "x", "not_null")])).status == "passed"
    assert one(rule_summary(df, [])).status == "passed"


def test_allowed_values_of_a_table(spark):
    df = texts(spark, "oak", " elm\t", "fir", None, "fir", "Oak")
    allowed = spark.createDataFrame([("elm ", 1), ("oak", 2), ("oak", 3), (None, 4)], "wood string, n int")
    found = one(check_allowed_table(df, "x", allowed))
    same = one(check_rules(df, [Rule("x_allowed", "x", "allowed_values", allowed_values=["oak", "elm"])]))
    assert found == same and found.violation_count == 3
    assert one(check_allowed_table(df, "x", allowed, allow_null=False)).violation_count == 4
    assert one(check_allowed_table(df.limit(0), "x", allowed)).row_count == 0
    with pytest.raises(ValueError):
        check_allowed_table(df, "nope", allowed)


def test_tables_of_values_within_runs(spark):
    """A table and a list of the same values give the same run, examples, score and verification."""
    df = texts(spark, "oak", " elm\t", "fir", None, "fir", "Oak").withColumn("n", F.col("row") - 2)
    allowed = spark.createDataFrame([("elm ", 1), ("oak", 2), ("oak", 3), (None, 4)], "`wo.od` string, n int")

    def run(**values):
        rules = [
            Rule("positive", "n", "positive"),
            Rule("known", "x", "allowed_values", **values),
            Rule("given", "x", "allowed_values", allow_null=False, **values),
        ]
        result = run_checks(df, RunConfig(business_rules=rules), row_id=["row"], max_rows=5)
        return verify_run(df, result).tables()

    listed, looked_up = run(allowed_values=["oak", "elm"]), run(allowed_table=allowed)
    assert set(listed) == set(looked_up)
    for name, table in listed.items():
        assert rows(looked_up[name]) == rows(table), name
    assert [r.violation_count for r in looked_up["rules"].orderBy("position").collect()] == [3, 3, 4]
    assert looked_up["verification_summary"].first().status == "passed"


def test_tables_of_values_where_they_do_not_belong(spark):
    df = texts(spark, "a")
    allowed = spark.createDataFrame([("a",)], "v string")
    for rule in (
        Rule("r", "x", "positive", allowed_table=allowed),
        Rule("r", "x", "allowed_values", allowed_values=["a"], allowed_table=allowed),
    ):
        with pytest.raises(ValueError):
            check_rules(df, [rule])
    with pytest.raises(ValueError):
        rules_by_slice(df, ["x"], [Rule("r", "x", "allowed_values", allowed_table=allowed)])
    nothing = allowed.limit(0)
    assert count(df, Rule("r", "x", "allowed_values", allowed_table=nothing)) == 1
