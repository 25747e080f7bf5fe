import datetime as dt

import pytest
from conftest import one, plan_of, rows

from plumbline import check_types, type_examples, type_summary
from plumbline.operators.examples import first_offenders
from plumbline.operators.types import type_offences
from plumbline.plans.table import Scan, Table

SHOWN = ("column_name", "non_null_count", "invalid_count", "invalid_percentage", "severity")


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(
        [
            (10, "640", "5", "2018-02-28", "no"),
            (20, "6.4", "many", None, "perhaps"),
            (30, " 77 ", "-3", "2018-02-29", "TRUE"),
            (40, None, None, "2019-12-31 10:30", None),
            (50, "+9", "12 cm", "soon", "y"),
        ],
        "row int, seat string, stairs string, opened string, lift string",
    )


SCHEMA = {"seat": "integer", "stairs": "integer", "opened": "date", "lift": "boolean"}


def test_four_types_with_bad_values_and_nulls(mixed):
    assert rows(check_types(mixed, SCHEMA), *SHOWN) == [
        ("lift", 4, 1, 25.0, "high"),
        ("opened", 4, 2, 50.0, "high"),
        ("seat", 4, 1, 25.0, "high"),
        ("stairs", 4, 2, 50.0, "high"),
    ]
    found = one(type_summary(mixed, SCHEMA))
    assert (found.status, found.columns_checked, found.columns_with_invalid_values, found.total_invalid_values) == ("failed", 4, 4, 6)


def test_examples(mixed):
    found = rows(type_examples(mixed, SCHEMA, ["row"]), "column_name", "example_rank", "row_label", "value")
    assert found == [
        ("lift", 1, "20", "perhaps"),
        ("opened", 1, "30", "2018-02-29"),
        ("opened", 2, "50", "soon"),
        ("seat", 1, "20", "6.4"),
        ("stairs", 1, "20", "many"),
        ("stairs", 2, "50", "12 cm"),
    ]
    assert type_examples(mixed, SCHEMA, ["row"], max_examples=1).count() == 4
    assert type_examples(mixed, SCHEMA, max_examples=0).count() == 0
    assert {r.row_label for r in type_examples(mixed, SCHEMA).collect()} == {None}
    with pytest.raises(ValueError):
        type_examples(mixed, SCHEMA, ["nope"])


@pytest.mark.parametrize(("first", "invalid"), [(-6.0, 0), (0.25, 1), (float("-inf"), 1), (1e300, 0), (None, 0), (float("nan"), 0)])
def test_integers_among_floating_numbers(spark, first, invalid):
    df = spark.createDataFrame([(512.0,), (first,), (0.0,)], "x double")
    assert one(check_types(df, {"x": "integer"})).invalid_count == invalid
    assert one(check_types(df, {"x": "float"})).invalid_count == 0


def test_values_that_are_not_text(spark):
    df = spark.createDataFrame(
        [(1, 1.0, True, dt.date(2024, 1, 1), dt.datetime(2024, 1, 1))],
        "i int, f double, b boolean, d date, t timestamp",
    )
    invalid = lambda **schema: [r[0] for r in rows(check_types(df, schema), "invalid_count")]
    assert invalid(i="boolean", f="boolean", b="boolean") == [0, 0, 1]
    assert invalid(i="date", f="date", d="date", t="date") == [0] * 4
    assert invalid(b="date") == [1]
    assert invalid(d="integer", t="numeric", b="integer") == [0] * 3
    assert invalid(i="string", d="string") == [0, 0]


def test_all_missing_and_empty(spark):
    df = spark.createDataFrame([(None,)], "x string")
    assert rows(check_types(df, {"x": "integer"}), *SHOWN) == [("x", 0, 0, 0.0, "ok")]
    assert one(type_summary(df.limit(0), {"x": "date"})).status == "passed"
    assert one(type_summary(df, {})).columns_checked == 0


def test_schema_is_checked_before_any_job(spark):
    df = spark.sql("SELECT 1 AS id, array(1) AS a")
    for schema in ({"ID": "integer"}, {"nope": "integer"}, {"id": "number"}, {"a": "integer"}):
        with pytest.raises(ValueError):
            check_types(df, schema)
    assert one(check_types(df, {"a": "string"})).invalid_count == 0
    with pytest.raises(ValueError):
        type_examples(df, {"id": "integer"}, max_examples=-1)


def test_further_date_formats(spark):
    df = spark.createDataFrame([("01/15/2024",), ("2024-01-15",)], "d string")
    assert one(check_types(df, {"d": "date"})).invalid_count == 1
    assert one(check_types(df, {"d": "date"}, date_formats=("MM/dd/yyyy",))).invalid_count == 0


def test_examples_of_a_column_that_is_mostly_invalid(spark):
    df = spark.range(20_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'bad' ELSE 'x' END AS v")
    found = type_examples(df.repartition(9), {"v": "integer"}, ["id"], max_examples=7)
    assert rows(found, "example_rank", "row_label") == [(i + 1, str(i)) for i in range(7)]
    plan = plan_of(found)
    # Only a few candidates per task, item and slice are shuffled.
    assert plan.count("WindowGroupLimit") == 4


def test_examples_in_the_order_of_ids(spark):
    """Ids with gaps, repeats and nulls, for two columns with different offenders."""
    df = spark.range(5_000).selectExpr(
        "CASE WHEN id % 500 = 7 THEN null ELSE (id * 7919) % 3001 END AS row",
        "CASE WHEN id % 3 = 0 THEN 'bad' ELSE '1' END AS a",
        "CASE WHEN (id * 7919) % 3001 > 2990 THEN concat('x', id) ELSE '2' END AS b",
    )
    pdf = df.toPandas()
    scan = Scan(Table.of(df))
    offences = type_offences(scan, {"a": "integer", "b": "integer"})
    found = first_offenders(scan, offences, ["row"], 12)
    for item, column in enumerate("ab"):
        bad = pdf[~pdf[column].isin(["1", "2"])]
        bad = bad.sort_values(["row", column], na_position="first").head(12)
        expected = ["" if r != r else str(int(r)) for r in bad["row"]]
        got = found.filter(f"item = {item}").orderBy("example_rank").collect()
        assert [r.row_label for r in got] == expected
        assert [r.value for r in got] == list(bad[column])


def test_examples_with_few_distinct_ids(spark):
    df = spark.range(300).selectExpr("id % 2 AS row", "concat('v', id) AS a")
    scan = Scan(Table.of(df))
    offences = type_offences(scan, {"a": "integer"})
    found = first_offenders(scan, offences, ["row"], 5)
    assert sorted(r.value for r in found.collect()) == ["v0", "v10", "v100", "v102", "v104"]
