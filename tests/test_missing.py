from decimal import Decimal
import pytest
from conftest import one, rows

from plumbline import check_missing, missing_summary, profile_columns, sample_values


def test_no_missing_values(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    assert one(missing_summary(df)).status == "passed"
    assert rows(check_missing(df), "column_name", "null_count", "null_percentage", "severity") == [
        ("id", 0, 0.0, "ok"),
        ("name", 0, 0.0, "ok"),
    ]


def test_mostly_missing_column_fails(spark):
    df = spark.createDataFrame([(i, "a" if i == 0 else None) for i in range(5)], "id int, email string")
    assert rows(check_missing(df), "column_name", "null_count", "null_percentage", "severity")[0] == (
        "email", 4, 80.0, "high",
    )
    found = one(missing_summary(df))
    assert (found.status, found.total_missing_values, found.columns_checked, found.columns_with_missing_values) == ("failed", 4, 2, 1)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("nan"), None)], "a double, b float")
    assert rows(check_missing(df), "column_name", "null_count") == [("a", 1), ("b", 1)]


def test_severity_uses_the_rounded_share_and_status_the_count(spark):
    df = spark.range(100_000).selectExpr("nullif(id, 5) AS x")
    assert one(check_missing(df)).severity == "ok"
    assert one(missing_summary(df)).status == "warning"


def test_thresholds(spark):
    df = spark.createDataFrame([(None,), (1,)], "x int")
    assert one(check_missing(df, warning_threshold=50, high_threshold=60)).severity == "low"
    with pytest.raises(ValueError):
        check_missing(df, warning_threshold=30, high_threshold=20)


def test_empty_table_and_no_columns(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert rows(check_missing(empty), "null_count", "null_percentage", "severity") == [(0, 0.0, "ok")] * 2
    assert one(missing_summary(empty)).status == "passed"
    bare = spark.createDataFrame([(1,)], "a int").select()
    assert one(missing_summary(bare)).columns_checked == 0
    assert rows(check_missing(bare)) == []
    assert rows(profile_columns(bare)) == []
    assert rows(sample_values(bare)) == []


def test_profile(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "y", 1.5), (3, "x", 2.5)], "id bigint, name string, v double")
    found = {r.column_name: r for r in profile_columns(df, "t").collect()}
    assert found["v"].asDict() == {
        "dataset": "t", "row_count": 3, "column_count": 3, "position": 2, "column_name": "v",
        "data_type": "double", "non_null_count": 2, "null_count": 1, "null_percentage": 33.33,
    }


def test_column_names_that_need_quoting(spark):
    df = spark.createDataFrame([(1, None, 3, None)], "`a.b` int, `c d` int, `x``y` int, `select` int")
    assert rows(check_missing(df), "column_name", "null_count") == [
        ("a.b", 0), ("c d", 1), ("select", 1), ("x`y", 0),
    ]


def test_nested_columns(spark):
    df = spark.sql("SELECT array(1, 2) AS a, map('k', 1) AS m, named_struct('f', 1) AS s UNION ALL SELECT null, null, null")
    assert rows(check_missing(df), "column_name", "null_count") == [("a", 1), ("m", 1), ("s", 1)]
    assert rows(sample_values(df), "column_name", "sample_value") == [
        ("a", "[1, 2]"), ("m", "{k -> 1}"), ("s", "{1}"),
    ]


def test_samples_are_the_smallest_distinct_values(spark):
    # One value fills a third of all rows, in every partition.
    df = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 ELSE id + 10 END AS n",
        "CASE WHEN id % 3 = 0 THEN 'k' ELSE concat('k', cast(id AS string)) END AS t",
        "id % 2 = 0 AS b",
        "CASE WHEN id % 3 = 0 THEN double('nan') WHEN id % 3 = 1 THEN -0.0D ELSE 0.0D END AS z",
        "CAST(id AS decimal(10,1)) AS d",
        "date_add(date'2024-01-01', cast(id % 700 AS int)) AS day",
    ).repartition(7)
    pdf = df.toPandas()
    found = {}
    for r in sample_values(df).orderBy("position", "sample_rank").collect():
        found.setdefault(r.column_name, []).append(r.sample_value)
    assert found["n"] == [str(v) for v in sorted(set(pdf.n))[:5]]
    assert found["t"] == sorted(set(pdf.t))[:5]
    assert found["b"] == ["false", "true"]
    assert found["z"] == ["0.0"]
    assert found["d"] == ["0.0", "1.0", "2.0", "3.0", "4.0"]
    assert found["day"] == [str(v) for v in sorted(set(pdf.day))[:5]]
    assert sample_values(df, max_values=2).count() == 11
    assert sample_values(df, max_values=0).count() == 0


def test_sample_values_in_the_order_of_their_own_type(spark):
    """Numbers that a double can't tell apart, and decimals, of either sign."""
    edge = 2**62
    longs = [sign * edge + i for sign in (-1, 1) for i in range(8)]
    df = spark.createDataFrame(
        [(n, Decimal(n) / 10**15, str(n)) for n in reversed(longs)], "n bigint, d decimal(38,15), t string"
    ).repartition(5)
    found = {}
    for r in sample_values(df).orderBy("position", "sample_rank").collect():
        found.setdefault(r.column_name, []).append(r.sample_value)
    assert found["n"] == [str(n) for n in sorted(longs)[:5]]
    assert [Decimal(x) for x in found["d"]] == [Decimal(n) / 10**15 for n in sorted(longs)[:5]]
    assert found["t"] == sorted(map(str, longs))[:5]
