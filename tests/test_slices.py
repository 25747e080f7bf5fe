"""Slices against the unsliced checks of each slice by itself."""

import pytest
from pyspark.sql import functions as F

import plumbline as pl
from plumbline.operators.slices import check_slices, missing_by_slice, rules_by_slice, types_by_slice
from tests.conftest import plan_of, rows

DATA = [
    ("a", 1, "5", 1.0), ("a", 1, "x", None), ("a", 2, None, float("nan")), ("b", 3, "7", -1.0),
    ("b", 3, "7", -0.0), (None, 4, "200", 2.0), (None, None, "1", 0.0), ("", 5, "", 3.0), ("c", 1, "9", 4.0),
]
RULES = (pl.Rule("age_fits", "age", "range", 0, 120), pl.Rule("key_known", "key", "not_null"))
CONFIG = pl.RunConfig("t", ("key",), {"age": "integer"}, RULES)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(DATA, "status string, key int, age string, `a.b` double").repartition(3)


def of(df, value):
    return df.filter(F.col("status").eqNullSafe(value))


def without(df, *columns):
    return [tuple(r) for r in rows(df.drop("dataset", "slice", "slice_values", *columns))]


@pytest.mark.parametrize("value", ["a", "b", None, "", "c"])
def test_each_slice_equals_its_rows(df, value):
    alone = of(df, value)
    mine = F.col("slice").isNotNull() & F.col("slice_values")["status"].eqNullSafe(value)
    assert without(missing_by_slice(df, ["status"]).filter(mine)) == without(pl.check_missing(alone))
    assert without(rules_by_slice(df, ["status"], RULES).filter(mine)) == without(pl.check_rules(alone, RULES))
    schema = {"age": "integer", "key": "numeric"}
    assert without(types_by_slice(df, ["status"], schema).filter(mine)) == without(pl.check_types(alone, schema))
    result = check_slices(df, ["status"], CONFIG)
    single = pl.run_checks(alone, CONFIG)
    assert without(result.score.filter(mine)) == without(single.score)
    assert without(result.score_components.filter(mine)) == without(single.score_components)
    dup = ("duplicate_row_count", "duplicate_group_count", "duplicate_percentage", "severity", "status")
    assert rows(result.duplicates.filter(mine), *dup) == rows(single.duplicates, *dup)


def test_the_whole_is_the_table(df):
    whole = F.col("slice").isNull()
    result, single = check_slices(df, ["status"], CONFIG), pl.run_checks(df, CONFIG)
    for name in ("counts", "missing", "types", "rules", "score", "score_components"):
        assert without(getattr(result, name).filter(whole)) == without(getattr(single, name)), name
    # A key in two slices repeats in the whole only.
    assert result.duplicates.filter(whole).first()["duplicate_row_count"] == 5
    assert result.duplicates.filter("slice = 'status=c'").first()["duplicate_row_count"] == 0


def test_several_columns_and_odd_names(df):
    found = missing_by_slice(df, ["status", "a.b"]).filter("column_name = 'age'")
    assert {r["slice"] for r in found.collect()} >= {"status=b, a.b=0.0", "status=a, a.b is missing", None}
    assert found.filter("slice = 'status=a, a.b is missing'").first()["row_count"] == 2


def test_guards(df):
    for by in ([], ["no"], ["status", "status"]):
        with pytest.raises(ValueError):
            missing_by_slice(df, by)
    with pytest.raises(ValueError):
        rules_by_slice(df, ["status"], ())


def test_an_empty_table_has_no_slices(df):
    result = check_slices(df.limit(0), ["status"], CONFIG)
    assert all(getattr(result, n).count() == 0 for n in ("counts", "missing", "rules", "types", "duplicates", "score"))


def test_one_scan_with_partial_counts(spark, df, tmp_path):
    df.select("status", "key", "age").write.parquet(str(tmp_path / "t"))
    plan = plan_of(rules_by_slice(spark.read.parquet(str(tmp_path / "t")), ["status"], RULES))
    assert plan.count("FileScan") == 1
    assert plan.rindex("partial_count") > plan.rindex("Exchange hashpartitioning(slice_0")
