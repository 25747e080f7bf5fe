"""Estimates against exact counts, whole and merged."""

import pytest
from pyspark.sql import functions as F

import plumbline as pl
from plumbline.operators.distinct import distinct_counts, distinct_states, estimates, free_text, merge_distinct
from tests.conftest import plan_of


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(20_000).select(
        "id",
        F.when(F.col("id") % 3 != 0, F.col("id") % 500).alias("some"),
        F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(-0.0) * F.col("id") % 2).alias("a.b"),
        F.concat(F.lit("text "), F.col("id") % 9000).alias("text"),
        F.array(F.col("id") % 7).alias("list"),
        F.create_map(F.lit("k"), F.col("id") % 5).alias("map"),
        F.lit(None).cast("string").alias("none"),
    ).repartition(5)


EXACT = {"id": 20_000, "some": 500, "a.b": 1, "text": 9000, "list": 7, "map": 5, "none": 0}


def counts(found):
    return {r.column_name: r.distinct_count for r in found.collect()}


def test_exact(df):
    assert counts(distinct_counts(df, exact=True)) == EXACT


def test_estimates_are_near(df):
    for name, n in counts(distinct_counts(df)).items():
        assert n == pytest.approx(EXACT[name], rel=0.06), name


def test_parts_merge_to_the_whole(df):
    parts = [distinct_states(df.filter(F.col("id") % 4 == k)) for k in range(4)]
    merged = merge_distinct(parts[0].union(parts[1]).union(parts[2]).union(parts[3]))
    for name, n in counts(estimates(merged)).items():
        assert n == pytest.approx(EXACT[name], rel=0.06), name
    assert merged.filter("column_name = 'some'").first().non_null_count == 13_333


def test_one_pass_without_a_shuffle_of_data(spark, df, tmp_path):
    df.select("id", "some", "text").write.parquet(str(tmp_path / "t"))
    plan = plan_of(distinct_counts(spark.read.parquet(str(tmp_path / "t"))))
    assert plan.count("FileScan") == 1 and "hashpartitioning" not in plan and "Expand" not in plan


def test_empty_and_guards(spark, df):
    for exact in (True, False):
        assert counts(distinct_counts(df.limit(0), exact=exact)) == dict.fromkeys(EXACT, 0)
        assert distinct_counts(spark.createDataFrame([()] * 2, "struct<>"), exact=exact).count() == 0
    with pytest.raises(ValueError):
        distinct_states(df, 3)


def test_free_text_gets_no_distribution(df):
    chosen = df.select("id", "text", F.col("some").cast("string").alias("city"))
    assert free_text(chosen, 1000) == ["id", "text"]
    run = pl.auto_run(chosen, "t", max_distinct=1000)
    shown = [q.column_name for q in run.config.sql_queries if q.kind == "distribution"]
    assert shown == ["city"]
    assert [q.column_name for q in pl.auto_run(chosen, "t").config.sql_queries if q.kind == "distribution"] == ["text", "city"]
