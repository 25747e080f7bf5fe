"""Distributions of several columns from one pass, against one query for each."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import plumbline as pl
from plumbline.operators import distributions as shared
from plumbline.operators.distributions import can_share_pass, distributions, value_groups
from plumbline.operators.sqlcheck import as_text, value_distribution
from plumbline.plans.table import Table
from tests.conftest import plan_of


def alone(df, column, most):
    """What grouping by the values themselves gives."""
    all_rows = as_text(value_distribution(df, column)).collect()
    return len(all_rows), [(r["value"], int(r["row_count"])) for r in all_rows[:most]]


def same(df, columns, most):
    found = distributions(df, columns, most)
    for column, (n, rows) in zip(columns, found, strict=True):
        assert (n, [("" if v is None else v, c) for v, c in rows]) == alone(df, column, most), column


@pytest.fixture(scope="module")
def typed(spark):
    i = F.col("id")
    return spark.range(4000).select(
        "id",
        F.when(i % 5 != 0, i % 70 - 35).cast("int").alias("whole"),
        F.when(i % 9 == 0, F.lit(float("nan"))).when(i % 2 == 0, F.lit(-0.0)).otherwise(i % 11 / 4).alias("half.ed"),
        (i % 13).cast("decimal(12,2)").alias("price"),
        F.date_add(F.lit("1969-12-01"), (i % 60).cast("int")).alias("day"),
        F.timestamp_micros(i % 40 - 20).alias("moment"),
        F.timestamp_micros((i % 40 - 20) * 1_799_999_999).cast("timestamp_ntz").alias("local"),
        F.when(i % 3 != 0, i % 2 == 0).alias("flag"),
        F.concat(F.lit("w"), i % 90).alias("word"),
        F.lit(None).cast("string").alias("none"),
    ).repartition(6)


@pytest.mark.parametrize("most", [0, 1, 7, 50])
def test_values_of_all_types(typed, most):
    same(typed, typed.columns, most)


@pytest.mark.parametrize("most", [1, 3, 10, 60])
def test_longer_texts_are_ordered_by_the_whole_text(spark, most):
    random.seed(most)
    start = "é" * 31 + "x"
    pool = [start, start[:-1], "", None, "z" * 40, "z" * 32, "a"]
    pool += [start + tail for tail in ("", "b", "a", "ab", "é", "𝔞", " " * 9)]
    pool += [f"{start}{i:04d}" for i in range(40)]
    rows = [(v, v) for v in pool * 2 + random.choices(pool, k=30)]
    df = spark.createDataFrame(rows, "one string, `One` string").repartition(4)
    same(df, ["one", "One"], most)


@pytest.mark.parametrize("sent", [0, 100_000])
def test_random_texts_with_many_ties(spark, monkeypatch, sent):
    monkeypatch.setattr(shared, "SENT_TO_ALL", sent)
    random.seed(5)
    for most in (2, 5, 20):
        texts = ["".join(random.choices("ab", k=random.randint(30, 36))) for _ in range(60)]
        df = spark.createDataFrame([(t,) for t in random.choices(texts, k=150)], "t string").repartition(3)
        same(df, ["t"], most)


def test_very_long_texts_and_one_hot_value(spark):
    df = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, F.repeat(F.lit("word "), 20_000))
        .otherwise(F.concat(F.repeat(F.lit("word "), 20_000), F.col("id") % 7))
        .alias("text")
    )
    same(df, ["text"], 4)


def test_one_scan_and_one_shuffle_without_texts(typed, spark, tmp_path, monkeypatch):
    typed.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    table = Table.of(df)
    plan = plan_of(value_groups(table, [table.position(name) for name in ("whole", "word", "none")]))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "substring" in plan
    # Short values need no second look at the table.
    monkeypatch.setattr(shared, "_looked_up", None)
    same(df, ["whole", "word", "none"], 9)


def test_empty_tables_and_repeated_columns(spark, typed):
    assert distributions(typed.limit(0), ["whole", "word"]) == [(0, []), (0, [])]
    assert distributions(typed, []) == []
    one, other = distributions(typed, ["word", "word"], 3)
    assert one == other and len(one[1]) == 3
    assert pl.value_distributions(typed.limit(0), ["word"]).count() == 0


def test_refused(typed, spark):
    with pytest.raises(ValueError, match="no such columns"):
        distributions(typed, ["nope"])
    with pytest.raises(ValueError, match="at most 1000"):
        distributions(typed, ["word"], 1001)
    wide = spark.createDataFrame([(Decimal(1),)], "d decimal(38,2)")
    with pytest.raises(ValueError, match="pass of their own"):
        distributions(wide, ["d"])
    assert not can_share_pass(T.ArrayType(T.StringType()))


def test_runs_answer_distributions_together(spark, typed, monkeypatch):
    df = typed.select("word", F.col("whole").alias("status"), F.concat(F.repeat("word", 20), "flag").alias("city"))
    config = pl.auto_run(df).config
    together = pl.run_checks(df, config).sql_rows.orderBy("query_name", "row_number").collect()

    def failing(*_):
        raise RuntimeError("no shared pass")

    monkeypatch.setattr("plumbline.operators.sqlcheck.distributions", failing)
    one_by_one = pl.run_checks(df, config).sql_rows.orderBy("query_name", "row_number").collect()
    assert together == one_by_one and len({r.query_name for r in together if "distribution" in r.query_name}) == 3
