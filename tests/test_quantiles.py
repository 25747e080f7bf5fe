"""Quantiles by rank, exact ones by sorting, drift by shifted values."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators.quantiles import (
    merge_quantiles,
    numeric_quantiles,
    quantile_drift,
    quantile_states,
    quantiles_of,
)
from plumbline.plans.storage import settle
from tests.conftest import plan_of

P = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)


@pytest.fixture(scope="module")
def df(spark):
    number = (F.col("id") * 7919) % 20_011
    return spark.range(20_011).select(
        "id",
        number.cast("double").alias("a.b"),
        F.when(F.col("id") % 10 == 0, F.lit("no number")).otherwise((number * 2).cast("string")).alias("text"),
        F.when(F.col("id") % 4 == 0, F.lit(float("nan"))).when(F.col("id") % 4 == 1, F.lit(float("inf")))
        .otherwise(F.lit(5.0)).alias("same"),
        F.lit(None).cast("double").alias("none"),
    ).repartition(6)


def values(found):
    return {(r.column_name, r.probability): r.value for r in found.collect()}


def test_exact(df):
    found = values(numeric_quantiles(df, ["a.b", "text", "same", "none"], P, exact=True))
    for p in P:
        assert found["a.b", p] == max(1, math.ceil(p * 20_011)) - 1
        assert found["same", p] == 5.0 and found["none", p] is None
    numbers = sorted(2 * ((i * 7919) % 20_011) for i in range(20_011) if i % 10)
    assert all(found["text", p] == numbers[max(1, math.ceil(p * len(numbers))) - 1] for p in P)


def test_estimates_are_near_in_rank(df):
    found = numeric_quantiles(df, ["a.b", "same", "none"], P)
    near = values(found)
    for p in P:
        assert abs(near["a.b", p] / 20_010 - p) < 0.025
        assert near["same", p] == 5.0 and near["none", p] is None
    assert {r.column_name: r.value_count for r in found.collect()} == {"a.b": 20_011, "same": 10_005, "none": 0}


def test_parts_merge_and_drift(df):
    parts = [quantile_states(df.filter(F.col("id") % 3 == k), ["a.b", "none"]) for k in range(3)]
    whole = settle(merge_quantiles(parts[0].union(parts[1]).union(parts[2])))  # sketches are drawn anew each time
    for (name, p), value in values(quantiles_of(whole, P)).items():
        assert (value is None) if name == "none" else abs(value / 20_010 - p) < 0.03
    shifted = quantile_states(df.select((F.col("`a.b`") + 6003).alias("a.b")), ["a.b"])
    drift = {r.column_name: r.drift for r in quantile_drift(whole, shifted).collect()}
    assert drift["a.b"] == pytest.approx(0.3, abs=0.04)
    assert quantile_drift(parts[0], parts[1]).filter("column_name = 'a.b'").first().drift < 0.05
    assert quantile_drift(whole, whole).filter("column_name = 'a.b'").first().drift == 0


def test_one_pass_and_guards(spark, df, tmp_path):
    df.select("id", "text").write.parquet(str(tmp_path / "t"))
    plan = plan_of(numeric_quantiles(spark.read.parquet(str(tmp_path / "t")), ["id", "text"]))
    assert plan.count("FileScan") == 1 and "hashpartitioning" not in plan
    assert values(numeric_quantiles(df.limit(0), ["id"], P, exact=True)) == {("id", p): None for p in P}
    assert numeric_quantiles(df, []).count() == 0
    for options in ({"columns": ["no"]}, {"columns": ["id"], "probabilities": (2,)}, {"columns": ["id"], "probabilities": ()}):
        with pytest.raises(ValueError):
            numeric_quantiles(df, **options)
