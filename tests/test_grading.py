import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.grading import check_thresholds, percent, round2, severity


def test_rounding_equals_python(spark):
    random.seed(7)
    pairs = [(n, whole) for whole in (1, 3, 7, 8, 16, 32, 160, 800, 1600, 6000, 60000) for n in range(0, whole + 1, max(1, whole // 97))]
    pairs += [(random.randrange(10**6), 10**6) for _ in range(300)]
    pairs += [(25953, 60000), (1, 800), (1, 1_000_000), (0, 5), (5, 0)]
    df = spark.createDataFrame(pairs, "part bigint, whole bigint")
    got = df.select("part", "whole", percent(F.col("part"), F.col("whole"))).collect()
    for part, whole, share in got:
        expected = round(part / whole * 100, 2) if whole else 0.0
        assert share == expected, (part, whole)


def test_rounding_of_ties_and_near_ties(spark):
    values = [0.125, 0.375, 1.005, 1.015, 2.675, 43.255, 0.0, 99.995, 100.0, 12.345]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(round2(F.col("x"))).collect()] == [round(v, 2) for v in values]


@pytest.mark.parametrize(
    ("share", "expected"),
    [(0.0, "ok"), (0.01, "low"), (5.0, "low"), (5.01, "medium"), (20.0, "medium"), (20.01, "high")],
)
def test_severity(spark, share, expected):
    df = spark.createDataFrame([(share,)], "x double")
    assert df.select(severity(F.col("x"), 5.0, 20.0)).first()[0] == expected


@pytest.mark.parametrize(("warning", "high"), [(-1, 5), (1, -5), (6, 5)])
def test_thresholds_are_checked(warning, high):
    with pytest.raises(ValueError):
        check_thresholds(warning, high)
