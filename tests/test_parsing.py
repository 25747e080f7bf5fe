import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.parsing import as_number, as_timestamp
from plumbline.functions.text import WHITESPACE, is_boolean_word, strip

NUMBERS = {
    "29": 29.0, " 29 ": 29.0, "\t29\n": 29.0, "1e3": 1000.0, ".5": 0.5, "5.": 5.0, "-0.5": -0.5,
    "+7": 7.0, "inf": float("inf"), "-Infinity": float("-inf"), "1E-2": 0.01,
}
NOT_NUMBERS = ["", " ", ".", "1d", "1f", "0x10", "1_000", "nan", "NaN", "unknown", "1 2", "1,5", "--1", "e5"]
DATES = ["2024-01-15", " 2024-01-15 ", "2024-01-15 10:20", "2024-01-15T10:20:30", "2024-01-15T10:20:30.123456Z", "2024-01-15 10:20:30+05:30", "2024-02-29"]
NOT_DATES = ["", "not-a-date", "2024", "now", "2024-01-15 junk", "2024-13-01", "2023-02-29", "01/15/2024", "2024-1-5", "today"]


def parsed(spark, values, kind, parse):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("x", kind)]))
    return [r[0] for r in df.select(parse(F.col("x"), kind)).collect()]


def test_numbers_in_text(spark):
    assert parsed(spark, list(NUMBERS), T.StringType(), as_number) == list(NUMBERS.values())
    assert parsed(spark, NOT_NUMBERS, T.StringType(), as_number) == [None] * len(NOT_NUMBERS)


def test_dates_in_text(spark):
    assert None not in parsed(spark, DATES, T.StringType(), as_timestamp)
    assert parsed(spark, NOT_DATES, T.StringType(), as_timestamp) == [None] * len(NOT_DATES)


def test_further_date_formats(spark):
    got = parsed(
        spark, ["01/15/2024", "2024-01-15", "x"], T.StringType(),
        lambda c, k: as_timestamp(c, k, ("MM/dd/yyyy",)),
    )
    assert got == [dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 15), None]


def test_numbers_of_other_types(spark):
    assert parsed(spark, [True, False, None], T.BooleanType(), as_number) == [1.0, 0.0, None]
    assert parsed(spark, [Decimal("1.5")], T.DecimalType(10, 2), as_number) == [1.5]
    assert parsed(spark, [dt.date(1970, 1, 2)], T.DateType(), as_number) == [86400e9]


def test_dates_of_other_types(spark):
    assert parsed(spark, [dt.date(2024, 1, 2)], T.DateType(), as_timestamp) == [dt.datetime(2024, 1, 2)]
    assert parsed(spark, [True], T.BooleanType(), as_timestamp) == [None]
    # Numbers count nanoseconds.
    assert parsed(spark, [0, 86400 * 10**9], T.LongType(), as_timestamp) == [
        dt.datetime(1970, 1, 1),
        dt.datetime(1970, 1, 2),
    ]
    assert parsed(spark, [1e300, float("inf")], T.DoubleType(), as_timestamp) == [None, None]


def test_strip_removes_what_python_strips(spark):
    values = [f"{c}a{c}" for c in WHITESPACE] + ["a b", ""]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    assert [r[0] for r in df.select(strip(F.col("x"))).collect()] == [v.strip() for v in values]
    assert {chr(i) for i in range(0x3100) if chr(i).isspace()} == set(WHITESPACE)


@pytest.mark.parametrize(("text", "expected"), [(" Yes", True), ("TRUE", True), ("0", True), ("maybe", False), ("1.0", False), ("", False)])
def test_boolean_words(spark, text, expected):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(is_boolean_word(F.col("x"))).first()[0] is expected
