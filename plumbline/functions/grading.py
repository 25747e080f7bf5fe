"""Percentages, severities and statuses as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Splits a double into two halves whose products with small integers are exact.
SPLITTER = 134217729.0


def round2(value: Column) -> Column:
    """Round a non-negative double to two decimals the way Python's ``round`` does.

    Spark's round works on the printed digits and sends ties up. Here the side of the midpoint is
    found from the exact binary value, and only a true tie goes to the even neighbour.
    """
    below = F.floor(value * 100.0)
    scaled = value * SPLITTER
    high = scaled - (scaled - value)
    low = value - high
    past_middle = (high * 200.0 - (below * 2 + 1).cast("double")) + low * 200.0
    up = (past_middle > 0) | ((past_middle == 0) & (below % 2 == 1))
    return F.when(up, below + 1).otherwise(below).cast("double") / 100.0


def percent(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``, two decimals; 0.0 where there is nothing to divide by."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.coalesce(round2(ratio * 100.0), F.lit(0.0))


def graded(
    rows: Column, part: str, whole: str, share: str, warning_threshold: float, high_threshold: float
) -> Column:
    """Result rows with the percentage ``share`` of ``part`` in ``whole`` and a severity added.

    Done inside the array, the formulas are in the plan once and not once per row.
    """
    rows = F.transform(rows, lambda row: row.withField(share, percent(row[part], row[whole])))
    return F.transform(
        rows,
        lambda row: row.withField(
            "severity", severity(row[share], warning_threshold, high_threshold)
        ),
    )


def check_thresholds(warning_threshold: float, high_threshold: float) -> None:
    if warning_threshold < 0 or high_threshold < 0:
        raise ValueError("thresholds must not be negative")
    if warning_threshold > high_threshold:
        raise ValueError("warning_threshold must not exceed high_threshold")


def check_limit(name: str, limit: int) -> None:
    if limit < 0:
        raise ValueError(f"{name} must not be negative")


def severity(percentage: Column, warning_threshold: float, high_threshold: float) -> Column:
    return (
        F.when(percentage == 0, "ok")
        .when(percentage <= warning_threshold, "low")
        .when(percentage <= high_threshold, "medium")
        .otherwise("high")
    )


def check_status(issues: Column, any_high: Column) -> Column:
    """Status of a whole check: it follows the raw count, not the rounded percentage."""
    return F.when(issues == 0, "passed").when(any_high, "failed").otherwise("warning")
