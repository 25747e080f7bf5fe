"""Missing values per column and for the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.grading import check_status, check_thresholds, graded
from plumbline.plans.table import Scan, Table, rows_of

MISSING_ROW = "position int, column_name string, row_count bigint, null_count bigint"


def plan_missing(
    scan: Scan, warning_threshold: float = 5.0, high_threshold: float = 20.0
) -> Column:
    check_thresholds(warning_threshold, high_threshold)
    rows = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(name).alias("column_name"),
            scan.row_count.alias("row_count"),
            (scan.row_count - scan.present_count(name)).alias("null_count"),
        )
        for position, name in enumerate(scan.table.names)
    ]
    return graded(
        rows_of(rows, MISSING_ROW),
        "null_count", "row_count", "null_percentage", warning_threshold, high_threshold,
    )


def summarize_missing(result: DataFrame) -> DataFrame:
    """Roll the rows of ``plan_missing``, held in the column ``missing``, up to one row."""
    total = F.aggregate("missing", F.lit(0).cast("long"), lambda n, row: n + row["null_count"])
    affected = F.size(F.filter("missing", lambda row: row["null_count"] > 0))
    any_high = F.exists("missing", lambda row: row["severity"] == "high")
    return result.select(
        "dataset",
        check_status(total, any_high).alias("status"),
        total.alias("total_missing_values"),
        F.size("missing").cast("long").alias("columns_checked"),
        affected.cast("long").alias("columns_with_missing_values"),
    )


def _missing(df: DataFrame, dataset: str, warning_threshold: float, high_threshold: float):
    scan = Scan(Table.of(df), dataset)
    return scan.row(missing=plan_missing(scan, warning_threshold, high_threshold))


def check_missing(
    df: DataFrame,
    dataset: str = "dataset",
    warning_threshold: float = 5.0,
    high_threshold: float = 20.0,
) -> DataFrame:
    """One row per column: missing count, percentage of rows, and severity."""
    result = _missing(df, dataset, warning_threshold, high_threshold)
    return result.select("dataset", F.inline("missing"))


def missing_summary(
    df: DataFrame,
    dataset: str = "dataset",
    warning_threshold: float = 5.0,
    high_threshold: float = 20.0,
) -> DataFrame:
    """One row: status, total of missing values, columns checked and affected."""
    return summarize_missing(_missing(df, dataset, warning_threshold, high_threshold))
