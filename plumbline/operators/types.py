"""Conformance of values to an expected logical type."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.grading import (
    check_limit,
    check_status,
    check_thresholds,
    graded,
)
from plumbline.functions.parsing import is_checkable
from plumbline.functions.text import is_boolean_word
from plumbline.operators.examples import first_offenders, pick
from plumbline.plans.config import EXPECTED_TYPES
from plumbline.plans.table import Scan, Table, rows_of

TYPE_ROW = (
    "position int, column_name string, expected_type string, data_type string, "
    "non_null_count bigint, invalid_count bigint"
)
TYPE_EXAMPLE_ROW = (
    "dataset string, column_name string, expected_type string, example_rank int, "
    "row_label string, value string"
)


def check_expected_schema(table: Table, expected_schema: Mapping[str, str]) -> None:
    table.require(expected_schema, "expected schema")
    unknown = sorted(set(expected_schema.values()) - set(EXPECTED_TYPES))
    if unknown:
        raise ValueError(f"unsupported expected types {unknown}")
    for name, expected in expected_schema.items():
        if expected != "string" and not is_checkable(table.kind(name)):
            raise ValueError(
                f"column {name!r} of type {table.kind(name).simpleString()} "
                f"cannot be checked as {expected}"
            )


def is_invalid(
    scan: Scan, name: str, expected: str, date_formats: tuple[str, ...] = ()
) -> Column:
    """Whether a present value does not read as the expected type. Missing values are not judged."""
    value = scan.table.column(name)
    if expected == "string":
        return F.lit(False)
    if expected == "date":
        return value.isNotNull() & scan.timestamp(name, date_formats).isNull()
    if expected == "boolean":
        return value.isNotNull() & ~is_boolean_word(value.cast("string"))
    number = scan.number(name)
    if expected == "integer":
        # An infinity leaves NaN here, which differs from zero as well.
        return value.isNotNull() & F.coalesce(number % 1.0 != 0, F.lit(True))
    return value.isNotNull() & number.isNull()


def plan_types(
    scan: Scan,
    expected_schema: Mapping[str, str],
    warning_threshold: float = 1.0,
    high_threshold: float = 5.0,
    date_formats: tuple[str, ...] = (),
) -> Column:
    check_thresholds(warning_threshold, high_threshold)
    check_expected_schema(scan.table, expected_schema)
    rows = []
    for position, (name, expected) in enumerate(expected_schema.items()):
        bad = is_invalid(scan, name, expected, date_formats)
        present = scan.present_count(name)
        invalid = scan.total(f"invalid_{position}", F.count_if(bad))
        rows.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(name).alias("column_name"),
                F.lit(expected).alias("expected_type"),
                F.lit(scan.table.kind(name).simpleString()).alias("data_type"),
                present.alias("non_null_count"),
                invalid.alias("invalid_count"),
            )
        )
    return graded(
        rows_of(rows, TYPE_ROW),
        "invalid_count", "non_null_count", "invalid_percentage", warning_threshold, high_threshold,
    )


def summarize_types(result: DataFrame) -> DataFrame:
    total = F.aggregate("types", F.lit(0).cast("long"), lambda n, row: n + row["invalid_count"])
    checked = F.aggregate("types", F.lit(0).cast("long"), lambda n, row: n + row["non_null_count"])
    affected = F.size(F.filter("types", lambda row: row["invalid_count"] > 0))
    any_high = F.exists("types", lambda row: row["severity"] == "high")
    return result.select(
        "dataset",
        check_status(total, any_high).alias("status"),
        F.size("types").cast("long").alias("columns_checked"),
        affected.cast("long").alias("columns_with_invalid_values"),
        total.alias("total_invalid_values"),
        checked.alias("total_checked_values"),
    )


def _types(df, expected_schema, dataset, warning_threshold, high_threshold, date_formats):
    scan = Scan(Table.of(df), dataset)
    return scan.row(
        types=plan_types(scan, expected_schema, warning_threshold, high_threshold, date_formats)
    )


def check_types(
    df: DataFrame,
    expected_schema: Mapping[str, str],
    dataset: str = "dataset",
    warning_threshold: float = 1.0,
    high_threshold: float = 5.0,
    date_formats: tuple[str, ...] = (),
) -> DataFrame:
    """One row per column of the expected schema: present and invalid values, and severity."""
    result = _types(
        df, expected_schema, dataset, warning_threshold, high_threshold, date_formats
    )
    return result.select("dataset", F.inline("types"))


def type_summary(
    df: DataFrame,
    expected_schema: Mapping[str, str],
    dataset: str = "dataset",
    warning_threshold: float = 1.0,
    high_threshold: float = 5.0,
    date_formats: tuple[str, ...] = (),
) -> DataFrame:
    """One row: status, columns checked and affected, total of invalid values."""
    return summarize_types(
        _types(df, expected_schema, dataset, warning_threshold, high_threshold, date_formats)
    )


def type_examples(
    df: DataFrame,
    expected_schema: Mapping[str, str],
    row_id: Sequence[str] = (),
    dataset: str = "dataset",
    max_examples: int = 10,
    date_formats: tuple[str, ...] = (),
) -> DataFrame:
    """The first invalid values of every column, with the row they come from."""
    check_limit("max_examples", max_examples)
    table = Table.of(df)
    check_expected_schema(table, expected_schema)
    judged = judged_columns(expected_schema)
    if not judged or max_examples == 0:
        return df.sparkSession.createDataFrame([], TYPE_EXAMPLE_ROW)
    scan = Scan(table, dataset)
    offences = type_offences(scan, judged, date_formats)
    found = first_offenders(scan, offences, row_id, max_examples)
    return label_type_examples(found, judged, dataset)


def judged_columns(expected_schema: Mapping[str, str]) -> dict[str, str]:
    """The columns that can hold an invalid value at all."""
    return {name: expected for name, expected in expected_schema.items() if expected != "string"}


def type_offences(
    scan: Scan, expected_schema: Mapping[str, str], date_formats: tuple[str, ...] = ()
) -> list[tuple[Column, Column]]:
    return [
        (is_invalid(scan, name, expected, date_formats), scan.table.column(name).cast("string"))
        for name, expected in expected_schema.items()
    ]


def label_type_examples(
    found: DataFrame, expected_schema: Mapping[str, str], dataset: str
) -> DataFrame:
    return found.select(
        F.lit(dataset).alias("dataset"),
        pick(list(expected_schema)).alias("column_name"),
        pick(list(expected_schema.values())).alias("expected_type"),
        "example_rank",
        "row_label",
        "value",
    )
