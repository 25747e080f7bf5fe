"""Check of a run's results against the data, by a second way of counting, and against each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import key_hashes, key_value
from plumbline.operators.sqlcheck import is_read_only
from plumbline.plans.facts import merge
from plumbline.plans.table import Table


# Added up over the rows of a result table, to be compared with what its summary reports.
SUMS = (
    "missing_sum", "missing_columns", "invalid_sum", "invalid_columns", "violation_sum",
    "violated_rules", "unsafe_queries", "failed_queries", "component_sum", "bad_components",
)
REPORTED = (
    "total_invalid_values", "columns_with_invalid_values", "total_violations",
    "rules_with_violations", "overall_score",
)


def recount(df: DataFrame, key_columns: Sequence[str], dataset: str = "dataset") -> DataFrame:
    """Rows, missing cells and duplicate rows, counted another way than the checks count them.

    Missing cells are counted along rows instead of columns, and duplicates by two hashes of the
    key instead of the key. One scan and one shuffle of hashes give all three.
    """
    table = Table.of(df)
    known = [name for name in key_columns if name in table.names]
    missing_in_row = F.lit(0)
    for name in table.names:
        missing_in_row = missing_in_row + table.column(name).isNull().cast("int")
    kinds = [table.kind(name) for name in known]
    values = [key_value(table.column(name), kind) for name, kind in zip(known, kinds, strict=True)]
    first, second = key_hashes(values, kinds) if known else (F.lit(0), F.lit(0))
    copies = F.col("copies")
    return (
        table.frame.select(
            first.alias("first"), second.alias("second"), missing_in_row.alias("missing")
        )
        .groupBy("first", "second")
        .agg(F.count(F.lit(1)).alias("copies"), F.sum("missing").alias("missing"))
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("actual_rows"),
            F.coalesce(F.sum("missing"), F.lit(0)).cast("long").alias("actual_missing"),
            (
                F.coalesce(F.sum(F.when(copies > 1, copies)), F.lit(0)).cast("long")
                if known
                else F.lit(0).cast("long")
            ).alias("actual_duplicates"),
        )
        .select(
            F.lit(dataset).alias("dataset"),
            "*",
            F.lit(len(table.names)).cast("long").alias("actual_columns"),
            F.lit(len(known) == len(key_columns)).alias("keys_exist"),
        )
    )


def _check(position: int, outcomes: list[tuple[Column, str, str, Column]], name: str) -> Column:
    """The first outcome that applies, each ``(condition, status, check name, message)``."""

    def build(status, check_name, message):
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(check_name).alias("check_name"),
            F.lit(status).alias("status"),
            message.alias("message"),
        )

    result = None
    for condition, status, check_name, message in outcomes:
        outcome = build(status, check_name, message)
        result = F.when(condition, outcome) if result is None else result.when(condition, outcome)
    return result.otherwise(build("passed", name, F.lit("consistent")))


def _differs(reported: str, actual: str) -> Column:
    return ~F.col(reported).eqNullSafe(F.col(actual))


def _reported(reported: str, actual: str) -> Column:
    return F.format_string("reported %s, counted %s", F.col(reported), F.col(actual))


def verify(df: DataFrame, result, recounted: DataFrame | None = None) -> DataFrame:
    """Seven rows, one per part of the result: passed, warning or failed.

    ``result`` is a ``RunResult``, or anything with the same tables, such as one read back from
    storage. ``recounted`` may be given where the data was recounted before.
    """
    reported = result.duplicates.select("key_columns").first()
    key_columns = list((reported and reported["key_columns"]) or Table.of(df).names)
    dataset = result.config.dataset_name
    if recounted is None:
        recounted = recount(df, key_columns, dataset)

    def counted(rows: DataFrame, count: str, sum_name: str, affected_name: str) -> DataFrame:
        return rows.select(
            "dataset", F.col(count).alias(sum_name), (F.col(count) > 0).cast("long").alias(affected_name)
        )

    parts = [
        recounted,
        result.counts.select("dataset", "row_count", "column_count"),
        result.missing_summary.select("dataset", "total_missing_values"),
        counted(result.missing, "null_count", "missing_sum", "missing_columns"),
        result.duplicates.select(
            "dataset", F.col("row_count").alias("duplicate_base"), "duplicate_row_count"
        ),
    ]
    types, rules, queries, score = (
        F.lit(table is not None)
        for table in (result.types, result.rules, result.sql_results, result.score)
    )
    if result.types is not None:
        parts += [
            result.type_summary.select(
                "dataset", "total_invalid_values", "columns_with_invalid_values"
            ),
            counted(result.types, "invalid_count", "invalid_sum", "invalid_columns"),
        ]
    if result.rules is not None:
        parts += [
            result.rule_summary.select("dataset", "total_violations", "rules_with_violations"),
            counted(result.rules, "violation_count", "violation_sum", "violated_rules"),
        ]
    if result.sql_results is not None:
        parts.append(
            result.sql_results.select(
                "dataset",
                (~is_read_only(F.col("sql"))).cast("long").alias("unsafe_queries"),
                (F.col("status") == "failed").cast("long").alias("failed_queries"),
            )
        )
    if result.score is not None:
        parts += [
            result.score.select("dataset", "overall_score"),
            result.score_components.select(
                "dataset",
                F.col("score").cast("long").alias("component_sum"),
                (~F.col("score").between(F.lit(0), F.col("max_score")))
                .cast("long")
                .alias("bad_components"),
            ),
        ]
    merged = merge(parts, SUMS)
    for name in (*SUMS, *REPORTED):
        if name not in merged.columns:
            merged = merged.withColumn(name, F.lit(0).cast("long"))

    # The names of the checks.
    checks = [
        _check(
            0,
            [
                (
                    _differs("row_count", "actual_rows"), "failed", "schema_counts",
                    _reported("row_count", "actual_rows"),
                ),
                (
                    _differs("column_count", "actual_columns"), "failed", "schema_counts",
                    _reported("column_count", "actual_columns"),
                ),
            ],
            "schema_counts",
        ),
        _check(
            1,
            [
                (
                    _differs("total_missing_values", "missing_sum"), "failed",
                    "missing_values_consistency", _reported("total_missing_values", "missing_sum"),
                ),
                (
                    _differs("total_missing_values", "actual_missing"), "failed",
                    "missing_values_recomputation",
                    _reported("total_missing_values", "actual_missing"),
                ),
            ],
            "missing_values",
        ),
        _check(
            2,
            [
                (
                    _differs("duplicate_base", "actual_rows"), "failed", "duplicate_row_count",
                    _reported("duplicate_base", "actual_rows"),
                ),
                (
                    ~F.col("keys_exist") & (F.col("actual_rows") > 0), "failed",
                    "duplicate_key_columns", F.lit("the table lacks a key column"),
                ),
                (
                    _differs("duplicate_row_count", "actual_duplicates"), "failed",
                    "duplicates_recomputation",
                    _reported("duplicate_row_count", "actual_duplicates"),
                ),
            ],
            "duplicates",
        ),
        _check(
            3,
            [
                (
                    types & _differs("total_invalid_values", "invalid_sum"), "failed",
                    "type_validation_total", _reported("total_invalid_values", "invalid_sum"),
                ),
                (
                    types & _differs("columns_with_invalid_values", "invalid_columns"), "failed",
                    "type_validation_affected_columns",
                    _reported("columns_with_invalid_values", "invalid_columns"),
                ),
            ],
            "type_validation",
        ),
        _check(
            4,
            [
                (
                    rules & _differs("total_violations", "violation_sum"), "failed",
                    "business_rules_total", _reported("total_violations", "violation_sum"),
                ),
                (
                    rules & _differs("rules_with_violations", "violated_rules"), "failed",
                    "business_rules_affected_rules",
                    _reported("rules_with_violations", "violated_rules"),
                ),
            ],
            "business_rules",
        ),
        _check(
            5,
            [
                (
                    queries & (F.col("unsafe_queries") > 0), "failed", "sql_read_only_validation",
                    F.format_string("%s queries are not read-only", "unsafe_queries"),
                ),
                (
                    queries & (F.col("failed_queries") > 0), "warning", "sql_execution",
                    F.format_string("%s queries failed", "failed_queries"),
                ),
            ],
            "sql_analysis",
        ),
        _check(
            6,
            [
                (~score, "warning", "bi_readiness_score", F.lit("no score was computed")),
                (
                    score & _differs("overall_score", "component_sum"), "failed",
                    "bi_readiness_score_total", _reported("overall_score", "component_sum"),
                ),
                (
                    score & (F.col("bad_components") > 0), "failed",
                    "bi_readiness_score_components",
                    F.format_string("%s components are out of range", "bad_components"),
                ),
            ],
            "bi_readiness_score",
        ),
    ]
    return merged.select("dataset", F.inline(F.array(*checks)))


def summarize_verification(checks: DataFrame) -> DataFrame:
    """One row per dataset: overall status, checks run, failed and with warnings."""
    failed = F.count_if(F.col("status") == "failed")
    warned = F.count_if(F.col("status") == "warning")
    return checks.groupBy("dataset").agg(
        F.when(failed > 0, "failed").when(warned > 0, "warning").otherwise("passed").alias("status"),
        F.count(F.lit(1)).alias("checks_run"),
        failed.alias("checks_failed"),
        warned.alias("checks_warning"),
    )
