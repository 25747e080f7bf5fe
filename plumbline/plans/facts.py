"""Totals of all checks, one row per dataset."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Every fact there can be, with its type; a fact of a check that did not run is null.
FACTS = {
    "row_count": "bigint",
    "column_count": "bigint",
    "missing_status": "string",
    "total_missing_values": "bigint",
    "columns_with_missing_values": "bigint",
    "duplicate_status": "string",
    "duplicate_scope": "string",
    "duplicate_row_count": "bigint",
    "duplicate_percentage": "double",
    "type_status": "string",
    "columns_type_checked": "bigint",
    "columns_with_invalid_values": "bigint",
    "total_invalid_values": "bigint",
    "total_checked_values": "bigint",
    "rule_status": "string",
    "rules_checked": "bigint",
    "rules_with_violations": "bigint",
    "total_violations": "bigint",
    "sql_status": "string",
    "queries_executed": "bigint",
    "queries_failed": "bigint",
}


def merge(parts: list[DataFrame], sums: Collection[str] = ()) -> DataFrame:
    """One row per dataset out of several small tables; each column is known to one of them.

    Columns named in ``sums`` are added up over the rows of their table, all others have one value
    per dataset. This is a union and one small aggregation, not a join.
    """
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    columns = [c for c in united.columns if c != "dataset"]
    return united.groupBy("dataset").agg(
        *[
            (F.coalesce(F.sum(c), F.lit(0).cast("long")) if c in sums else F.max(c)).alias(c)
            for c in columns
        ]
    )


def collect_facts(
    counts: DataFrame,
    missing_summary: DataFrame,
    duplicates: DataFrame,
    type_summary: DataFrame | None = None,
    rule_summary: DataFrame | None = None,
    sql_summary: DataFrame | None = None,
) -> DataFrame:
    """``counts`` holds row and column count; the others are the summaries of the checks."""
    parts = [
        counts.select("dataset", "row_count", "column_count"),
        missing_summary.select(
            "dataset",
            F.col("status").alias("missing_status"),
            "total_missing_values",
            "columns_with_missing_values",
        ),
        duplicates.select(
            "dataset",
            F.col("status").alias("duplicate_status"),
            F.col("scope").alias("duplicate_scope"),
            "duplicate_row_count",
            "duplicate_percentage",
        ),
    ]
    if type_summary is not None:
        parts.append(
            type_summary.select(
                "dataset",
                F.col("status").alias("type_status"),
                F.col("columns_checked").alias("columns_type_checked"),
                "columns_with_invalid_values",
                "total_invalid_values",
                "total_checked_values",
            )
        )
    if rule_summary is not None:
        parts.append(
            rule_summary.select(
                "dataset",
                F.col("status").alias("rule_status"),
                "rules_checked",
                "rules_with_violations",
                "total_violations",
            )
        )
    if sql_summary is not None:
        parts.append(
            sql_summary.select(
                "dataset",
                F.col("status").alias("sql_status"),
                "queries_executed",
                "queries_failed",
            )
        )
    merged = merge(parts)
    return merged.select(
        "dataset",
        *[
            (F.col(name) if name in merged.columns else F.lit(None).cast(kind)).alias(name)
            for name, kind in FACTS.items()
        ],
    )
