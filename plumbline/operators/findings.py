"""Observations, run log, advice and the report, as rows derived from facts and result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.parsing import NESTED_TYPES


def _row(position: int, when: Column, **columns: Column) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(position).alias("position"), *[c.alias(name) for name, c in columns.items()]
        ),
    )


def _rows(facts: DataFrame, rows: list[Column]) -> DataFrame:
    return facts.select("dataset", F.inline(F.array_compact(F.array(*rows))))


def observations(facts: DataFrame) -> DataFrame:
    """What stands out, one row per part of the run: info, warning or critical.

    Score and verification are observed where ``facts`` also has ``overall_score`` and ``rating``,
    or ``verification_status``, ``checks_failed`` and ``checks_warning``.
    """
    missing, duplicates = F.col("total_missing_values"), F.col("duplicate_row_count")
    invalid, violations = F.col("total_invalid_values"), F.col("total_violations")
    types_ran = F.col("columns_type_checked").isNotNull()
    rules_ran = F.col("rules_checked").isNotNull()
    always = F.lit(True)
    rows = [
        _row(
            0, always,
            source=F.lit("missing_values"),
            severity=F.when(missing > 0, "warning").otherwise("info"),
            message=F.format_string(
                "%d values missing in %d columns", missing, F.col("columns_with_missing_values")
            ),
        ),
        _row(
            1, always,
            source=F.lit("duplicates"),
            severity=F.when(duplicates == 0, "info")
            .when(F.col("duplicate_status") == "failed", "critical")
            .otherwise("warning"),
            message=F.format_string(
                "%d duplicate rows, compared by %s", duplicates, F.col("duplicate_scope")
            ),
        ),
        _row(
            2, always,
            source=F.lit("type_validation"),
            severity=F.when(types_ran & (invalid == 0), "info").otherwise("warning"),
            message=F.when(
                types_ran,
                F.format_string(
                    "%d values of the wrong type in %d columns",
                    invalid, F.col("columns_with_invalid_values"),
                ),
            ).otherwise("no expected types, not checked"),
        ),
        _row(
            3, always,
            source=F.lit("business_rules"),
            severity=F.when(rules_ran & (violations == 0), "info").otherwise("warning"),
            message=F.when(
                rules_ran,
                F.format_string(
                    "%d violations of %d rules", violations, F.col("rules_with_violations")
                ),
            ).otherwise("no rules, not checked"),
        ),
        _row(
            4, F.col("queries_failed") > 0,
            source=F.lit("sql_analysis"),
            severity=F.lit("warning"),
            message=F.format_string("%d queries failed", F.col("queries_failed")),
        ),
    ]
    if "overall_score" in facts.columns:
        rows.append(
            _row(
                5, F.col("overall_score").isNotNull(),
                source=F.lit("bi_readiness_score"),
                severity=F.when(F.col("rating") == "poor", "critical")
                .when(F.col("rating") == "needs_attention", "warning")
                .otherwise("info"),
                message=F.format_string("%d of 100 points, rated %s", "overall_score", "rating"),
            )
        )
    if "verification_status" in facts.columns:
        rows.append(
            _row(
                6, F.col("verification_status").isNotNull(),
                source=F.lit("result_verification"),
                severity=F.when(F.col("verification_status") == "failed", "critical")
                .when(F.col("verification_status") == "warning", "warning")
                .otherwise("info"),
                message=F.format_string(
                    "%s, %d checks failed, %d with warnings",
                    "verification_status", "checks_failed", "checks_warning",
                ),
            )
        )
    return _rows(facts, rows)


def run_log(facts: DataFrame) -> DataFrame:
    """The steps of a run in order, completed or skipped."""

    def step(position: int, name: str, ran: Column, message: Column) -> Column:
        return _row(
            position,
            F.lit(True),
            step_name=F.lit(name),
            status=F.when(ran, "completed").otherwise("skipped"),
            message=F.when(ran, message).otherwise("not configured"),
        )

    always = F.lit(True)
    steps = [
        step(
            0, "schema_profile", always,
            F.format_string("%d rows, %d columns", "row_count", "column_count"),
        ),
        step(
            1, "missing_values", always,
            F.format_string(
                "%d values missing in %d columns",
                "total_missing_values", "columns_with_missing_values",
            ),
        ),
        step(
            2, "duplicates", always,
            F.format_string(
                "%d duplicate rows, compared by %s", "duplicate_row_count", "duplicate_scope"
            ),
        ),
        step(
            3, "type_validation", F.col("columns_type_checked").isNotNull(),
            F.format_string(
                "%d columns checked, %d invalid values",
                "columns_type_checked", "total_invalid_values",
            ),
        ),
        step(
            4, "business_rules", F.col("rules_checked").isNotNull(),
            F.format_string("%d rules checked, %d violations", "rules_checked", "total_violations"),
        ),
        step(
            5, "sql_analysis", F.col("queries_executed").isNotNull(),
            F.format_string("%d queries run, %d failed", "queries_executed", "queries_failed"),
        ),
    ]
    if "overall_score" in facts.columns:
        steps.append(
            step(
                6, "bi_readiness_score", F.col("overall_score").isNotNull(),
                F.format_string("%d of 100 points, rated %s", "overall_score", "rating"),
            )
        )
    return _rows(facts, steps)


def report_recommendations(facts: DataFrame) -> DataFrame:
    """One piece of advice per check that found anything, else a single all-clear."""
    found = [
        ("missing_values", "total_missing_values", "review the columns with missing values"),
        ("duplicates", "duplicate_row_count", "look into the duplicate rows"),
        ("type_validation", "total_invalid_values", "repair values of the wrong type"),
        ("business_rules", "total_violations", "discuss the rule violations with the data owners"),
    ]
    advice = F.array_compact(
        F.array(
            *[
                _row(
                    position, F.col(count) > 0,
                    check_name=F.lit(check), recommendation=F.lit(text),
                )
                for position, (check, count, text) in enumerate(found)
            ]
        )
    )
    clear = F.array(
        F.struct(
            F.lit(0).alias("position"),
            F.lit("all").alias("check_name"),
            F.lit("no issue was found").alias("recommendation"),
        )
    )
    return facts.withColumn("advice", advice).select(
        "dataset", F.inline(F.when(F.size("advice") > 0, F.col("advice")).otherwise(clear))
    )


def as_report(table: DataFrame, section: str, item: list[str]) -> DataFrame:
    """A result table in long form: ``(dataset, section, item, metric, value)``.

    ``item`` names the columns that identify a row; all others become metrics.
    """
    kinds = {f.name: f.dataType for f in table.schema.fields}

    def text(name: str) -> Column:
        if isinstance(kinds[name], T.MapType):
            return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(name))))
        return F.to_json(name) if isinstance(kinds[name], NESTED_TYPES) else F.col(name).cast("string")

    metrics = [n for n in kinds if n not in ("dataset", "position", *item)]
    return table.select(
        "dataset",
        F.lit(section).alias("section"),
        (F.concat_ws("/", *[text(n) for n in item]) if item else F.lit("")).alias("item"),
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("metric"), text(n).alias("value")) for n in metrics])
        ),
    )


def report_rows(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """All sections of the report in one long table."""
    return reduce(
        DataFrame.unionByName,
        [as_report(table, section, item) for section, (table, item) in tables.items()],
    )
