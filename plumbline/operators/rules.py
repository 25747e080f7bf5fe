"""Business rules: conditions every row should meet."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from datetime import date
from decimal import Decimal
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.grading import (
    check_limit,
    check_status,
    check_thresholds,
    graded,
)
from plumbline.functions.parsing import is_checkable
from plumbline.functions.text import is_one_of, shown, strip
from plumbline.operators.examples import first_offenders, pick
from plumbline.plans.config import RULE_TYPES, Rule
from plumbline.plans.storage import side_by_side
from plumbline.plans.table import Scan, Table, rows_of

RULE_ROW = (
    "position int, rule_name string, column_name string, rule_type string, status string, "
    "row_count bigint, violation_count bigint"
)
RULE_EXAMPLE_ROW = (
    "dataset string, rule_name string, column_name string, example_rank int, row_label string, "
    "value string, message string"
)


def check_rule_definitions(table: Table, rules: Sequence[Rule]) -> None:
    table.require([rule.column_name for rule in rules], "business rules")
    for rule in rules:
        if rule.rule_type not in RULE_TYPES:
            raise ValueError(f"rule {rule.rule_name!r}: unsupported kind {rule.rule_type!r}")
        if rule.rule_type == "range" and rule.min_value is None and rule.max_value is None:
            raise ValueError(f"rule {rule.rule_name!r}: a range needs a lower or an upper bound")
        if rule.allowed_table is not None and (rule.rule_type != "allowed_values" or rule.allowed_values):
            raise ValueError(f"rule {rule.rule_name!r}: a table is for allowed values alone")
        if rule.rule_type == "allowed_values" and not rule.allowed_values and rule.allowed_table is None:
            raise ValueError(f"rule {rule.rule_name!r}: no allowed values given")
        kind = table.kind(rule.column_name)
        if rule.rule_type != "not_null" and not is_checkable(kind):
            raise ValueError(
                f"rule {rule.rule_name!r}: a column of type {kind.simpleString()} "
                f"cannot be checked for {rule.rule_type}"
            )


def violates(
    scan: Scan, rule: Rule, reference_date: date, date_formats: tuple[str, ...] = ()
) -> Column:
    """Whether a row breaks the rule; null breaks it only where the rule says so."""
    value = scan.table.column(rule.column_name)
    if rule.rule_type == "not_null":
        return value.isNull()
    bad = value.isNotNull() & _violates_present(scan, rule, reference_date, date_formats)
    return bad if rule.allow_null else value.isNull() | bad


def _violates_present(
    scan: Scan, rule: Rule, reference_date: date, date_formats: tuple[str, ...]
) -> Column:
    if rule.rule_type == "allowed_values":
        text = scan.table.column(rule.column_name).cast("string")
        return ~is_one_of(text, [str(allowed).strip() for allowed in rule.allowed_values])
    if rule.rule_type == "not_future_date":
        day = F.to_date(scan.timestamp(rule.column_name, date_formats))
        return _fails(day > F.lit(reference_date))
    number = scan.number(rule.column_name)
    if rule.rule_type == "positive":
        return _fails(number <= 0)
    if rule.rule_type == "non_negative":
        return _fails(number < 0)
    bounds = []
    if rule.min_value is not None:
        bounds.append(number < float(rule.min_value))
    if rule.max_value is not None:
        bounds.append(number > float(rule.max_value))
    return _fails(reduce(Column.__or__, bounds))


def _fails(condition: Column) -> Column:
    """The condition, or true where it is null because the value could not be read."""
    return F.coalesce(condition, F.lit(True))


def _exact(bound: float) -> str:
    """All digits that tell the number from others, without an empty fraction."""
    text = format(Decimal(repr(float(bound))), "f") if math.isfinite(bound) else repr(float(bound))
    return text.rstrip("0").rstrip(".") if "." in text else text


def violation_message(rule: Rule) -> str:
    if rule.rule_type == "range":
        if rule.max_value is None:
            return f"expected at least {_exact(rule.min_value)}"
        if rule.min_value is None:
            return f"expected at most {_exact(rule.max_value)}"
        return f"expected a number from {_exact(rule.min_value)} to {_exact(rule.max_value)}"
    return {
        "not_null": "expected a value",
        "positive": "expected a number above zero",
        "non_negative": "expected zero or a number above",
        "allowed_values": "expected one of the allowed values",
        "not_future_date": "expected a date up to the reference date",
    }[rule.rule_type]


def plan_rules(
    scan: Scan,
    rules: Sequence[Rule],
    warning_threshold: float = 1.0,
    high_threshold: float = 5.0,
    reference_date: date | None = None,
    date_formats: tuple[str, ...] = (),
    of_tables: Mapping[int, int] | None = None,
) -> Column:
    """``of_tables`` has the violations of rules whose values are tables, by position; one pass over the
    rows can't count those.
    """
    check_thresholds(warning_threshold, high_threshold)
    check_rule_definitions(scan.table, rules)
    reference_date = reference_date or date.today()
    rows = []
    for position, rule in enumerate(rules):
        if rule.allowed_table is None:
            violations = scan.total(
                f"violations_{position}",
                F.count_if(violates(scan, rule, reference_date, date_formats)),
            )
        elif of_tables is None:
            raise ValueError(f"rule {rule.rule_name!r}: a table of values can't be checked here")
        else:
            violations = F.lit(of_tables[position]).cast("long")
        rows.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(rule.rule_name).alias("rule_name"),
                F.lit(rule.column_name).alias("column_name"),
                F.lit(rule.rule_type).alias("rule_type"),
                F.when(violations == 0, "passed").otherwise("failed").alias("status"),
                scan.row_count.alias("row_count"),
                violations.alias("violation_count"),
            )
        )
    return graded(
        rows_of(rows, RULE_ROW),
        "violation_count", "row_count", "violation_percentage", warning_threshold, high_threshold,
    )


def summarize_rules(result: DataFrame) -> DataFrame:
    total = F.aggregate("rules", F.lit(0).cast("long"), lambda n, row: n + row["violation_count"])
    affected = F.size(F.filter("rules", lambda row: row["violation_count"] > 0))
    any_high = F.exists("rules", lambda row: row["severity"] == "high")
    return result.select(
        "dataset",
        check_status(total, any_high).alias("status"),
        F.size("rules").cast("long").alias("rules_checked"),
        affected.cast("long").alias("rules_with_violations"),
        total.alias("total_violations"),
    )


def _rules(df, rules, dataset, warning_threshold, high_threshold, reference_date, date_formats):
    scan = Scan(Table.of(df), dataset)
    return scan.row(
        rules=plan_rules(
            scan, rules, warning_threshold, high_threshold, reference_date, date_formats,
            table_violations(scan.table, rules),
        )
    )


def check_rules(
    df: DataFrame,
    rules: Sequence[Rule],
    dataset: str = "dataset",
    warning_threshold: float = 1.0,
    high_threshold: float = 5.0,
    reference_date: date | None = None,
    date_formats: tuple[str, ...] = (),
) -> DataFrame:
    """One row per rule: violations, percentage of all rows, severity and status."""
    result = _rules(
        df, rules, dataset, warning_threshold, high_threshold, reference_date, date_formats
    )
    return result.select("dataset", F.inline("rules"))


def _looked_up(table: Table, rule: Rule) -> DataFrame:
    """Distinct values of the rule's column with their rows ``n``, and whether they break the rule.

    Each value is looked up once, so a value in many rows costs one row per task.
    """
    counted = table.frame.groupBy(_compared(table, rule).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # By position, as names may need quoting.
    allowed = rule.allowed_table.toDF(*[f"a{i}" for i in range(len(rule.allowed_table.columns))])
    known = allowed.select(strip(F.col("a0").cast("string")).alias("value"))
    known = known.filter("value IS NOT NULL").distinct().withColumn("known", F.lit(True))
    bad = F.coalesce(~F.col("known"), F.lit(True))
    if rule.allow_null:
        bad = bad & F.col("value").isNotNull()
    return counted.join(known, "value", "left").withColumn("bad", bad)


def _compared(table: Table, rule: Rule) -> Column:
    return strip(table.column(rule.column_name).cast("string"))


def table_violations(table: Table, rules: Sequence[Rule]) -> dict[int, int]:
    """Violations of the rules whose values are tables, by position; a job each, side by side."""
    check_rule_definitions(table, rules)
    chosen = {i: rule for i, rule in enumerate(rules) if rule.allowed_table is not None}

    def count(rule: Rule) -> int:
        return _looked_up(table, rule).agg(F.sum(F.when(F.col("bad"), F.col("n")))).first()[0] or 0

    jobs = [partial(count, rule) for rule in chosen.values()]
    return dict(zip(chosen, side_by_side(table.frame.sparkSession, jobs), strict=True))


def table_offenders(
    table: Table, rules: Sequence[Rule], row_id: Sequence[str], max_examples: int
) -> DataFrame | None:
    """Rows like those of ``first_offenders`` for rules whose values are tables, None if there are none.

    Only ids and values of rows whose value breaks the rule are looked at. ``item`` is the position.
    """
    found = []
    for item, rule in enumerate(rules):
        if rule.allowed_table is None:
            continue
        bad = _looked_up(table, rule).filter("bad").select("value").withColumnRenamed("value", "b")
        ids = [table.column(name).alias(f"c{i}") for i, name in enumerate(row_id)]
        last = len(row_id)
        rows = table.frame.select(
            *ids, table.column(rule.column_name).cast("string").alias(f"c{last}"),
            _compared(table, rule).alias("value"),
        )
        rows = rows.join(bad, rows["value"].eqNullSafe(bad["b"]), "left_semi").drop("value")
        names = [f"c{i}" for i in range(last + 1)]
        kinds = tuple(field.dataType for field in rows.schema.fields)
        scan = Scan(Table(rows.select(*names), tuple(names), kinds))
        offence = (F.lit(True), shown(F.col(f"c{last}")))
        examples = first_offenders(scan, [offence], names[:last], max_examples)
        found.append(examples.withColumn("item", F.lit(item)))
    return reduce(DataFrame.unionByName, found) if found else None


def check_allowed_table(
    df: DataFrame,
    column_name: str,
    allowed: DataFrame,
    allow_null: bool = True,
    rule_name: str | None = None,
    dataset: str = "dataset",
    warning_threshold: float = 1.0,
    high_threshold: float = 5.0,
) -> DataFrame:
    """The row of ``check_rules`` for a column whose allowed values are the first column of a table.

    For lists too long to be written into a rule. Values are compared as text without surrounding
    whitespace.
    """
    name = rule_name or f"{column_name}_allowed"
    rule = Rule(name, column_name, "allowed_values", allow_null=allow_null, allowed_table=allowed)
    return check_rules(df, [rule], dataset, warning_threshold, high_threshold)


def rule_summary(
    df: DataFrame,
    rules: Sequence[Rule],
    dataset: str = "dataset",
    warning_threshold: float = 1.0,
    high_threshold: float = 5.0,
    reference_date: date | None = None,
    date_formats: tuple[str, ...] = (),
) -> DataFrame:
    """One row: status, rules checked and broken, total of violations."""
    return summarize_rules(
        _rules(df, rules, dataset, warning_threshold, high_threshold, reference_date, date_formats)
    )


def rule_examples(
    df: DataFrame,
    rules: Sequence[Rule],
    row_id: Sequence[str] = (),
    dataset: str = "dataset",
    max_examples: int = 10,
    reference_date: date | None = None,
    date_formats: tuple[str, ...] = (),
) -> DataFrame:
    """The first violations of every rule, with the row they come from."""
    check_limit("max_examples", max_examples)
    table = Table.of(df)
    check_rule_definitions(table, rules)
    if not rules or max_examples == 0:
        return df.sparkSession.createDataFrame([], RULE_EXAMPLE_ROW)
    scan = Scan(table, dataset)
    offences = rule_offences(scan, rules, reference_date or date.today(), date_formats)
    found = first_offenders(scan, offences, row_id, max_examples)
    of_tables = table_offenders(table, rules, row_id, max_examples)
    if of_tables is not None:
        found = found.unionByName(of_tables)
    return label_rule_examples(found, rules, dataset)


def rule_offences(
    scan: Scan, rules: Sequence[Rule], reference_date: date, date_formats: tuple[str, ...] = ()
) -> list[tuple[Column, Column]]:
    """A rule whose values are a table has no offences in this pass; ``table_offenders`` finds them."""
    return [
        (
            F.lit(False)
            if rule.allowed_table is not None
            else violates(scan, rule, reference_date, date_formats),
            shown(scan.table.column(rule.column_name).cast("string")),
        )
        for rule in rules
    ]


def label_rule_examples(found: DataFrame, rules: Sequence[Rule], dataset: str) -> DataFrame:
    return found.select(
        F.lit(dataset).alias("dataset"),
        pick([rule.rule_name for rule in rules]).alias("rule_name"),
        pick([rule.column_name for rule in rules]).alias("column_name"),
        "example_rank",
        "row_label",
        "value",
        pick([violation_message(rule) for rule in rules]).alias("message"),
    )
