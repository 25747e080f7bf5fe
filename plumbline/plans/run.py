"""A whole run: every configured check in a handful of jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date
from functools import partial

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.grading import check_limit, check_thresholds
from plumbline.functions.parsing import TIME_TYPES, is_checkable
from plumbline.operators import findings
from plumbline.operators.distinct import free_text
from plumbline.operators.distributions import MOST_SHOWN, can_share_pass
from plumbline.operators.duplicates import DuplicateGroups
from plumbline.operators.missing import plan_missing, summarize_missing
from plumbline.operators.profile import plan_profile, sample_values
from plumbline.operators.examples import first_offenders
from plumbline.operators.rules import (
    RULE_EXAMPLE_ROW,
    label_rule_examples,
    plan_rules,
    rule_offences,
    summarize_rules,
    table_offenders,
    table_violations,
)
from plumbline.operators.scoring import score_components, score_recommendations, score_totals
from plumbline.operators.sqlcheck import (
    SqlResult,
    answer_distribution,
    answer_distributions,
    check_read_only,
    plan_date_range,
    plan_numeric_summary,
    run_queries,
    sql_result_rows,
    sql_results,
    summarize_sql,
)
from plumbline.operators.suggest import (
    describe_table,
    described_samples,
    is_generated,
    suggest_config,
    suggestion_notes,
)
from plumbline.operators.types import (
    TYPE_EXAMPLE_ROW,
    judged_columns,
    label_type_examples,
    plan_types,
    summarize_types,
    type_offences,
)
from plumbline.operators.verification import summarize_verification, verify
from plumbline.plans.config import RunConfig, SqlQuery
from plumbline.plans.facts import collect_facts, merge
from plumbline.plans.storage import settle, side_by_side
from plumbline.plans.table import Scan, Table


@dataclass(frozen=True)
class RunResult:
    """The tables a run yields. Those of a check that did not run are ``None``."""

    config: RunConfig
    counts: DataFrame
    profile: DataFrame
    samples: DataFrame
    missing: DataFrame
    missing_summary: DataFrame
    duplicates: DataFrame
    duplicate_groups: DataFrame
    facts: DataFrame
    types: DataFrame | None = None
    type_summary: DataFrame | None = None
    type_examples: DataFrame | None = None
    rules: DataFrame | None = None
    rule_summary: DataFrame | None = None
    rule_examples: DataFrame | None = None
    sql_results: DataFrame | None = None
    sql_rows: DataFrame | None = None
    sql_summary: DataFrame | None = None
    score_components: DataFrame | None = None
    score: DataFrame | None = None
    score_recommendations: DataFrame | None = None
    verification: DataFrame | None = None
    verification_summary: DataFrame | None = None
    observations: DataFrame | None = None
    log: DataFrame | None = None
    report_recommendations: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        """Every table the run has, by name."""
        found = {name: getattr(self, name) for name in self.__dataclass_fields__ if name != "config"}
        return {name: table for name, table in found.items() if table is not None}

    def report(self) -> DataFrame:
        """The report as one long table of sections, items, metrics and values."""
        identity = {
            "counts": ("overview", []),
            "profile": ("schema", ["column_name"]),
            "samples": ("sample_values", ["column_name", "sample_rank"]),
            "missing_summary": ("missing_values", []),
            "missing": ("missing_by_column", ["column_name"]),
            "duplicates": ("duplicates", []),
            "duplicate_groups": ("duplicate_examples", ["group_rank"]),
            "type_summary": ("type_validation", []),
            "types": ("type_by_column", ["column_name"]),
            "type_examples": ("type_examples", ["column_name", "example_rank"]),
            "rule_summary": ("business_rules", []),
            "rules": ("rule_by_rule", ["rule_name"]),
            "rule_examples": ("rule_examples", ["rule_name", "example_rank"]),
            "sql_summary": ("sql_analysis", []),
            "sql_results": ("sql_queries", ["query_name"]),
            "sql_rows": ("sql_rows", ["query_name", "row_number"]),
            "score": ("bi_readiness_score", []),
            "score_components": ("score_components", ["component_name"]),
            "verification_summary": ("verification", []),
            "verification": ("verification_checks", ["check_name"]),
            "log": ("run_log", ["step_name"]),
            "report_recommendations": ("recommendations", ["check_name"]),
        }
        tables = self.tables()
        return findings.report_rows(
            {
                section: (tables[name], item)
                for name, (section, item) in identity.items()
                if name in tables
            }
        )


def run_checks(
    df: DataFrame,
    config: RunConfig | None = None,
    row_id: Sequence[str] | None = None,
    reference_date: date | None = None,
    max_examples: int = 10,
    max_groups: int = 10,
    max_rows: int = 50,
    date_formats: tuple[str, ...] = (),
    warning_threshold: float = 1.0,
    high_threshold: float = 5.0,
    missing_thresholds: tuple[float, float] = (5.0, 20.0),
    max_query_seconds: float | None = None,
    max_samples: int = 5,
    samples: DataFrame | None = None,
) -> RunResult:
    """Run every configured check.

    One pass answers profile, missing values, types, rules and the suggested ranges; duplicates,
    examples and every other query take one job each. Their results are small and are kept, so
    score, log and report only read those. ``row_id`` names the columns by which examples are
    ordered and labelled, by default the duplicate key. ``date_formats`` are read besides ISO dates,
    ``max_rows`` bounds the rows kept of a query's result. The thresholds are percentages from which
    duplicates, invalid values and violations are a warning or high, and those of missing values.
    A query whose tasks run for more than ``max_query_seconds`` is cancelled and failed. Sample values
    take a pass of their own, unless ``samples`` has their rows already or ``max_samples`` is 0.
    """
    config = config or RunConfig()
    check_limit("max_examples", max_examples)
    check_limit("max_groups", max_groups)
    check_limit("max_rows", max_rows)
    check_limit("max_samples", max_samples)
    check_thresholds(warning_threshold, high_threshold)
    thresholds = (warning_threshold, high_threshold)
    reference_date = reference_date or date.today()
    row_id = list(config.duplicate_key_columns or ()) if row_id is None else list(row_id)
    dataset = config.dataset_name
    table = Table.of(df)

    # A wrong configuration is noticed before any job runs.
    table.require(config.duplicate_key_columns or (), "duplicate key")
    table.require(row_id, "row id")
    scan = Scan(table, dataset)
    parts = {"profile": plan_profile(scan), "missing": plan_missing(scan, *missing_thresholds)}
    if config.expected_schema:
        parts["types"] = plan_types(scan, config.expected_schema, *thresholds, date_formats)
    if config.business_rules:
        parts["rules"] = plan_rules(
            scan, config.business_rules, *thresholds, reference_date, date_formats,
            table_violations(table, config.business_rules),
        )
    numbers, days = _ranges_in_scan(table, config.sql_queries)
    parts["numbers"] = plan_numeric_summary(scan, numbers)
    parts["days"] = plan_date_range(scan, days)

    def group_keys() -> DuplicateGroups:
        groups = DuplicateGroups(df, config.duplicate_key_columns, dataset)
        groups.keep()
        return groups

    one_row, groups, sampled = side_by_side(
        df.sparkSession,
        [
            lambda: settle(scan.row(**parts)),
            group_keys,
            lambda: settle(sample_values(df, dataset, max_samples)) if samples is None else samples,
        ],
    )
    counted = one_row.withColumns({part: _as_texts(one_row, part) for part in ("numbers", "days")}).first()

    def describe_duplicates() -> DataFrame:
        try:
            return settle(
                groups.summary(*thresholds, counted["row_count"]).unionByName(
                    groups.largest(max_groups), allowMissingColumns=True
                )
            )
        finally:
            groups.release()

    duplicates, (type_samples, rule_samples), results = side_by_side(
        df.sparkSession,
        [
            describe_duplicates,
            partial(
                _find_examples, table, config, counted, row_id, reference_date, max_examples,
                date_formats,
            ),
            partial(_answer_queries, df, config.sql_queries, counted, max_rows, max_query_seconds),
        ],
    )

    counts = one_row.select("dataset", "row_count", "column_count")
    tables = {
        "counts": counts,
        "profile": one_row.select("dataset", F.inline("profile")),
        "samples": sampled,
        "missing": one_row.select("dataset", F.inline("missing")),
        "missing_summary": summarize_missing(one_row),
        "duplicates": duplicates.filter("scope IS NOT NULL").drop(
            "group_rank", "duplicate_key", "duplicate_count"
        ),
        "duplicate_groups": duplicates.filter("group_rank IS NOT NULL").select(
            "dataset", "group_rank", "duplicate_key", "duplicate_count"
        ),
    }
    if config.expected_schema:
        tables["types"] = one_row.select("dataset", F.inline("types"))
        tables["type_summary"] = summarize_types(one_row)
        tables["type_examples"] = type_samples
    if config.business_rules:
        tables["rules"] = one_row.select("dataset", F.inline("rules"))
        tables["rule_summary"] = summarize_rules(one_row)
        tables["rule_examples"] = rule_samples
    if config.sql_queries:
        tables["sql_results"] = sql_results(df.sparkSession, results, dataset)
        tables["sql_rows"] = sql_result_rows(df.sparkSession, results, dataset)
        tables["sql_summary"] = summarize_sql(tables["sql_results"])

    facts = settle(
        collect_facts(
            counts,
            tables["missing_summary"],
            tables["duplicates"],
            tables.get("type_summary"),
            tables.get("rule_summary"),
            tables.get("sql_summary"),
        )
    )
    components = score_components(facts)
    score = score_totals(components)
    scored = merge([facts, score.select("dataset", "overall_score", "rating")])
    return RunResult(
        config=config,
        facts=facts,
        score_components=components,
        score=score,
        score_recommendations=score_recommendations(components),
        observations=findings.observations(scored),
        log=findings.run_log(scored),
        report_recommendations=findings.report_recommendations(facts),
        **tables,
    )


def verify_run(df: DataFrame, result: RunResult) -> RunResult:
    """The result with its verification, and with that among the observations."""
    checks = settle(verify(df, result))
    summary = summarize_verification(checks)
    scored = merge(
        [
            result.facts,
            result.score.select("dataset", "overall_score", "rating"),
            summary.select(
                "dataset",
                F.col("status").alias("verification_status"),
                "checks_failed",
                "checks_warning",
            ),
        ]
    )
    return replace(
        result,
        verification=checks,
        verification_summary=summary,
        observations=findings.observations(scored),
    )


@dataclass(frozen=True)
class AutoRun:
    """A run whose checks were suggested from the table itself."""

    columns: DataFrame
    config: RunConfig
    notes: list[str]
    result: RunResult


def auto_run(
    df: DataFrame,
    dataset_name: str = "dataset",
    row_id: Sequence[str] | None = None,
    reference_date: date | None = None,
    max_categorical_queries: int | None = 3,
    max_numeric_queries: int | None = 3,
    max_date_queries: int | None = 2,
    max_distinct: int | None = None,
    **options,
) -> AutoRun:
    """Describe the table, take all suggested checks, run and verify them.

    The numbers of suggested queries are those of ``suggest_queries``, None for all columns;
    ``options`` are those of ``run_checks``. With ``max_distinct``, columns of more different values, by an
    estimate that takes a pass of its own, get no distribution, and others take their place.
    """
    columns = settle(describe_table(df, dataset_name))
    numbers = (max_numeric_queries, max_date_queries)
    if max_distinct is None:
        config = suggest_config(columns, dataset_name, max_categorical_queries, *numbers)
    else:
        config = suggest_config(columns, dataset_name, None, *numbers)
        config = _without_distributions(
            config, set(free_text(df, max_distinct)), max_categorical_queries
        )
    if "max_samples" not in options:
        options = {"samples": described_samples(columns)} | options
    result = run_checks(df, config, row_id=row_id, reference_date=reference_date, **options)
    return AutoRun(columns, config, suggestion_notes(config), verify_run(df, result))


def _without_distributions(config: RunConfig, columns: set[str], most: int | None) -> RunConfig:
    """The configuration without the distributions of the columns, and with ``most`` at most."""
    kept, shown = [], 0
    for query in config.sql_queries:
        if query.kind == "distribution":
            if query.column_name in columns or (most is not None and shown >= most):
                continue
            shown += 1
        kept.append(query)
    return replace(config, sql_queries=tuple(kept))


def _ranges_in_scan(table: Table, queries: Sequence[SqlQuery]) -> tuple[list[str], list[str]]:
    """Columns whose suggested summaries the shared pass can answer."""
    numbers, days = [], []
    for query in queries:
        if query.column_name not in table.names:
            continue
        kind = table.kind(query.column_name)
        if not is_generated(query, kind):
            continue
        if query.kind == "numeric_summary" and (
            isinstance(kind, (T.StringType, T.NumericType, T.BooleanType)) and is_checkable(kind)
        ):
            numbers.append(query.column_name)
        if query.kind == "date_range" and isinstance(kind, (T.StringType, *TIME_TYPES)):
            days.append(query.column_name)
    return numbers, days


def _find_examples(
    table: Table,
    config: RunConfig,
    counted: Row,
    row_id: Sequence[str],
    reference_date: date,
    max_examples: int,
    date_formats: tuple[str, ...],
) -> tuple[DataFrame, DataFrame]:
    """Examples of invalid values and of rule violations, in one pass over the table.

    The counts are known by now, so items without any offence are left out, and nothing is read
    where there is none at all.
    """
    spark, dataset = table.frame.sparkSession, config.dataset_name
    invalid = {r.column_name: r.invalid_count for r in counted["types"]} if config.expected_schema else {}
    violations = [r.violation_count for r in counted["rules"]] if config.business_rules else []
    schema = {
        name: expected
        for name, expected in judged_columns(config.expected_schema or {}).items()
        if invalid[name]
    }
    rules = [
        rule for rule, count in zip(config.business_rules, violations, strict=True) if count
    ]
    scan = Scan(table, dataset)
    offences = type_offences(scan, schema, date_formats) + rule_offences(
        scan, rules, reference_date, date_formats
    )
    if not offences or max_examples == 0:
        return (
            spark.createDataFrame([], TYPE_EXAMPLE_ROW),
            spark.createDataFrame([], RULE_EXAMPLE_ROW),
        )
    found = first_offenders(scan, offences, row_id, max_examples)
    of_tables = table_offenders(table, rules, row_id, max_examples)
    if of_tables is not None:
        found = found.unionByName(of_tables.withColumn("item", F.col("item") + len(schema)))
    found = settle(found)
    of_types = found.filter(F.col("item") < len(schema))
    of_rules = found.filter(F.col("item") >= len(schema))
    of_rules = of_rules.withColumn("item", F.col("item") - len(schema))
    return (
        label_type_examples(of_types, schema, dataset),
        label_rule_examples(of_rules, rules, dataset),
    )


def is_groupable(kind: T.DataType | None) -> bool:
    """Whether values of the type are ordered, as the rows of a distribution are."""
    return kind is not None and is_checkable(kind)


def _as_texts(one_row: DataFrame, part: str) -> Column:
    """The summaries of the shared pass with all values as the text Spark prints."""
    names = one_row.schema[part].dataType.elementType.names
    return F.transform(
        part, lambda row: F.struct(*[row[name].cast("string").alias(name) for name in names])
    )


def _answer_queries(
    df: DataFrame,
    queries: Sequence[SqlQuery],
    counted: Row,
    max_rows: int,
    max_seconds: float | None,
) -> list[SqlResult]:
    """Results in the order of the queries; the shared pass answers those it generated itself."""
    answers = {("total_rows", None): {"row_count": str(counted["row_count"])}}
    kinds = dict(zip(df.columns, [field.dataType for field in df.schema.fields], strict=True))
    for kind, rows in (("numeric_summary", counted["numbers"]), ("date_range", counted["days"])):
        for row in rows:
            values = row.asDict()
            answers[kind, values.pop("column_name")] = values

    def known(query: SqlQuery) -> SqlResult | None:
        if (query.kind, query.column_name) not in answers or not max_rows:
            return None
        if not is_generated(query, kinds.get(query.column_name)):
            return None
        values = answers[query.kind, query.column_name]
        try:
            check_read_only(query.sql)
        except ValueError as error:
            return SqlResult(query.query_name, query.sql, "failed", error_message=str(error))
        shown = {n: "" if v is None else v for n, v in values.items()}
        return SqlResult(query.query_name, query.sql, "passed", 1, list(values), [shown])

    found = {i: answer for i, query in enumerate(queries) if (answer := known(query)) is not None}
    spread = [
        i for i, query in enumerate(queries)
        if query.kind == "distribution"
        and is_groupable(kinds.get(query.column_name))
        and is_generated(query, kinds[query.column_name])
    ]
    # A limit is for each query, so with one they are not answered together.
    together = [
        i for i in spread
        if max_seconds is None and max_rows <= MOST_SHOWN and can_share_pass(kinds[queries[i].column_name])
    ]
    alone = [i for i in spread if i not in together]
    others = [i for i in range(len(queries)) if i not in found and i not in spread]
    jobs = [partial(answer_distribution, df, queries[i], max_rows, max_seconds) for i in alone]
    shared, rest = [queries[i] for i in together], [queries[i] for i in others]
    if shared:
        jobs.append(partial(answer_distributions, df, shared, max_rows))
    jobs.append(lambda: run_queries(df, rest, max_rows=max_rows, max_seconds=max_seconds))
    *distributions, answers = side_by_side(df.sparkSession, jobs)
    if shared:
        found |= dict(zip(together, distributions.pop(), strict=True))
    found |= dict(zip(alone, distributions, strict=True)) | dict(zip(others, answers, strict=True))
    return [found[i] for i in range(len(queries))]
