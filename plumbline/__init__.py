"""Data-quality checks for Spark DataFrames."""

from plumbline.operators.asof import asof_join
from plumbline.operators.distinct import distinct_counts, distinct_states, merge_distinct
from plumbline.operators.distributions import value_distributions
from plumbline.operators.duplicates import (
    check_duplicates,
    duplicate_rows,
    largest_duplicate_groups,
)
from plumbline.operators.jsonpaths import json_paths
from plumbline.operators.missing import check_missing, missing_summary
from plumbline.operators.profile import preview, profile_columns, sample_values
from plumbline.operators.quantiles import (
    merge_quantiles,
    numeric_quantiles,
    quantile_drift,
    quantile_states,
)
from plumbline.operators.rules import (
    check_allowed_table,
    check_rules,
    rule_examples,
    rule_summary,
)
from plumbline.operators.scoring import score_components, score_recommendations, score_totals
from plumbline.operators.slices import (
    SlicedResult,
    check_slices,
    missing_by_slice,
    rules_by_slice,
    types_by_slice,
)
from plumbline.operators.sqlcheck import check_read_only, run_queries, sql_session
from plumbline.operators.suggest import (
    describe_table,
    describe_tables,
    suggest_config,
    suggest_configs,
    suggest_keys,
    suggest_queries,
    suggest_rules,
    suggest_types,
)
from plumbline.operators.types import check_types, type_examples, type_summary
from plumbline.operators.verification import summarize_verification, verify
from plumbline.plans.config import Rule, RunConfig, SqlQuery
from plumbline.plans.incremental import CheckStore, IncrementalResult, incremental_run
from plumbline.plans.run import AutoRun, RunResult, auto_run, run_checks, verify_run
from plumbline.sources.csv import read_csv
from plumbline.sources.sink import read_result, write_result
from plumbline.streaming.checks import StreamChecks, check_stream

__all__ = [
    "AutoRun",
    "CheckStore",
    "IncrementalResult",
    "Rule",
    "RunConfig",
    "RunResult",
    "SlicedResult",
    "SqlQuery",
    "StreamChecks",
    "asof_join",
    "auto_run",
    "check_allowed_table",
    "check_duplicates",
    "check_missing",
    "check_read_only",
    "check_rules",
    "check_slices",
    "check_stream",
    "check_types",
    "describe_table",
    "describe_tables",
    "distinct_counts",
    "distinct_states",
    "duplicate_rows",
    "incremental_run",
    "json_paths",
    "largest_duplicate_groups",
    "merge_distinct",
    "merge_quantiles",
    "missing_by_slice",
    "missing_summary",
    "numeric_quantiles",
    "preview",
    "profile_columns",
    "quantile_drift",
    "quantile_states",
    "read_csv",
    "read_result",
    "rule_examples",
    "rule_summary",
    "rules_by_slice",
    "run_checks",
    "run_queries",
    "sample_values",
    "score_components",
    "score_recommendations",
    "score_totals",
    "sql_session",
    "suggest_config",
    "suggest_configs",
    "suggest_keys",
    "suggest_queries",
    "suggest_rules",
    "suggest_types",
    "summarize_verification",
    "type_examples",
    "type_summary",
    "types_by_slice",
    "value_distributions",
    "verify",
    "verify_run",
    "write_result",
]
