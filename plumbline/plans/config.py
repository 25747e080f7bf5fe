"""What a run should check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# The logical types and rule kinds there are.
EXPECTED_TYPES = ("integer", "float", "numeric", "date", "string", "boolean")
RULE_TYPES = (
    "not_null",
    "range",
    "positive",
    "non_negative",
    "allowed_values",
    "not_future_date",
)


@dataclass(frozen=True)
class Rule:
    """A condition every row should meet in one column.

    ``allowed_table`` may stand for ``allowed_values``: a table, the first column of which has the values.
    Such a rule is for ``check_rules``, ``rule_summary``, ``rule_examples`` and whole runs.
    """

    rule_name: str
    column_name: str
    rule_type: str
    min_value: float | None = None
    max_value: float | None = None
    allowed_values: Sequence[str] | None = None
    allow_null: bool = True
    description: str | None = None
    allowed_table: DataFrame | None = field(default=None, compare=False, repr=False)


@dataclass(frozen=True)
class SqlQuery:
    """A SELECT over the table named ``dataset``.

    Suggested queries also say what they compute (``kind``) and over which column, so that a run
    can answer them from the pass it makes anyway.
    """

    query_name: str
    sql: str
    description: str | None = None
    kind: str | None = None
    column_name: str | None = None


@dataclass(frozen=True)
class RunConfig:
    """An empty key means whole rows; an empty schema, rule list or query list skips that check."""

    dataset_name: str = "dataset"
    duplicate_key_columns: Sequence[str] | None = None
    expected_schema: Mapping[str, str] | None = None
    business_rules: Sequence[Rule] = field(default_factory=tuple)
    sql_queries: Sequence[SqlQuery] = field(default_factory=tuple)
