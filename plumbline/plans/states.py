"""Checks as states that add up.

Missing values, types and rules are counts, so the counts of parts of a table add up to those of the whole.
What the parts are is up to the caller: slices by column values, files, or batches of a stream.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import date
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.missing import plan_missing, summarize_missing
from plumbline.operators.rules import plan_rules, summarize_rules
from plumbline.operators.types import plan_types, summarize_types
from plumbline.plans.config import RunConfig
from plumbline.plans.table import Scan, Table

SUMMARIES = {"missing": summarize_missing, "types": summarize_types, "rules": summarize_rules}


class CheckStates:
    """The mergeable checks of a configuration over one table.

    ``table`` may be empty or a stream: only its schema is looked at until ``of_rows`` is computed.
    """

    def __init__(
        self,
        table: Table,
        config: RunConfig,
        reference_date: date | None = None,
        date_formats: tuple[str, ...] = (),
        warning_threshold: float = 1.0,
        high_threshold: float = 5.0,
        missing_thresholds: tuple[float, float] = (5.0, 20.0),
    ) -> None:
        self.table = table
        self.config = config
        self.reference_date = reference_date or date.today()
        self.date_formats = date_formats
        self.scan = Scan(table, config.dataset_name)
        thresholds = (warning_threshold, high_threshold)
        self.parts = {"missing": plan_missing(self.scan, *missing_thresholds)}
        if config.expected_schema:
            self.parts["types"] = plan_types(
                self.scan, config.expected_schema, *thresholds, date_formats
            )
        if config.business_rules:
            self.parts["rules"] = plan_rules(
                self.scan, config.business_rules, *thresholds, self.reference_date, date_formats
            )

    def fingerprint(self) -> str:
        """Equal only for checks whose states may be added up."""
        said = [
            self.table.names,
            [kind.simpleString() for kind in self.table.kinds],
            asdict(self.config),
            self.reference_date.isoformat(),
            self.date_formats,
        ]
        return sha256(json.dumps(said, default=str).encode()).hexdigest()

    def of_rows(self, *by: Column) -> DataFrame:
        """The states of the table's rows, for each value of the columns given."""
        return self.scan.totals(*by)

    def merged(self, states: DataFrame, *by: str) -> DataFrame:
        """States added up; no states are those of no rows."""
        sums = [F.coalesce(F.sum(label), F.lit(0).cast("long")).alias(label) for label in self.scan.labels]
        return states.groupBy(*by).agg(*sums)

    def results(self, states: DataFrame, *kept: str) -> DataFrame:
        """dataset, row_count, column_count and the rows of each check, for each row of states."""
        return self.scan.results(states, *kept, **self.parts)

    def tables(self, results: DataFrame) -> dict[str, DataFrame]:
        """The result tables of a whole run for one row of results."""
        found = {"counts": results.select("dataset", "row_count", "column_count")}
        for name in self.parts:
            found[name] = results.select("dataset", F.inline(name))
            found[f"{SUMMARY_NAMES[name]}_summary"] = SUMMARIES[name](results)
        return found


SUMMARY_NAMES = {"missing": "missing", "types": "type", "rules": "rule"}
