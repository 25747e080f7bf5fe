"""Checks of every slice of a table, and of the whole, in one pass.

A slice is the rows that agree in some columns. Counts are aggregated by slice, each task sending one row
for each slice it has seen, so a slice that fills most of the table is combined before the shuffle;
the whole is added up from the slices in the same job. Missing values of a slice column are a slice too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.grading import check_status, check_thresholds, percent, severity
from plumbline.functions.hashing import key_value
from plumbline.operators.scoring import score_components, score_totals
from plumbline.plans.config import RunConfig
from plumbline.plans.facts import collect_facts
from plumbline.plans.states import CheckStates
from plumbline.plans.storage import settle
from plumbline.plans.table import Table


@dataclass(frozen=True)
class SlicedResult:
    """Result tables by slice.

    Each begins with ``dataset``, ``slice`` (the values as text, null for the whole table) and
    ``slice_values`` (a map by column name). Those of a check that isn't configured are ``None``.
    """

    counts: DataFrame
    missing: DataFrame
    types: DataFrame | None
    rules: DataFrame | None
    duplicates: DataFrame
    score_components: DataFrame
    score: DataFrame


class _Slices:
    """The slices of a table by some of its columns."""

    def __init__(self, table: Table, by: Sequence[str]) -> None:
        if not by:
            raise ValueError("slices need at least one column")
        if len(set(by)) < len(by):
            raise ValueError("a slice column is named twice")
        table.require(by, "slices")
        self.by = list(by)
        self.keys = [f"slice_{i}" for i in range(len(by))]
        self.columns = [
            key_value(table.column(name), table.kind(name)).alias(key)
            for name, key in zip(by, self.keys, strict=True)
        ]

    def with_whole(self, states: DataFrame, labels: Sequence[str]) -> DataFrame:
        """Rows by slice and one for the whole, told by ``whole``; counts are added up.

        Only rows of slices are doubled for it, never those of the table. An empty table has no
        slices and no whole.
        """
        sums = [F.coalesce(F.sum(label), F.lit(0).cast("long")).alias(label) for label in labels]
        sets = states.groupingSets([[F.col(key) for key in self.keys], []], *self.keys)
        return sets.agg(F.grouping(self.keys[0]).cast("boolean").alias("whole"), *sums)

    def named(self, rows: DataFrame, dataset: str) -> DataFrame:
        """The slices by their names instead of their keys."""
        texts = [F.col(key).cast("string") for key in self.keys]
        values = F.create_map(*[x for pair in zip(map(F.lit, self.by), texts) for x in pair])
        shown = [
            F.concat(F.lit(name), F.coalesce(F.concat(F.lit("="), text), F.lit(" is missing")))
            for name, text in zip(self.by, texts, strict=True)
        ]
        whole = F.col("whole")
        kept = [c for c in rows.columns if c not in {*self.keys, "whole", "dataset"}]
        return rows.select(
            F.lit(dataset).alias("dataset"),
            F.when(~whole, F.concat_ws(", ", *shown)).alias("slice"),
            F.when(~whole, values).alias("slice_values"),
            *kept,
        )


def sliced_duplicates(
    df: DataFrame,
    by: Sequence[str],
    key_columns: Sequence[str],
    dataset: str = "dataset",
    warning_threshold: float = 1.0,
    high_threshold: float = 5.0,
) -> DataFrame:
    """Rows that share a key with another row of their slice, and, for the whole, of the table.

    Rows are counted by slice and key once; the keys of the whole are added up from that.
    """
    check_thresholds(warning_threshold, high_threshold)
    table = Table.of(df)
    table.require(key_columns, "duplicate key")
    slices = _Slices(table, by)
    keys = [f"k{i}" for i in range(len(key_columns))]
    chosen = [
        key_value(table.column(name), table.kind(name)).alias(key)
        for name, key in zip(key_columns, keys, strict=True)
    ]
    counted = (
        table.frame.select(*slices.columns, *chosen)
        .groupBy(*keys, *slices.keys)
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    # One row for each key and slice, and one for each key in the whole table.
    sets = counted.groupingSets(
        [[F.col(c) for c in (*keys, *slices.keys)], [F.col(c) for c in keys]], *keys, *slices.keys
    )
    groups = sets.agg(
        F.grouping(slices.keys[0]).cast("boolean").alias("whole"), F.sum("copies").alias("copies")
    )
    repeated = F.col("copies") > 1
    by_slice = groups.groupBy("whole", *slices.keys).agg(
        F.sum("copies").alias("row_count"),
        F.coalesce(F.sum(F.when(repeated, F.col("copies"))), F.lit(0)).alias("duplicate_row_count"),
        F.count_if(repeated).alias("duplicate_group_count"),
    )
    named = slices.named(by_slice, dataset)
    share = percent(F.col("duplicate_row_count"), F.col("row_count"))
    graded = named.withColumn("duplicate_percentage", share).withColumn(
        "severity", severity(F.col("duplicate_percentage"), warning_threshold, high_threshold)
    )
    return graded.withColumn(
        "status", check_status(F.col("duplicate_row_count"), F.col("severity") == "high")
    )


def check_slices(
    df: DataFrame,
    by: Sequence[str],
    config: RunConfig | None = None,
    reference_date: date | None = None,
    date_formats: tuple[str, ...] = (),
    warning_threshold: float = 1.0,
    high_threshold: float = 5.0,
    missing_thresholds: tuple[float, float] = (5.0, 20.0),
) -> SlicedResult:
    """Missing values, types, rules, duplicates and score of each slice and of the whole table.

    Without a duplicate key whole rows are compared. Two jobs: the shared pass, and the duplicates.
    """
    config = config or RunConfig()
    dataset = config.dataset_name
    thresholds = (warning_threshold, high_threshold)
    table = Table.of(df)
    checks = CheckStates(
        table, config, reference_date, date_formats, *thresholds, missing_thresholds
    )
    slices = _Slices(table, by)
    states = slices.with_whole(checks.of_rows(*slices.columns), checks.scan.labels)
    results = settle(slices.named(checks.results(states, *slices.keys, "whole"), dataset))
    duplicates = settle(
        sliced_duplicates(df, by, config.duplicate_key_columns or table.names, dataset, *thresholds)
    )
    slice_of = ("slice", "slice_values")

    def rows(part: str) -> DataFrame | None:
        return results.select("dataset", *slice_of, F.inline(part)) if part in checks.parts else None

    # Score and facts go by dataset, so each slice is a dataset of its own there.
    values = F.to_json("slice_values", {"ignoreNullFields": "false"})
    name = F.coalesce(F.concat(F.col("dataset"), F.lit("/"), values), F.col("dataset"))
    alone = results.withColumn("dataset", name)
    tables = checks.tables(alone)
    names = alone.select("dataset", *slice_of)
    facts = settle(
        collect_facts(
            tables["counts"],
            tables["missing_summary"],
            duplicates.withColumn("dataset", name).withColumn("scope", F.lit("slice")),
            tables.get("type_summary"),
            tables.get("rule_summary"),
        )
    )

    def by_slice(scored: DataFrame) -> DataFrame:
        joined = scored.join(names, "dataset")
        rest = [c for c in scored.columns if c != "dataset"]
        return joined.select(F.lit(dataset).alias("dataset"), *slice_of, *rest)

    components = score_components(facts)
    return SlicedResult(
        counts=results.select("dataset", *slice_of, "row_count", "column_count"),
        missing=rows("missing"),
        types=rows("types"),
        rules=rows("rules"),
        duplicates=duplicates,
        score_components=by_slice(components),
        score=by_slice(score_totals(components)),
    )


def missing_by_slice(df: DataFrame, by: Sequence[str], dataset: str = "dataset", **options) -> DataFrame:
    """The rows of ``check_missing`` for each slice and the whole; ``options`` as for ``CheckStates``."""
    return _sliced(df, by, RunConfig(dataset), "missing", **options)


def rules_by_slice(df: DataFrame, by: Sequence[str], rules: Sequence, dataset: str = "dataset", **options) -> DataFrame:
    """The rows of ``check_rules`` for each slice and the whole."""
    return _sliced(df, by, RunConfig(dataset, business_rules=tuple(rules)), "rules", **options)


def types_by_slice(
    df: DataFrame, by: Sequence[str], expected_schema: dict[str, str], dataset: str = "dataset", **options
) -> DataFrame:
    """The rows of ``check_types`` for each slice and the whole."""
    return _sliced(df, by, RunConfig(dataset, expected_schema=expected_schema), "types", **options)


def _sliced(df: DataFrame, by: Sequence[str], config: RunConfig, part: str, **options) -> DataFrame:
    table = Table.of(df)
    checks = CheckStates(table, config, **options)
    slices = _Slices(table, by)
    if part not in checks.parts:
        raise ValueError(f"nothing to check: no {part}")
    states = slices.with_whole(checks.of_rows(*slices.columns), checks.scan.labels)
    results = slices.named(checks.results(states, *slices.keys, "whole"), config.dataset_name)
    return results.select("dataset", "slice", "slice_values", F.inline(part))


def slice_column(name: str) -> Column:
    """A slice's value of one column, as text."""
    return F.col("slice_values").getItem(name)
