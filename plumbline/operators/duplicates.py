"""Rows that share a key, or are equal throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.grading import (
    check_limit,
    check_status,
    check_thresholds,
    percent,
    severity,
)
from plumbline.functions.hashing import holds_map, key_hashes, key_value
from plumbline.functions.parsing import NESTED_TYPES
from plumbline.functions.text import shown
from plumbline.plans.table import Table


def _keys(table: Table, key_columns: Sequence[str] | None) -> tuple[str, list[str]]:
    if key_columns:
        table.require(key_columns, "duplicate key")
        return "key_columns", list(key_columns)
    return "full_row", list(table.names)


def _key_frame(table: Table, keys: list[str]) -> DataFrame:
    """Only the key columns, as k0, k1, ...; -0.0 becomes 0.0 so that both are one key."""
    return table.frame.select(
        *[
            key_value(table.column(name), table.kind(name)).alias(f"k{i}")
            for i, name in enumerate(keys)
        ]
    )


def _count_copies(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))


def _suspect_rows(rows: DataFrame) -> DataFrame:
    """The rows that can have a copy, found through row hashes.

    Hashes are counted first, a few bytes per row; then only rows whose hash repeats are compared
    exactly. How the two meet is left to adaptive execution, which broadcasts few hashes and splits
    those of hot rows.
    """
    return _with_repeated_hash(rows, rows.columns).drop("row_hash")


def _with_repeated_hash(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose ``row_hash`` over the key columns occurs more than once."""
    kinds = [rows.schema[name].dataType for name in keys]
    row_hash, _ = key_hashes([F.col(name) for name in keys], kinds)
    hashed = rows.withColumn("row_hash", row_hash)
    repeated = (
        hashed.groupBy("row_hash")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select("row_hash")
    )
    return hashed.join(repeated, "row_hash", "left_semi")


class DuplicateGroups:
    """The repeated keys of a table, from which summary and examples are derived."""

    def __init__(self, df: DataFrame, key_columns: Sequence[str] | None, dataset: str):
        self.table = Table.of(df)
        self.dataset = dataset
        self.scope, self.keys = _keys(self.table, key_columns)
        self.kinds = [self.table.kind(name) for name in self.keys]
        if not self.keys:
            self.row_total = None
            self.groups = None
            return
        rows = _key_frame(self.table, self.keys)
        if self.scope == "full_row" and len(self.keys) > 1:
            self.row_total = rows.agg(F.count(F.lit(1)).alias("row_count"))
            self.groups = _count_copies(_suspect_rows(rows))
        else:
            self.row_total = None
            self.groups = _count_copies(rows)

    def keep(self) -> None:
        """Compute the repeated keys now and hold them on the executors' disks.

        Usually there are few, and what follows does not aggregate all keys again. Afterwards
        ``summary`` has to be told the row count.
        """
        if self.groups is not None:
            self.groups = self.groups.filter("copies > 1").persist(StorageLevel.DISK_ONLY)
            self.groups.count()

    def release(self) -> None:
        if self.groups is not None:
            self.groups.unpersist()

    def summary(
        self, warning_threshold: float, high_threshold: float, row_count: int | None = None
    ) -> DataFrame:
        copies = F.col("copies")
        if self.groups is None:
            counts = self.table.frame.agg(
                F.count(F.lit(1)).alias("row_count"),
                F.lit(0).cast("long").alias("rows"),
                F.lit(0).cast("long").alias("groups"),
            )
        else:
            repeated = copies > 1
            counts = self.groups.agg(
                F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("row_count"),
                F.coalesce(F.sum(F.when(repeated, copies)), F.lit(0)).cast("long").alias("rows"),
                F.count_if(repeated).alias("groups"),
            )
            if row_count is not None:
                counts = counts.withColumn("row_count", F.lit(row_count).cast("long"))
            elif self.row_total is not None:
                counts = (
                    counts.withColumn("row_count", F.lit(0).cast("long"))
                    .unionByName(
                        self.row_total.select(
                            "row_count",
                            F.lit(0).cast("long").alias("rows"),
                            F.lit(0).cast("long").alias("groups"),
                        )
                    )
                    .agg(*[F.sum(c).alias(c) for c in ("row_count", "rows", "groups")])
                )
        share = F.col("duplicate_percentage")
        return (
            counts.withColumn("duplicate_percentage", percent(F.col("rows"), F.col("row_count")))
            .withColumn("severity", severity(share, warning_threshold, high_threshold))
            .select(
                F.lit(self.dataset).alias("dataset"),
                check_status(F.col("rows"), F.col("severity") == "high").alias("status"),
                F.lit(self.scope).alias("scope"),
                F.array(*[F.lit(k) for k in self.keys]).cast("array<string>").alias("key_columns"),
                "row_count",
                F.col("rows").alias("duplicate_row_count"),
                "duplicate_percentage",
                F.col("groups").alias("duplicate_group_count"),
                "severity",
            )
        )

    def largest(self, max_groups: int) -> DataFrame:
        if self.groups is None or max_groups == 0:
            return self.table.frame.sparkSession.createDataFrame(
                [],
                "dataset string, group_rank int, duplicate_key map<string,string>, "
                "duplicate_count bigint",
            )
        texts = [F.col(f"k{i}").cast("string") for i in range(len(self.keys))]
        order = [
            text if isinstance(kind, (*NESTED_TYPES, T.BinaryType)) else F.col(f"k{i}")
            for i, (text, kind) in enumerate(zip(texts, self.kinds, strict=True))
        ]
        ranking = [F.desc("copies"), *order]
        key_map = F.map_from_arrays(
            F.array(*[F.lit(name) for name in self.keys]), F.array(*[shown(t) for t in texts])
        )
        top = self.groups.filter("copies > 1").orderBy(*ranking).limit(max_groups)
        # The window only sees the few rows the limit left.
        return top.select(
            F.lit(self.dataset).alias("dataset"),
            F.row_number().over(Window.orderBy(*ranking)).alias("group_rank"),
            key_map.alias("duplicate_key"),
            F.col("copies").alias("duplicate_count"),
        )


def check_duplicates(
    df: DataFrame,
    key_columns: Sequence[str] | None = None,
    dataset: str = "dataset",
    warning_threshold: float = 1.0,
    high_threshold: float = 5.0,
) -> DataFrame:
    """One row: how many rows share their key with another row, and in how many groups.

    Without ``key_columns`` whole rows are compared. Every member of a repeated key counts, and
    nulls are equal to each other.
    """
    check_thresholds(warning_threshold, high_threshold)
    return DuplicateGroups(df, key_columns, dataset).summary(warning_threshold, high_threshold)


def largest_duplicate_groups(
    df: DataFrame,
    key_columns: Sequence[str] | None = None,
    dataset: str = "dataset",
    max_groups: int = 10,
) -> DataFrame:
    """The repeated keys with the most rows, at most ``max_groups`` of them."""
    check_limit("max_groups", max_groups)
    return DuplicateGroups(df, key_columns, dataset).largest(max_groups)


def duplicate_rows(df: DataFrame, key_columns: Sequence[str] | None = None) -> DataFrame:
    """The rows that share their key with another row, with the size of their group.

    Group sizes are joined back to the rows instead of gathered in a window, so the rows of a hot
    key can be spread over many tasks.
    """
    table = Table.of(df)
    _, keys = _keys(table, key_columns)
    if not keys:
        return df.limit(0).withColumn("duplicate_count", F.lit(0).cast("long"))
    key_names = [f"k{i}" for i in range(len(keys))]
    suspects = _with_repeated_hash(_key_frame(table, keys), key_names)
    repeated = suspects.groupBy("row_hash", *key_names).agg(F.count(F.lit(1)).alias("copies"))
    repeated = repeated.filter("copies > 1").withColumnRenamed("row_hash", "copies_hash")
    keyed = table.frame.select(
        "*",
        *[
            key_value(table.column(name), table.kind(name)).alias(f"r{i}")
            for i, name in enumerate(keys)
        ],
    )
    keyed = _with_repeated_hash(keyed, [f"r{i}" for i in range(len(keys))])
    match = F.col("row_hash") == F.col("copies_hash")
    for i, kind in enumerate(table.kind(n) for n in keys):
        left, right = F.col(f"r{i}"), F.col(f"k{i}")
        if holds_map(kind):
            left, right = F.to_json(left), F.to_json(right)
        match = match & left.eqNullSafe(right)
    return keyed.join(repeated, match, "inner").select(
        *[F.col(f"c{i}").alias(name) for i, name in enumerate(table.names)],
        F.col("copies").alias("duplicate_count"),
    )
