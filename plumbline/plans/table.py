"""The table under check, and one shared pass over it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.parsing import as_number, as_timestamp, is_fractional


def without_nan(value: Column, kind: T.DataType) -> Column:
    """NaN counts as missing, so floating columns lose it before anything else looks at them."""
    if is_fractional(kind):
        return F.nanvl(value, F.lit(None).cast(kind))
    return value


@dataclass(frozen=True)
class Table:
    """A DataFrame with its columns renamed by position.

    Names are matched exactly, so dots, blanks, quotes and names that differ only in case are
    all safe; the original names travel as literals.
    """

    frame: DataFrame
    names: tuple[str, ...]
    kinds: tuple[T.DataType, ...]

    @classmethod
    def of(cls, df: DataFrame, carried: int = 0) -> Table:
        """The last ``carried`` columns are no part of the table but come along as carried_0, ..."""
        fields = df.schema.fields[: len(df.columns) - carried]
        kept = [f"carried_{i}" for i in range(carried)]
        frame = df.toDF(*[f"c{i}" for i in range(len(fields))], *kept)
        frame = frame.select(
            *[without_nan(F.col(f"c{i}"), f.dataType).alias(f"c{i}") for i, f in enumerate(fields)],
            *kept,
        )
        return cls(frame, tuple(f.name for f in fields), tuple(f.dataType for f in fields))

    def position(self, name: str) -> int:
        return self.names.index(name)

    def column(self, name: str) -> Column:
        return F.col(f"c{self.position(name)}")

    def kind(self, name: str) -> T.DataType:
        return self.kinds[self.position(name)]

    def require(self, names: Iterable[str], purpose: str) -> None:
        unknown = sorted({name for name in names if name not in self.names})
        if unknown:
            raise ValueError(f"{purpose}: no such columns {unknown}")


class Scan:
    """One pass over a table on behalf of several checks.

    A check asks for per-row values (``number``, ``timestamp``) and for aggregates (``total``), and
    describes its result over those. Whatever several checks ask for is computed once, and
    ``row`` yields all results as one row from a single aggregation without a shuffle of data.
    """

    def __init__(self, table: Table, dataset: str = "dataset"):
        self.table = table
        self.dataset = dataset
        self._values: dict[str, Column] = {}
        self._totals: dict[str, Column] = {}
        self.row_count = self.total("row_count", F.count(F.lit(1)))

    def value(self, label: str, expression: Column) -> Column:
        self._values.setdefault(label, expression)
        return F.col(label)

    def number(self, name: str) -> Column:
        i = self.table.position(name)
        return self.value(f"number_{i}", as_number(F.col(f"c{i}"), self.table.kinds[i]))

    def timestamp(self, name: str, formats: tuple[str, ...] = ()) -> Column:
        i = self.table.position(name)
        return self.value(
            f"timestamp_{i}", as_timestamp(F.col(f"c{i}"), self.table.kinds[i], formats)
        )

    def total(self, label: str, aggregate: Column) -> Column:
        self._totals.setdefault(label, aggregate)
        return F.col(label)

    def present_count(self, name: str) -> Column:
        i = self.table.position(name)
        return self.total(f"present_{i}", F.count(F.col(f"c{i}")))

    def row_values(self) -> DataFrame:
        """The table with every per-row value asked for."""
        return self.table.frame.select(
            "*", *[expression.alias(label) for label, expression in self._values.items()]
        )

    @property
    def labels(self) -> list[str]:
        """Names of all totals asked for."""
        return list(self._totals)

    def totals(self, *by: Column) -> DataFrame:
        """All totals, for each value of the columns given; a task sends one row per value."""
        return self.row_values().groupBy(*by).agg(*self.aggregates())

    def aggregates(self) -> list[Column]:
        return [aggregate.alias(label) for label, aggregate in self._totals.items()]

    def row(self, **results: Column) -> DataFrame:
        return self.results(self.totals(), **results)

    def results(self, totals: DataFrame, *kept: str, **results: Column) -> DataFrame:
        """What the checks describe over rows of totals, with the columns to keep in front."""
        return totals.select(
            *kept,
            F.lit(self.dataset).alias("dataset"),
            F.col("row_count"),
            F.lit(len(self.table.names)).cast("long").alias("column_count"),
            *[result.alias(label) for label, result in results.items()],
        )


def rows_of(entries: list[Column], schema: str) -> Column:
    """Array of result rows; an empty one keeps its type."""
    if not entries:
        return F.array().cast(f"array<struct<{schema}>>")
    return F.array(*entries)
