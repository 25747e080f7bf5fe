"""How often each value occurs, for several columns from one pass over the table.

Rows become (column, value, count) and are counted in each task before the one shuffle. In it, a text
is represented by its first ``SHOWN_WHOLE`` characters, and by two hashes if it is longer. The groups of all
columns are ranked together, each task keeping as many as are shown. Only if some of those are longer
texts is the table read again, to look up the texts of these groups and of others with the same count and
the same beginning, and to order them by the whole text. Two longer texts are told apart by their first
characters and two hashes of 64 bits.

Nulls are one value, which comes first among equal counts; NaN is null, -0.0 is 0.0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.grading import check_limit
from plumbline.functions.hashing import key_hashes, key_value
from plumbline.plans.table import Table

#: Texts of at most so many characters are values in the shuffle themselves.
SHOWN_WHOLE = 32

#: Up to this number of rows shown, tasks keep only the first rows of a column before these are ranked.
#: Spark's default for that; it is not to be asked for more here.
MOST_SHOWN = 1000

#: Up to this number of groups, of four numbers each, go to every task to look up their texts; beyond it
#: texts are shuffled.
SENT_TO_ALL = 100_000

#: Digits that a double holds exactly.
EXACT_DIGITS = 15

DISTRIBUTION_ROW = (
    "dataset string, column_name string, value_rank int, value string, row_count bigint, value_count bigint"
)
WHOLE_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def can_share_pass(kind: T.DataType | None) -> bool:
    """Whether values of the type have an order and a text that fit into a row of fixed width."""
    if isinstance(kind, T.DecimalType):
        return kind.precision <= EXACT_DIGITS
    kinds = (*WHOLE_NUMBERS, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return kind == T.StringType() or isinstance(kind, kinds)


def _whole(value: Column, kind: T.DataType) -> Column:
    """A whole number in the order of the values, 0 where another part holds the order."""
    if isinstance(kind, WHOLE_NUMBERS):
        return value.cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("bigint")
    if isinstance(kind, T.TimestampNTZType):
        # From its parts, as a zone would repeat an hour each year.
        minutes = F.unix_date(value.cast("date")) * F.lit(1440).cast("bigint") + F.hour(value) * 60 + F.minute(value)
        return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), value) * 1_000_000).cast("bigint")
    return F.unix_micros(value) if isinstance(kind, T.TimestampType) else F.lit(0)


def _entry(position: int, value: Column, kind: T.DataType) -> Column:
    value = key_value(value, kind)
    text = value.cast("string")
    is_text = isinstance(kind, T.StringType)
    fraction = value.cast("double") if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)) else F.lit(0.0)
    longer = F.coalesce(F.length(text) > SHOWN_WHOLE, F.lit(False)) if is_text else F.lit(False)
    one, other = key_hashes([text], [T.StringType()])
    return F.struct(
        F.lit(position).alias("position"),
        value.isNotNull().alias("present"),
        F.coalesce(_whole(value, kind), F.lit(0)).cast("bigint").alias("whole"),
        F.coalesce(fraction, F.lit(0.0)).alias("fraction"),
        (F.substring(text, 1, SHOWN_WHOLE) if is_text else text).alias("start"),
        longer.alias("longer"),
        F.when(longer, one).otherwise(0).alias("one"),
        F.when(longer, other).otherwise(0).alias("other"),
    )


def value_groups(table: Table, positions: Sequence[int]) -> DataFrame:
    """One row for each different value of each of the columns, and how often it occurs."""
    entries = [_entry(p, F.col(f"c{p}"), table.kinds[p]) for p in dict.fromkeys(positions)]
    return (
        table.frame.select(F.inline(F.array(*entries)))
        .groupBy("position", "present", "whole", "fraction", "start", "longer", "one", "other")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def _first(rows: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """The first rows of each column."""
    nth = F.row_number().over(Window.partitionBy("position").orderBy(*order))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= most)


def _looked_up(table: Table, groups: DataFrame, shown: list[Row], max_rows: int) -> list[Row]:
    """(position, value, row_count) of longer texts that may be shown."""
    last = {row.position: row for row in shown}
    full = {p: sum(row.position == p for row in shown) == max_rows for p in last}
    of_texts = sorted({row.position for row in shown if row.longer})
    # A column that is shown whole has no row after which nothing is shown.
    cuts = table.frame.sparkSession.createDataFrame(
        [(p, last[p].row_count if full[p] else 0, last[p].start if full[p] else None) for p in of_texts],
        "position int, cut_count bigint, cut_start string",
    )
    as_far = (F.col("row_count") > F.col("cut_count")) | (
        (F.col("row_count") == F.col("cut_count")) & (F.col("start") <= F.col("cut_start"))
    )
    wanted = (
        groups.filter("longer")
        .join(F.broadcast(cuts), "position")
        .filter(as_far)
        .select("position", "one", "other", "row_count")
        .persist(StorageLevel.DISK_ONLY)
    )
    texts = table.frame.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(p).alias("position"), F.col(f"c{p}").alias("value")) for p in of_texts]
            )
        )
    ).filter(F.length("value") > SHOWN_WHOLE)
    one, other = key_hashes([F.col("value")], [T.StringType()])
    try:
        # Counted first, as otherwise texts are shuffled before the other side is known to be small.
        few = wanted.count() <= SENT_TO_ALL
        found = (
            texts.withColumns({"one": one, "other": other})
            .join(F.broadcast(wanted) if few else wanted, ["position", "one", "other"])
            .select("position", "value", "row_count")
            .distinct()
        )
        return _first(found, max_rows, F.desc("row_count"), "value").collect()
    finally:
        wanted.unpersist()


def distributions(df: DataFrame, columns: Sequence[str], max_rows: int = 50) -> list[tuple[int, list[tuple]]]:
    """For each column, its number of different values and the most frequent (value as text, count)."""
    check_limit("max_rows", max_rows)
    if max_rows > MOST_SHOWN:
        raise ValueError(f"at most {MOST_SHOWN} rows of a distribution are shown")
    table = Table.of(df)
    table.require(columns, "distribution")
    positions = [table.position(name) for name in columns]
    unfit = [name for name in columns if not can_share_pass(table.kind(name))]
    if unfit:
        raise ValueError(f"distributions of {unfit} take a pass of their own")
    if not positions:
        return []
    groups = value_groups(table, positions).persist(StorageLevel.DISK_ONLY)
    try:
        counted = {
            row.position: row.value_count
            for row in groups.groupBy("position").agg(F.count(F.lit(1)).alias("value_count")).collect()
        }
        order = (F.desc("row_count"), "present", "whole", "fraction", "start", "longer")
        first = _first(groups, max_rows, *order)
        shown = sorted(first.collect(), key=lambda row: (row.position, row.nth))
        rows: dict[int, list[tuple]] = {p: [] for p in positions}
        for row in shown:
            if not row.longer:
                rows[row.position].append((row.start, row.row_count))
        if any(row.longer for row in shown):
            texts = _looked_up(table, groups, shown, max_rows)
            for row in texts:
                rows[row.position].append((row.value, row.row_count))
            for p in {row.position for row in texts}:
                rows[p].sort(key=lambda row: (-row[1], row[0] is not None, (row[0] or "").encode()))
    finally:
        groups.unpersist()
    return [(counted.get(p, 0), rows[p][:max_rows]) for p in positions]


def value_distributions(
    df: DataFrame, columns: Sequence[str], dataset: str = "dataset", max_rows: int = 50
) -> DataFrame:
    """The most frequent values of every column, with the number of its different values.

    Rows with equal counts come in the order of the values, nulls first. A table without rows has none here.
    """
    found = distributions(df, columns, max_rows)
    return df.sparkSession.createDataFrame(
        [
            (dataset, name, rank, value, row_count, value_count)
            for name, (value_count, rows) in zip(columns, found, strict=True)
            for rank, (value, row_count) in enumerate(rows, start=1)
        ],
        DISTRIBUTION_ROW,
    )
