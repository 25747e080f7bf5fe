"""Column profile, sample values and a preview of the table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.grading import percent
from plumbline.functions.parsing import TIME_TYPES
from plumbline.plans.table import Scan, Table, rows_of

PROFILE_ROW = (
    "position int, column_name string, data_type string, non_null_count bigint, "
    "null_count bigint"
)
SAMPLE_ROW = (
    "dataset string, position int, column_name string, sample_rank int, sample_value string"
)


def plan_profile(scan: Scan) -> Column:
    rows = []
    for position, (name, kind) in enumerate(zip(scan.table.names, scan.table.kinds, strict=True)):
        present = scan.present_count(name)
        rows.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(name).alias("column_name"),
                F.lit(kind.simpleString()).alias("data_type"),
                present.alias("non_null_count"),
                (scan.row_count - present).alias("null_count"),
            )
        )
    return F.transform(
        rows_of(rows, PROFILE_ROW),
        lambda row: row.withField(
            "null_percentage",
            percent(row["null_count"], row["null_count"] + row["non_null_count"]),
        ),
    )


def profile_columns(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """One row per column: type, present and missing counts, and the size of the table."""
    scan = Scan(Table.of(df), dataset)
    return scan.row(profile=plan_profile(scan)).select(
        "dataset", "row_count", "column_count", F.inline("profile")
    )


def _comparable(value: Column, kind: T.DataType) -> Column:
    """The value in a form that can be ordered; -0.0 becomes 0.0."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return value + F.lit(0.0).cast(kind)
    if isinstance(kind, (T.NumericType, T.StringType, *TIME_TYPES)):
        return value
    return value.cast("string")


def _thinner(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that leaves at most ``k`` rows of a part of the table: column by column, the
    smallest distinct values.

    It is a closure so that it travels to the executors by value, which do not have this package.
    """

    def thin(batches):
        smallest = []
        for batch in batches:
            smallest = smallest or [pa.array([], field.type) for field in batch.schema]
            for i, column in enumerate(batch.columns):
                kept = smallest[i]
                if len(kept) == k:
                    column = column.filter(pc.less(column, kept[k - 1]))
                if len(column) > column.null_count:
                    distinct = pc.unique(pa.concat_arrays([kept, column.drop_null()]))
                    smallest[i] = distinct.take(pc.array_sort_indices(distinct))[:k]
        if smallest:
            rows = max(len(kept) for kept in smallest)
            padded = [pa.concat_arrays([x, pa.nulls(rows - len(x), x.type)]) for x in smallest]
            yield pa.RecordBatch.from_arrays(padded, names=batch.schema.names)

    return thin


def sample_values(df: DataFrame, dataset: str = "dataset", max_values: int = 5) -> DataFrame:
    """The smallest distinct values of every column, as text, one row each.

    Spark has no aggregate that keeps the k smallest distinct values, and grouping by value would
    shuffle every distinct value of the table. So each task first thins its part to ``max_values``
    rows, column by column, each in the order of its own type, and only those meet.
    """
    table = Table.of(df)
    if max_values <= 0 or not table.names:
        return df.sparkSession.createDataFrame([], SAMPLE_ROW)
    names = F.array(*[F.lit(name) for name in table.names])
    return smallest_values(table, max_values).select(
        F.lit(dataset).alias("dataset"),
        "position",
        F.get(names, F.col("position")).alias("column_name"),
        "sample_rank",
        "sample_value",
    )


def smallest_values(table: Table, max_values: int, further: Sequence[Column] = ()) -> DataFrame:
    """Rows ``(position, sample_rank, sample_value)``; ``further`` values are positions behind the columns.

    There has to be a column, and at least one value of each is asked for.
    """
    columns = [_comparable(F.col(f"c{i}"), kind) for i, kind in enumerate(table.kinds)]
    columns += further
    values = table.frame.select(*[column.alias(f"c{i}") for i, column in enumerate(columns)])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in values.schema.fields])
    # Each task's few rows meet in one, which holds no more than the smallest values either.
    smallest = values.mapInArrow(_thinner(max_values), schema).repartition(1)
    rows = smallest.mapInArrow(_thinner(max_values), schema).withColumn(
        "sample_rank", (F.monotonically_increasing_id() + 1).cast("int")
    )
    cells = [
        F.when(
            F.col(f"c{i}").isNotNull(),
            F.struct(F.lit(i).alias("position"), F.col(f"c{i}").cast("string").alias("sample_value")),
        )
        for i in range(len(columns))
    ]
    return rows.select("sample_rank", F.inline(F.array_compact(F.array(*cells)))).select(
        "position", "sample_rank", "sample_value"
    )


def preview(df: DataFrame, max_rows: int = 20, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows of the table; in the order of ``order_by`` where given."""
    table = Table.of(df)
    table.require(order_by, "preview order")
    if order_by:
        # By position, as names that differ in case only can't be told apart otherwise.
        named = df.toDF(*[f"c{i}" for i in range(len(table.names))])
        df = named.orderBy(*[table.column(name) for name in order_by]).toDF(*table.names)
    return df.limit(max_rows)
