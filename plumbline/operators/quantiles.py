"""Quantiles of numeric columns, from sketches that merge, or exactly, and drift between two tables.

A sketch (KLL) of a column has a few kilobytes, whatever the number of rows. All columns are sketched in one
pass without a shuffle of data, and sketches of parts merge to that of the whole, so they can be stored. The
rank of a quantile is off by 1.7% at most with 99% confidence at the default k. Text is read as a number as
elsewhere; what is no number, missing or infinite does not count. A sketch keeps a random choice of values, so
states that are compared or merged later should be stored, not computed again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.parsing import is_checkable
from plumbline.plans.storage import settle
from plumbline.plans.table import Scan, Table

K = 200
PROBABILITIES = (0.01, 0.25, 0.5, 0.75, 0.99)
STATE = "column_name string, position int, value_count bigint, sketch binary"
#: Quantiles by which two sketches are compared.
GRID = 100


def _numbers(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    table = Table.of(df)
    table.require(columns, "quantiles")
    for name in columns:
        if not is_checkable(table.kind(name)):
            raise ValueError(f"column {name!r} of type {table.kind(name).simpleString()} has no numbers")
    scan = Scan(table)
    numbers = [scan.number(name) for name in columns]
    finite = [F.when(F.abs(n) < F.lit(float("inf")), n + F.lit(0.0)) for n in numbers]
    return scan.row_values(), finite


def _check(probabilities: Sequence[float]) -> None:
    if not probabilities or not all(0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities are from 0 to 1")


def quantile_states(df: DataFrame, columns: Sequence[str], k: int = K) -> DataFrame:
    """column_name, position, value_count and sketch of each column; one pass."""
    if not columns:
        return df.sparkSession.createDataFrame([], STATE)
    rows, numbers = _numbers(df, columns)
    one_row = rows.select(*[n.alias(f"n{i}") for i, n in enumerate(numbers)]).agg(
        *[F.kll_sketch_agg_double(f"n{i}", F.lit(k)).alias(f"s{i}") for i in range(len(columns))],
        *[F.count(f"n{i}").alias(f"v{i}") for i in range(len(columns))],
    )
    entries = [
        F.struct(
            F.lit(name).alias("column_name"), F.lit(i).alias("position"),
            F.col(f"v{i}").alias("value_count"), F.col(f"s{i}").alias("sketch"),
        )
        for i, name in enumerate(columns)
    ]
    return one_row.select(F.inline(F.array(*entries)))


def merge_quantiles(states: DataFrame) -> DataFrame:
    """The states of the whole from states of its parts."""
    return states.groupBy("column_name", "position").agg(
        F.sum("value_count").alias("value_count"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def quantiles_of(states: DataFrame, probabilities: Sequence[float] = PROBABILITIES) -> DataFrame:
    """column_name, position, value_count, probability and value; null for columns without numbers."""
    _check(probabilities)
    asked = F.array(*[F.lit(float(p)) for p in probabilities])
    some = F.col("value_count") > 0
    found = F.when(some, F.kll_sketch_get_quantile_double("sketch", asked))
    rows = F.transform(
        asked, lambda p, i: F.struct(p.alias("probability"), F.get("found", i).alias("value"))
    )
    with_values = states.withColumn("found", found)
    return with_values.select("column_name", "position", "value_count", F.inline(rows))


def numeric_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = PROBABILITIES,
    exact: bool = False,
    k: int = K,
) -> DataFrame:
    """Quantiles of the columns: the least value that so large a share of the values does not exceed.

    Exactly, different values are counted, cut into ranges, and summed up range by range; no column's
    values come together in a task.
    """
    _check(probabilities)
    if not exact or not columns:
        return quantiles_of(quantile_states(df, columns, k), probabilities)
    rows, numbers = _numbers(df, columns)
    entries = [F.struct(F.lit(i).alias("position"), n.alias("value")) for i, n in enumerate(numbers)]
    counted = (
        rows.select(F.inline(F.array(*entries)))
        .filter("value IS NOT NULL")
        .groupBy("position", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.repartitionByRange(count, "position", "value")
    dealt = settle(dealt.withColumn("part", F.spark_partition_id()))
    # A row for each column and range of its values.
    sums = dealt.groupBy("position", "part").agg(F.sum("n").alias("sum"))
    parts = Window.partitionBy("position").orderBy("part")
    sums = sums.withColumn("before", F.sum("sum").over(parts) - F.col("sum")).withColumn(
        "value_count", F.sum("sum").over(Window.partitionBy("position"))
    )
    within = Window.partitionBy("position", "part").orderBy("value")
    placed = (
        dealt.withColumn("so_far", F.sum("n").over(within))
        .join(F.broadcast(sums), ["position", "part"])
        .withColumn("last", F.col("before") + F.col("so_far"))
        .withColumn("probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    )
    rank = F.greatest(F.lit(1), F.ceil(F.col("probability") * F.col("value_count")))
    found = placed.filter((rank <= F.col("last")) & (rank > F.col("last") - F.col("n"))).select(
        "position", "value_count", "probability", "value"
    )
    asked = [(i, name, float(p)) for i, name in enumerate(columns) for p in probabilities]
    every = df.sparkSession.createDataFrame(asked, "position int, column_name string, probability double")
    return F.broadcast(every).join(found, ["position", "probability"], "left").select(
        "column_name", "position", F.coalesce("value_count", F.lit(0)).cast("long").alias("value_count"),
        "probability", "value",
    )


def quantile_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """column_name and drift between two tables of states: the largest distance of shares, 0 to 1.

    Both sides are described by their quantiles, GRID of them, and at each of these values the share of
    quantiles up to it is compared; null where a side has no numbers.
    """
    grid = F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)])

    def side(states: DataFrame, name: str) -> DataFrame:
        some = F.when(F.col("value_count") > 0, F.kll_sketch_get_quantile_double("sketch", grid))
        return states.select("column_name", some.alias(name))

    def share(of: str, value: Column) -> Column:
        return F.size(F.filter(of, lambda x: x <= value)) / F.lit(GRID)

    both = side(before, "x").join(side(after, "y"), "column_name", "full")
    distances = F.transform(F.concat("x", "y"), lambda v: F.abs(share("x", v) - share("y", v)))
    return both.select("column_name", F.array_max(distances).alias("drift"))
