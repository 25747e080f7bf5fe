"""How many different values columns have, from sketches that merge, or exactly.

A sketch (HyperLogLog) of one column takes 2 ** lg_k bytes at most, whatever the column holds. All columns
are sketched in one pass without a shuffle of data; sketches of parts, whether files, days or slices, merge
to that of the whole, so they can be stored. The relative standard error is about 1.04 / sqrt(2 ** lg_k),
1.6% at the default. NaN is missing, -0.0 is 0.0, and nulls don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import key_hashes, key_value
from plumbline.plans.table import Table

LG_K = 12
STATE = "column_name string, position int, non_null_count bigint, sketch binary"


def _hashes(table: Table) -> list[Column]:
    """A hash of each column's value, null where it is missing."""
    out = []
    for i, kind in enumerate(table.kinds):
        value = F.col(f"c{i}")
        hashed, _ = key_hashes([key_value(value, kind)], [kind])
        out.append(F.when(value.isNotNull(), hashed))
    return out


def distinct_states(df: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """column_name, position, non_null_count and sketch of every column; one pass."""
    if not 4 <= lg_k <= 21:
        raise ValueError("lg_k is from 4 to 21")
    table = Table.of(df)
    if not table.names:
        return df.sparkSession.createDataFrame([], STATE)
    hashes = _hashes(table)
    one_row = table.frame.select(*[h.alias(f"h{i}") for i, h in enumerate(hashes)]).agg(
        *[F.hll_sketch_agg(f"h{i}", lg_k).alias(f"s{i}") for i in range(len(hashes))],
        *[F.count(f"h{i}").alias(f"n{i}") for i in range(len(hashes))],
    )
    rows = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(i).alias("position"),
            F.col(f"n{i}").alias("non_null_count"),
            F.col(f"s{i}").alias("sketch"),
        )
        for i, name in enumerate(table.names)
    ]
    return one_row.select(F.inline(F.array(*rows)))


def merge_distinct(states: DataFrame) -> DataFrame:
    """The states of the whole from states of its parts."""
    return states.groupBy("column_name", "position").agg(
        F.sum("non_null_count").alias("non_null_count"),
        F.hll_union_agg("sketch", F.lit(True)).alias("sketch"),
    )


def estimates(states: DataFrame, dataset: str = "dataset") -> DataFrame:
    """dataset, column_name, position, non_null_count and distinct_count, an estimate.

    It is at most the number of values.
    """
    estimate = F.least(F.hll_sketch_estimate("sketch"), F.col("non_null_count"))
    return states.select(
        F.lit(dataset).alias("dataset"), "column_name", "position", "non_null_count",
        F.coalesce(estimate, F.lit(0)).cast("long").alias("distinct_count"),
    )


def distinct_counts(
    df: DataFrame, dataset: str = "dataset", exact: bool = False, lg_k: int = LG_K
) -> DataFrame:
    """Different values of each column, estimated from sketches or, if ``exact``, counted.

    Counting sends a hash for each different value of each column and task; different values are told
    apart by two hashes of 64 bits.
    """
    if not exact:
        return estimates(distinct_states(df, lg_k), dataset)
    table = Table.of(df)
    if not table.names:
        return estimates(distinct_states(df, lg_k), dataset)
    entries = []
    for i, kind in enumerate(table.kinds):
        value = F.col(f"c{i}")
        one, other = key_hashes([key_value(value, kind)], [kind])
        present = value.isNotNull()
        entries.append(
            F.struct(
                F.lit(i).alias("position"), present.alias("present"),
                F.when(present, one).alias("one"), F.when(present, other).alias("other"),
            )
        )
    values = table.frame.select(F.inline(F.array(*entries)))
    counted = values.groupBy("position", "present", "one", "other").agg(F.count(F.lit(1)).alias("n"))
    by_column = counted.groupBy("position").agg(
        F.coalesce(F.sum(F.when(F.col("present"), F.col("n"))), F.lit(0)).alias("non_null_count"),
        F.count_if("present").alias("distinct_count"),
    )
    # Columns are few; without rows each still has its line.
    names = df.sparkSession.createDataFrame(list(enumerate(table.names)), "position int, column_name string")
    return F.broadcast(names).join(by_column, "position", "left").select(
        F.lit(dataset).alias("dataset"), "column_name", "position",
        F.coalesce("non_null_count", F.lit(0)).cast("long").alias("non_null_count"),
        F.coalesce("distinct_count", F.lit(0)).cast("long").alias("distinct_count"),
    )


def free_text(df: DataFrame, max_distinct: int, lg_k: int = LG_K) -> list[str]:
    """Columns of more different values than a distribution should have rows, by estimate."""
    found = distinct_counts(df, lg_k=lg_k).filter(F.col("distinct_count") > max_distinct)
    return [row.column_name for row in found.orderBy("position").collect()]
