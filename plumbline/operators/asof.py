"""As-of joins: each row with the last row of another table up to its time.

Both tables are put in one, ordered by key and time, and cut into ranges of that order, so a key that fills
a third of the rows is spread over as many tasks as its rows ask for. Within a range the last row of the
right side is carried along. What a range has to know of those before it is the last right row of a key that
began there, and only a range's first key did: a table of at most two rows for each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import key_value
from plumbline.plans.storage import settle
from plumbline.plans.table import Table


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    by: Sequence[tuple[str, str]] = (),
    how: str = "left",
    suffix: str = "_right",
    partitions: int | None = None,
) -> DataFrame:
    """The columns of ``left``, and those of the last row of ``right`` with its time or an earlier one.

    ``by`` pairs key columns that have to be equal; nulls and NaN equal nothing, and rows without a time
    are never matched. Of right rows with one time the one with the greatest other columns, in their order,
    is taken. ``how`` is ``left`` or ``inner``. Right columns whose names ``left`` has get the suffix.
    """
    if how not in ("left", "inner"):
        raise ValueError("how is left or inner")
    mine, other = Table.of(left), Table.of(right)
    mine.require([left_time, *[a for a, _ in by]], "as-of join, left")
    other.require([right_time, *[b for _, b in by]], "as-of join, right")
    names = [*mine.names, *[n + suffix if n in mine.names else n for n in other.names]]
    if len(set(names)) < len(names):
        raise ValueError("columns of both sides have one name; choose another suffix")
    keys = [f"k{i}" for i in range(len(by))]

    def side(table: Table, time: str, chosen: list[str], number: int) -> DataFrame:
        values = [key_value(table.column(c), table.kind(c)).alias(k) for c, k in zip(chosen, keys, strict=True)]
        whole = F.struct(*[F.col(f"c{i}") for i in range(len(table.names))])
        return table.frame.select(
            *values, table.column(time).alias("t"), F.lit(number).alias("side"),
            whole.alias("l" if number else "r"),
        )

    ours = side(mine, left_time, [a for a, _ in by], 1)
    theirs = side(other, right_time, [b for _, b in by], 0)
    usable = F.lit(True)
    for column in (*keys, "t"):
        usable = usable & F.col(column).isNotNull()
    rows = theirs.filter(usable).unionByName(ours.filter(usable), allowMissingColumns=True)
    order = [*keys, "t", "side"]
    count = partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(count, *order).withColumn("part", F.spark_partition_id())
    dealt = settle(dealt)  # parts stay what they are, whichever task reads them

    last = F.max(F.when(F.col("side") == 0, F.struct("t", "r")))
    ends = dealt.groupBy(*keys, "part").agg(last.alias("last"))
    if keys:
        spread = dealt.groupBy(*keys).agg(F.min("part").alias("low"), F.max("part").alias("high"))
        spread = spread.filter("low < high").select(*keys)  # fewer than there are parts
        ends = ends.join(F.broadcast(spread), keys)
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = settle(ends.select(*keys, "part", F.max("last").over(before)["r"].alias("carried")))

    within = Window.partitionBy(*keys, "part").orderBy("t", "side", "r")
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = dealt.withColumn("seen", F.last("r", ignorenulls=True).over(so_far)).filter("side = 1")
    matched = known.join(F.broadcast(carried), [*keys, "part"], "left").select(
        "l", F.coalesce("seen", "carried").alias("r")
    )
    if how == "inner":
        matched = matched.filter(F.col("r").isNotNull())
    else:
        nothing = F.lit(None).cast(matched.schema["r"].dataType)
        matched = matched.unionByName(ours.filter(~usable).select("l", nothing.alias("r")))
    return matched.select(
        *[F.col("l")[f"c{i}"].alias(n) for i, n in enumerate(mine.names)],
        *[_field("r", i).alias(n) for i, n in enumerate(names[len(mine.names) :])],
    )


def _field(struct: str, i: int) -> Column:
    return F.col(struct)[f"c{i}"]
