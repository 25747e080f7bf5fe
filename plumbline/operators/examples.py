"""The first few offending values of every checked item, found in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.table import Scan

def first_offenders(
    scan: Scan,
    offences: Sequence[tuple[Column, Column]],
    row_id: Sequence[str],
    max_examples: int,
) -> DataFrame:
    """Rows ``(item, example_rank, row_label, value)``, item being the index into ``offences``.

    An offence is a pair of a condition and the text to show. Examples come in the order of the
    ``row_id`` columns, then by text. Candidates of one item are first thinned in as many random
    slices as there are shuffle partitions, so that an item violated by most rows of a huge table is
    never ranked in a single task; each task passes on its first few of every slice only.
    """
    scan.table.require(row_id, "row id")
    ids = [scan.table.column(name).alias(f"id_{i}") for i, name in enumerate(row_id)]
    id_names = [f"id_{i}" for i in range(len(row_id))]
    found = _offenders(scan, offences, ids).select(*id_names, "item", "value")
    slices = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = found.withColumn(
        "slice", F.pmod(F.xxhash64("item", "value", *id_names), F.lit(slices))
    )
    order = [*id_names, "value"]
    in_slice = Window.partitionBy("item", "slice").orderBy(*order)
    in_item = Window.partitionBy("item").orderBy(*order)
    label = (
        F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_names])
        if id_names
        else F.lit(None).cast("string")
    )
    return (
        sliced.withColumn("slice_rank", F.row_number().over(in_slice))
        .filter(F.col("slice_rank") <= max_examples)
        .withColumn("example_rank", F.row_number().over(in_item))
        .filter(F.col("example_rank") <= max_examples)
        .select("item", "example_rank", label.alias("row_label"), "value")
    )


def _offenders(
    scan: Scan, offences: Sequence[tuple[Column, Column]], ids: Sequence[Column]
) -> DataFrame:
    """A row per offending value: the ids, ``item`` and ``value``."""
    values = scan.row_values().select(
        *ids,
        *[offends.alias(f"offends_{item}") for item, (offends, _) in enumerate(offences)],
        *[text.alias(f"value_{item}") for item, (_, text) in enumerate(offences)],
    )
    # Dropping rows without any offence first would be slower: the conditions would move below the
    # projection that parses values once for all of them, and parse anew for each.
    entries = [
        F.struct(
            F.lit(item).alias("item"),
            F.col(f"offends_{item}").alias("offends"),
            F.col(f"value_{item}").alias("value"),
        )
        for item in range(len(offences))
    ]
    id_names = [name for name in values.columns if name.startswith("id_")]
    offenders = F.filter(F.array(*entries), lambda entry: entry["offends"])
    return values.select(*id_names, F.inline(offenders))


def pick(literals: Sequence[str | None]) -> Column:
    """The literal that belongs to the row's item."""
    return F.get(
        F.array(*[F.lit(v) for v in literals]).cast("array<string>"), F.col("item")
    )
