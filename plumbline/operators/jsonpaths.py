"""What is within JSON text, variants and nested columns: a profile by path.

Values become variants, which are unfolded level by level in one plan; a row of the innermost level stands
for all nodes above it of which it is the first descendant, so every node is counted once and the table is
read once, after a first pass that finds how deep values go. What lies deeper than a plan should unfold is
written to the shared folder and unfolded from there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.parsing import NESTED_TYPES
from plumbline.plans.storage import scratch_path
from plumbline.plans.table import Table

#: Levels that one plan unfolds; each is a loop within the loop of the one above.
LEVELS = 6

#: Kinds of nodes, and the first words of the types of variants.
KINDS = {
    "object": ("OBJECT",),
    "array": ("ARRAY",),
    "string": ("STRING",),
    "boolean": ("BOOLEAN",),
    "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"),
}

# A name that would be mistaken for several steps is put in quotes.
_PLAIN = r"^[\p{L}\p{N}_-]+$"
_END = "end of the text"
_STRING = r'"(\\.|[^"\\])*+"'


def json_paths(df: DataFrame, column: str) -> DataFrame:
    """One row per path, with how often it occurs and with what kinds of values.

    ``$`` is the whole value, ``.name`` a member, ``[]`` any element of an array; names with other
    characters than letters, digits, ``_`` and ``-`` are written ``."name"``. ``node_count`` counts the
    places where the path is found, of which ``null_count`` hold JSON's null. ``other_count`` counts dates,
    times and binary values of nested columns. On ``$``, ``missing_count`` counts rows without a value and
    ``invalid_count`` those whose text is no JSON or names a member twice; both are no nodes. A table
    without rows has no paths.
    """
    table = Table.of(df)
    table.require([column], "JSON paths")
    value, kind = table.column(column), table.kind(column)
    if isinstance(kind, T.StringType):
        parsed = _strictly_parsed(value)
    elif isinstance(kind, T.VariantType):
        parsed = value
    elif isinstance(kind, NESTED_TYPES):
        parsed = F.to_variant_object(value)
    else:
        raise ValueError(f"{column!r} is neither text, a variant nor nested")
    state = F.when(value.isNull(), "missing").when(parsed.isNull(), "invalid").otherwise("node")
    rows = table.frame.select(F.lit("$").alias("path0"), parsed.alias("v0"), state.alias("state"))
    left, parts = _deepest(table.frame, value, parsed, kind), []
    while not parts or left > 0:
        here = min(left, LEVELS)
        unfolded = _unfold(rows, here)
        parts.append(_nodes(unfolded, here))
        left -= here
        if left > 0:
            rows = _deeper(unfolded, here)
    found = reduce(DataFrame.unionAll, parts)

    def count(*types: str) -> Column:
        return F.count_if(F.col("type").isin(*types))

    counts = {f"{kind}_count": count(*types) for kind, types in KINDS.items()}
    absent = count("missing", "invalid")
    known = count("VOID", "missing", "invalid", *[name for types in KINDS.values() for name in types])
    return found.groupBy("path").agg(
        (F.count(F.lit(1)) - absent).alias("node_count"),
        count("VOID").alias("null_count"),
        *[counted.alias(name) for name, counted in counts.items()],
        (F.count(F.lit(1)) - known).alias("other_count"),
        count("missing").alias("missing_count"),
        count("invalid").alias("invalid_count"),
    )


def _strictly_parsed(text: Column) -> Column:
    """The variant of a text that is one JSON value; null for others.

    Spark's parser ignores what follows the first value, so the text is read as the first of two elements.
    """
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    ends = F.try_variant_get(pair, "$[1]", "string") == _END
    more = F.try_variant_get(pair, "$[2]", "variant").isNotNull()
    return F.when(ends & ~more, F.try_variant_get(pair, "$[0]", "variant"))


def _unfold(rows: DataFrame, levels: int) -> DataFrame:
    """Below ``path0`` and ``v0``, the paths ``path1``, ... of the levels within, their types ``type0``,
    ..., and the values of the innermost.

    ``p1``, ... are the places of values in what holds them; all are null where there is nothing. A value
    goes once its members are there, so that a long one isn't copied for each of them.
    """
    rows = rows.withColumn("type0", _type("v0"))
    for level in range(1, levels + 1):
        inner = rows.sparkSession.tvf.variant_explode_outer(F.col(f"v{level - 1}").outer())
        name = F.col("name")
        step = (
            F.when(name.isNull(), "[]")
            .when(name.rlike(_PLAIN), F.concat(F.lit("."), name))
            .otherwise(F.concat(F.lit('."'), name, F.lit('"')))
        )
        rows = rows.lateralJoin(inner.toDF(f"p{level}", "name", f"v{level}"))
        rows = rows.withColumns(
            {f"path{level}": F.concat(f"path{level - 1}", step), f"type{level}": _type(f"v{level}")}
        ).drop("name", f"v{level - 1}")
    return rows


def _type(value: str) -> Column:
    """The first word of a variant's type."""
    return F.split(F.schema_of_variant(value), "[<(]")[0]


def _nodes(rows: DataFrame, levels: int) -> DataFrame:
    """``path`` and ``type`` of every node once; rows of the outermost say what they are in ``state``."""
    entries = []
    for level in range(levels + 1):
        counted = F.lit(True)
        for below in range(level + 1, levels + 1):
            counted = counted & (F.coalesce(F.col(f"p{below}"), F.lit(0)) == 0)
        kind = F.col(f"type{level}")
        if level:
            counted = counted & kind.isNotNull()
        else:
            counted = counted & (F.col("state") != "counted")
            kind = F.when(F.col("state") == "node", kind).otherwise(F.col("state"))
        node = F.struct(F.col(f"path{level}").alias("path"), kind.alias("type"))
        entries.append(F.when(counted, node))
    return rows.select(F.inline(F.array_compact(F.array(*entries))))


def _deeper(rows: DataFrame, level: int) -> DataFrame:
    """Objects and arrays of the innermost level, written down as the outermost of what follows."""
    inner = rows.filter(F.col(f"type{level}").isin("OBJECT", "ARRAY")).select(
        F.col(f"path{level}").alias("path0"),
        F.col(f"v{level}").alias("v0"),
        F.lit("counted").alias("state"),
    )
    path = scratch_path(rows.sparkSession, "json-values")
    inner.write.parquet(path)
    return rows.sparkSession.read.schema(inner.schema).parquet(path)


def _deepest(frame: DataFrame, value: Column, parsed: Column, kind: T.DataType) -> int:
    """How many levels are below the outermost values.

    Of text it is the most brackets that are open at once, outside strings; other types are written as text.
    """
    text = value if isinstance(kind, T.StringType) else F.to_json(value)
    brackets = F.regexp_replace(F.regexp_replace(text, _STRING, ""), r"[^\[\]{}]+", "")
    # Opening ones count 1 and closing ones -1; the greatest of all running sums is the depth.
    sums = F.aggregate(
        F.split(brackets, ""),
        F.struct(F.lit(0).alias("open"), F.lit(0).alias("most")),
        lambda so, c: F.struct(
            (so["open"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("open"),
            F.greatest(so["most"], so["open"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"),
        ),
        lambda so: so["most"],
    )
    return frame.agg(F.max(F.when(parsed.isNotNull(), sums))).first()[0] or 0
