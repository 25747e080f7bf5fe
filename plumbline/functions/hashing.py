"""Fixed-width stand-ins for keys of any width."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.parsing import is_fractional


def key_value(value: Column, kind: T.DataType) -> Column:
    """The value as it is compared with others: -0.0 becomes 0.0, both are one key."""
    return value + F.lit(0.0).cast(kind) if is_fractional(kind) else value


def holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(holds_map(f.dataType) for f in kind.fields)
    return False


def key_hashes(values: Sequence[Column], kinds: Sequence[T.DataType]) -> tuple[Column, Column]:
    """Two hashes of a key, equal for equal keys.

    A null leaves a hash as it is, so which values are null is hashed as well. Maps have no hash
    in Spark and take part as a list of entries in the order of their keys.
    """
    hashable = [
        F.to_json(F.array_sort(F.map_entries(value))) if isinstance(kind, T.MapType)
        else F.to_json(F.array(value)) if holds_map(kind)
        else value
        for value, kind in zip(values, kinds, strict=True)
    ]
    nulls = F.struct(*[value.isNull() for value in values])
    return F.xxhash64(*hashable, nulls), F.xxhash64(nulls, *reversed(hashable))
