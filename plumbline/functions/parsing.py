"""Strict reading of numbers and dates out of columns of any atomic type.

A plain cast is too generous ("1d", "2024", "now" all pass), so text must first match a pattern.
Every function yields null where the value is not acceptable and never raises on data.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import WHITESPACE, strip

# Fixed patterns: decimal or scientific notation or a signed infinity, and an ISO date with an
# optional time and zone.
NUMBER_PATTERN = (
    "[+-]?(?:(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)"
)
DATE_PATTERN = (
    "[0-9]{4}-[0-9]{2}-[0-9]{2}"
    "(?:[ T][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.][0-9]{1,9})?)?(?:Z|[+-][0-9]{2}:[0-9]{2})?)?"
)

# A number read as a date counts nanoseconds since 1970; beyond this it leaves the 64-bit range.
MAX_NANOSECONDS = 9.2233720368547758e18

TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def is_fractional(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def is_checkable(kind: T.DataType) -> bool:
    """Whether values of this type can be read as numbers, dates or boolean words."""
    return is_text(kind) or isinstance(kind, (T.NumericType, T.BooleanType, *TIME_TYPES))


def matching(text: Column, pattern: str) -> Column:
    """The text without surrounding whitespace where it matches the pattern, else the empty text.

    One reference to ``text`` keeps expressions built on this small when Catalyst inlines them.
    """
    return F.regexp_extract(text, f"^[{WHITESPACE}]*({pattern})[{WHITESPACE}]*$", 1)


def as_number(value: Column, kind: T.DataType) -> Column:
    """The value as a double, or null where it is no number."""
    if is_text(kind):
        return matching(value, NUMBER_PATTERN).try_cast("double")
    if isinstance(kind, TIME_TYPES):
        return F.unix_micros(value.cast("timestamp")).cast("double") * F.lit(1000.0)
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("double")
    return value.cast("double")


def as_timestamp(value: Column, kind: T.DataType, formats: tuple[str, ...] = ()) -> Column:
    """The value as a timestamp, or null where it is no date.

    ``formats`` adds patterns, tried in order, for text that is not an ISO date.
    """
    if is_text(kind):
        iso = matching(value, DATE_PATTERN).try_cast("timestamp")
        others = [F.try_to_timestamp(strip(value), F.lit(f)) for f in formats]
        return F.coalesce(iso, *others) if others else iso
    if isinstance(kind, TIME_TYPES):
        return value.cast("timestamp")
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("timestamp")
    nanoseconds = value.cast("double")
    return F.when(
        F.abs(nanoseconds) <= MAX_NANOSECONDS,
        F.timestamp_micros(F.floor(nanoseconds / 1000.0)),
    )
