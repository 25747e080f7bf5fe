"""Text clean-up as column expressions."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Python str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Words accepted as a boolean, compared in lower case.
BOOLEAN_WORDS = ("true", "false", "1", "0", "yes", "no", "y", "n")

# Fixed value: how a missing value is shown among examples.
MISSING_MARK = "<missing>"


def strip(text: Column) -> Column:
    """Text without surrounding whitespace; Spark's plain trim only removes spaces."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_one_of(text: Column, words: Sequence[str]) -> Column:
    """Whether the text is one of the words, which have no surrounding whitespace, apart from its own.

    Most values match as they are. Of the others only those that begin with a word are stripped, which
    looks at every character of a text.
    """
    return text.isin(*words) | _stripped_is_one_of(text, words, lambda value: value)


def is_boolean_word(text: Column) -> Column:
    return _stripped_is_one_of(text, BOOLEAN_WORDS, F.lower)


def _stripped_is_one_of(text: Column, words: Sequence[str], cased: Callable[[Column], Column]) -> Column:
    """``cased`` changes characters one by one."""
    longest = max(map(len, words), default=0)
    # A word and the character behind it, which is whitespace if the text is to be that word.
    begin = F.rtrim(F.substring(F.ltrim(text, F.lit(WHITESPACE)), 1, longest + 1), F.lit(WHITESPACE))
    return F.when(cased(begin).isin(*words), cased(strip(text)).isin(*words)).otherwise(
        F.when(text.isNotNull(), F.lit(False))
    )


def shown(text: Column) -> Column:
    """Text for display, with a mark in place of null."""
    return F.coalesce(text, F.lit(MISSING_MARK))
