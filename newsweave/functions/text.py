"""Small text expressions used everywhere."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes, for equal trimming.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def or_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def present(text: Column) -> Column:
    """True when the text has anything in it; null counts as nothing.

    Written so that, as a filter on a plain column, it reaches the scan.
    """
    return text.isNotNull() & (text != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def first_of(items: Column) -> Column:
    """First element, or null when the array is empty or null."""
    return F.try_element_at(items, F.lit(1))


def preview(text: Column, size: int) -> Column:
    """The first ``size`` characters, with an ellipsis when text was cut."""
    body = or_blank(text)
    return F.concat(
        F.substring(body, 1, size), F.when(F.length(body) > size, "...").otherwise("")
    )
