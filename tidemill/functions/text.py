"""Tolerant text conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.spec import NO_DATE

# Every character Unicode-aware stripping removes, not only the ASCII blanks.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(col, F.lit(WHITESPACE))


def has_only_spaces(col: Column) -> Column:
    """Whether the text is ASCII with the space as its only whitespace.

    Trimming spaces is several times cheaper than `strip` and does the same for any part
    of such a text, so per-line work asks this once and picks `strip_within` by it.
    """
    plain = F.length(col) == F.octet_length(col)
    for blank in WHITESPACE:
        if blank != " " and blank.isascii():
            plain = plain & ~col.contains(blank)
    return plain


def strip_within(col: Column, only_spaces: Column) -> Column:
    """`strip` for a part of a text whose `has_only_spaces` is known."""
    return F.when(only_spaces, F.trim(col)).otherwise(strip(col))


def after(col: Column, separator: str) -> Column:
    """Text behind the first `separator`; meaningful only where it occurs."""
    return F.substr(col, F.instr(col, F.lit(separator)) + F.lit(len(separator)))


def integer_or_null(col: Column) -> Column:
    """A whole number with optional sign and digit-group underscores, else NULL."""
    text = strip(col)
    plain = F.when(text.contains("_"), F.regexp_replace(text, "(?<=[0-9])_(?=[0-9])", "")).otherwise(text)
    return plain.try_cast("bigint")


def lenient_bigint(col: Column) -> Column:
    """Whole number after dropping thousands commas; anything else, or nothing, is 0."""
    return F.coalesce(integer_or_null(F.replace(col, F.lit(","), F.lit(""))), F.lit(0).cast("bigint"))


def partition_day(col: Column) -> Column:
    """A stripped ten-character value, else the fallback day. Only the length is checked."""
    day = strip(col)
    return F.when(F.length(day) == 10, day).otherwise(F.lit(NO_DATE))


def on_or_after(day: Column, as_of: Column) -> Column:
    """Text day at or past a date; unreadable days never qualify (nor fail the query)."""
    return F.try_to_date(day, "yyyy-MM-dd") >= as_of
