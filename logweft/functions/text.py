"""Small string helpers shared by the other functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BLANKS, UNICODE


def _starts_visible(text: Column) -> Column:
    """Whether the first character is visible ASCII: a test of one byte."""
    return (text >= F.lit("!")) & (text < F.lit("\x7f"))


def strip(value: Column) -> Column:
    """Remove blanks of any kind from both ends.

    Few texts have any, and looking for all kinds is slow: a text that begins and ends
    with visible ASCII is left as it is.
    """
    text = value.cast("string")
    last = F.substring(text.cast("binary"), -1, 1)
    ends_visible = (last >= F.lit(b"!")) & (last <= F.lit(b"~"))
    return F.when(_starts_visible(text) & ends_visible, text).otherwise(F.btrim(text, F.lit(BLANKS)))


def is_filled(value: Column) -> Column:
    """Whether a text has more than blanks."""
    return _starts_visible(value) | (F.btrim(value, F.lit(BLANKS)) != "")


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def starting_with(characters: str | None, pattern: str) -> str:
    """The same pattern with a cheap test of the first character in front."""
    return f"(?i)(?=[{characters}]){pattern}" if characters else pattern


def replace_all(value: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(value, F.lit(UNICODE + pattern), F.lit(replacement))


def let(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), value, F.lit("'"))
