"""Extraction of the canonical fields from plain text and from key/value rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ERROR_LEVELS, FIELD_ALIASES, KEY_VALUE, LEVEL_WORDS, UNICODE
from .text import blank_to_null, is_filled, replace_all, strip

# Only these letters can start a pair: a cheap test at each character of a line.
_PAIR = "(?i)(?=[sactr])" + KEY_VALUE

_KNOWN_KEYS = [alias for aliases in FIELD_ALIASES.values() for alias in aliases]

# Stands between the keys of a row while they are normalised as one text.
_BETWEEN = "\x01"


def parse_level(word: Column) -> Column:
    """Normalised level of a level word, NULL if the word is unknown."""
    table = F.create_map(*(F.lit(text) for pair in LEVEL_WORDS.items() for text in pair))
    return F.try_element_at(table, F.upper(strip(word)))


def is_error(level: Column) -> Column:
    return level.isin(ERROR_LEVELS)


def normalized_key(key: Column) -> Column:
    return F.replace(F.lower(strip(key)), F.lit(" "), F.lit("_"))


def reversed_keys(keys: Column) -> Column:
    """Normalised keys, last one first: a search then finds the last duplicate."""
    return F.transform(F.reverse(keys), normalized_key)


def with_reversed_keys(rows: DataFrame, keys: Column, name: str) -> DataFrame:
    """Add ``reversed_keys(keys)`` as a column.

    Keys of visible ASCII and spaces, as in nearly all rows, are normalised as one text,
    without a function call for each. That none of them holds the mark between them shows
    in their number.
    """
    joined = F.col("_joined")
    spaced = F.btrim(F.regexp_replace(joined, f" *{_BETWEEN} *", _BETWEEN), F.lit(" "))
    tight = F.when(joined.contains(" "), F.replace(spaced, F.lit(" "), F.lit("_"))).otherwise(joined)
    simple = F.rlike(joined, F.lit(rf"\A[ -~{_BETWEEN}]*+\z"))
    # Steps of their own, as the later ones use the earlier ones many times.
    steps = (
        rows.withColumn("_turned", F.reverse(keys))
        .withColumn("_joined", F.lower(F.array_join("_turned", _BETWEEN)))
        .withColumn("_parts", F.when(simple, F.split(tight, _BETWEEN)))
    )
    each = F.transform("_turned", normalized_key)
    found = F.when(F.size("_parts") == F.size("_turned"), F.col("_parts")).otherwise(each)
    return steps.withColumn(name, found).drop("_turned", "_joined", "_parts")


def blanks_to_null(values: Column) -> Column:
    return F.transform(values, lambda value: F.when(is_filled(value), value))


def pick_field(keys: Column, values: Column, field: str) -> Column:
    """First usable value of a field, in the order of its aliases.

    ``keys`` and ``values`` are parallel arrays as made by ``reversed_keys`` and
    ``blanks_to_null``.
    """
    found = [
        F.get(values, (F.array_position(keys, alias) - 1).cast("int"))
        for alias in FIELD_ALIASES[field]
    ]
    return F.coalesce(*found)


def extra_keys(keys: Column) -> Column:
    """The keys that belong to no canonical field, each once, in the order of the row."""
    known = F.array(*map(F.lit, _KNOWN_KEYS), F.lit(None).cast("string"))
    return F.reverse(F.array_except(keys, known))


def extra_fields(names: Column, keys: Column, values: Column) -> Column:
    """Map of ``names``, the ``extra_keys`` of a row, to their last values."""
    found = F.transform(names, lambda name: F.get(values, (F.array_position(keys, name) - 1).cast("int")))
    return F.map_from_arrays(names, found)


def extract_pairs(tail: Column) -> Column:
    """``key=value`` pairs of a plain line's tail as an array of (key, value)."""

    def split_pair(pair: Column) -> Column:
        key = F.regexp_extract(pair, "^[^=:]+", 0)
        value = F.regexp_replace(pair, "^[^=:]+[=:]", "")
        return F.struct(
            F.lower(key).alias("key"), F.btrim(value, F.lit("\"'")).alias("value")
        )

    return F.transform(F.regexp_extract_all(tail, F.lit(UNICODE + _PAIR), F.lit(0)), split_pair)


def last_value(pairs: Column, field: str) -> Column:
    """Value of the last pair whose key is an alias of ``field``."""
    matching = F.filter(pairs, lambda pair: pair["key"].isin(FIELD_ALIASES[field]))
    return F.try_element_at(matching, F.lit(-1))["value"]


def strip_pairs(tail: Column) -> Column:
    """Message text of a plain line: the tail without its pairs."""
    message = F.btrim(replace_all(tail, _PAIR, " "), F.lit(" |-:"))
    return F.coalesce(blank_to_null(message), tail)
