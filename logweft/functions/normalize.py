"""Message normalisation and fingerprints for error grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EMPTY_MESSAGE, FINGERPRINT_LENGTH, NORMALIZE_RULES
from .privacy import mask_text
from .text import replace_all, starting_with

# Characters a match can start with, tested before the costlier word borders.
_FIRST = {
    "uuid": "0-9a-f",
    "timestamp": r"\d",
    "hex": "0-9a-f",
    "keyed_id": "a-z_",
    "number": r"\-\d",
}
_RULES = {
    name: (starting_with(_FIRST[name], pattern), replacement)
    for name, pattern, replacement in NORMALIZE_RULES
}


def normalize_rule(value: Column, name: str) -> Column:
    """Apply one normalisation rule."""
    return replace_all(value, *_RULES[name])


def replace_uuid(value: Column) -> Column:
    return normalize_rule(value, "uuid")


def replace_timestamp(value: Column) -> Column:
    return normalize_rule(value, "timestamp")


def replace_hex(value: Column) -> Column:
    return normalize_rule(value, "hex")


def replace_keyed_id(value: Column) -> Column:
    return normalize_rule(value, "keyed_id")


def replace_number(value: Column) -> Column:
    return normalize_rule(value, "number")


def normalize_masked(masked: Column) -> Column:
    """Normalise a message that is masked already."""
    replaced = reduce(normalize_rule, _RULES, F.lower(masked))
    collapsed = F.trim(replace_all(replaced, r"\s+", " "))
    # Not by a comparison, which would have all rules applied once more.
    return F.coalesce(F.regexp_replace(collapsed, r"\A\z", EMPTY_MESSAGE), F.lit(EMPTY_MESSAGE))


def normalize_message(message: Column) -> Column:
    """Mask, lower-case and replace the variable parts of a message."""
    return normalize_masked(mask_text(message))


def fingerprint_normalized(normalized: Column) -> Column:
    return F.left(F.sha2(normalized, 256), F.lit(FINGERPRINT_LENGTH))


def fingerprint_message(message: Column) -> Column:
    """Stable short hash of the normalised message."""
    return fingerprint_normalized(normalize_message(message))
