"""Masking of personal data and credentials as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MASK_RULES, PREVIEW_CHARS, UNICODE
from .text import let, replace_all, starting_with

# Characters a match can start with, tested before the costlier word borders.
_FIRST = {"bearer_token": "b", "api_key": "as", "ipv4": r"\d", "phone": r"+\d"}
_RULES = {
    name: (starting_with(_FIRST.get(name), pattern), replacement)
    for name, pattern, replacement in MASK_RULES
}


def mask_rule(value: Column, name: str) -> Column:
    """Apply one masking rule."""
    if name == "email":
        # Without the sign there is nothing to search for.
        return let(
            value,
            lambda text: F.when(text.contains("@"), replace_all(text, *_RULES[name])).otherwise(text),
        )
    return replace_all(value, *_RULES[name])


def mask_bearer(value: Column) -> Column:
    return mask_rule(value, "bearer_token")


def mask_api_key(value: Column) -> Column:
    return mask_rule(value, "api_key")


def mask_email(value: Column) -> Column:
    return mask_rule(value, "email")


def mask_ipv4(value: Column) -> Column:
    return mask_rule(value, "ipv4")


def mask_phone(value: Column) -> Column:
    return mask_rule(value, "phone")


def mask_text(value: Column) -> Column:
    """Apply all masking rules in order."""
    return reduce(mask_rule, _RULES, value)


def find_sensitive_types(value: Column) -> Column:
    """Names of the rules that match the unmasked text, in rule order."""
    hits = [
        F.when(F.rlike(value, F.lit(UNICODE + pattern)), F.lit(name))
        for name, (pattern, _) in _RULES.items()
    ]
    return F.array_compact(F.array(*hits))


def issue_preview(value: Column) -> Column:
    """One-line preview; the cut comes before the masking."""
    return mask_text(F.left(F.translate(value, "\r\n", "  "), F.lit(PREVIEW_CHARS)))
