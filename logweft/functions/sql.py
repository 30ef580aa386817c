"""The text functions for SQL users, as SQL functions without Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..constants import EMPTY_MESSAGE, FINGERPRINT_LENGTH, MASK_RULES, NORMALIZE_RULES, UNICODE


def _replaced(value: str, rules: list[tuple[str, str, str]]) -> str:
    for _, pattern, replacement in rules:
        literal = (UNICODE + pattern).replace("\\", "\\\\").replace("'", "\\'")
        value = f"regexp_replace({value}, '{literal}', '{replacement}')"
    return value


def register_functions(spark: SparkSession) -> None:
    """Create temporary functions mask_text, normalize_message, fingerprint_message."""
    bodies = {
        "mask_text": _replaced("text", MASK_RULES),
        "normalize_message": (
            "coalesce(nullif(trim(regexp_replace("
            f"{_replaced('lower(mask_text(text))', NORMALIZE_RULES)}, "
            f"'{UNICODE}\\\\s+', ' ')), ''), '{EMPTY_MESSAGE}')"
        ),
        "fingerprint_message": f"left(sha2(normalize_message(text), 256), {FINGERPRINT_LENGTH})",
    }
    for name, body in bodies.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS STRING RETURN {body}"
        )
