"""Ready-made tables as event sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DEFAULT_SERVICE, FIELD_ALIASES
from ..functions.text import blank_to_null, strip
from ..functions.timestamps import instant_to_utc, local_to_utc
from ..operators.parse import finish_records


def alias_columns(df: DataFrame, field: str) -> list[str]:
    """Columns of a table whose names are aliases of ``field``, in alias order."""
    by_key = {name.strip().lower().replace(" ", "_"): name for name in df.columns}
    return [by_key[alias] for alias in FIELD_ALIASES[field] if alias in by_key]


def _as_time(df: DataFrame, default_timezone: str) -> Column | None:
    """The time column itself, if the table has just one and it is typed."""
    names = alias_columns(df, "timestamp")
    if len(names) != 1:
        return None
    column = F.col(f"`{names[0]}`")
    kind = df.schema[names[0]].dataType
    if isinstance(kind, T.TimestampType):
        return instant_to_utc(column)
    if isinstance(kind, T.TimestampNTZType):
        return local_to_utc(column, default_timezone)
    return None


def _as_text(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return instant_to_utc(column).cast("string")
    return column.cast("string")


def records_from_table(
    df: DataFrame,
    source: str,
    line_number: Column,
    default_timezone: str = "UTC",
) -> DataFrame:
    """Records of a table, with columns matched to fields by their names.

    ``line_number`` gives each row its position; it also serves as the arrival.
    """

    def usable(field: str) -> Column:
        texts = [_as_text(df, name) for name in alias_columns(df, field)]
        filled = [F.when(strip(text) != "", text) for text in texts]
        return F.coalesce(*filled) if filled else F.lit(None).cast("string")

    time = _as_time(df, default_timezone)
    typed = {} if time is None else {"_time": time}
    known = {name for field in FIELD_ALIASES for name in alias_columns(df, field)}
    extra = [name for name in df.columns if name not in known]
    pairs = [part for name in extra for part in (F.lit(name), _as_text(df, name))]
    found = df.select(
        F.lit(source).alias("source"),
        line_number.cast("bigint").alias("line_number"),
        usable("timestamp").alias("_time_text"),
        usable("level").alias("_level_text"),
        usable("service").alias("_service"),
        usable("message").alias("message"),
        usable("correlation_id").alias("_correlation"),
        *(column.alias(name) for name, column in typed.items()),
        (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).alias("fields"),
    )
    extracted = found.select(
        "source",
        "line_number",
        F.col("line_number").alias("arrival"),
        "_time_text",
        *typed,
        "_level_text",
        F.coalesce(strip(F.col("_service")), F.lit(DEFAULT_SERVICE)).alias("service"),
        "message",
        blank_to_null(strip(F.col("_correlation"))).alias("correlation_id"),
        "fields",
        F.coalesce(
            *(
                F.when(F.col(name).isNull(), F.lit(f"required field is missing: {field}"))
                for name, field in (
                    ("_time_text", "timestamp"),
                    ("_level_text", "level"),
                    ("message", "message"),
                )
            )
        ).alias("_shape_reason"),
        F.col("message").alias("_preview_text"),
    )
    return finish_records(extracted, default_timezone)
