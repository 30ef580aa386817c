"""The pre-aggregate from which the small report tables are derived.

A cell counts the rows that share some keys: ``n`` rows, their time span, and the
position of the first one. Cells merge into cells of fewer keys, so one pass over
the rows (with map-side combine) serves every report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import is_error
from ..functions.normalize import normalize_message

CUBE_KEYS = ["bucket", "level", "service", "normalized_message"]


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` to six decimals, 0 if there is nothing."""
    return F.coalesce(F.bround(F.try_divide(part, whole), 6), F.lit(0.0))


def window_start(timestamp: Column, minutes: int) -> Column:
    """Start of the bucket: the time minus its minute of the hour modulo ``minutes``.

    Buckets therefore restart every hour, and more than 60 minutes act as 60.
    """
    spent = F.make_dt_interval(
        F.lit(0),
        F.lit(0),
        F.minute(timestamp) % minutes,
        F.extract(F.lit("SECOND"), timestamp),
    )
    return timestamp - spent


def with_cube_keys(events: DataFrame, window_minutes: int = 5) -> DataFrame:
    """Add ``bucket`` and, for errors only, ``normalized_message``."""
    return events.withColumns(
        {
            "bucket": window_start(F.col("timestamp"), window_minutes),
            "normalized_message": F.when(
                is_error(F.col("level")), normalize_message(F.col("message"))
            ),
        }
    )


def count_cells(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.min("arrival").alias("first_arrival"),
    )


def merge_cells(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min("first_arrival").alias("first_arrival"),
    )


def error_cells(cells: DataFrame) -> DataFrame:
    return cells.where(is_error(F.col("level")))


def summary_cube(records: DataFrame, window_minutes: int = 5, *more_keys: str) -> DataFrame:
    """Cells by bucket, level, service and normalised error message.

    Dead letters, if ``records`` has any, form cells without a level.
    """
    keyed = with_cube_keys(records, window_minutes)
    return count_cells(keyed, *more_keys, *CUBE_KEYS)
