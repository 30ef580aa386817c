"""Counts over events: totals, levels, services, correlations, windows, issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import is_error
from ..functions.privacy import mask_text
from .cells import count_cells, error_cells, merge_cells, ratio

LANES = 512


def filter_errors(events: DataFrame) -> DataFrame:
    return events.where(is_error(F.col("level")))


def summary_counts(cells: DataFrame) -> DataFrame:
    """One row of totals. Cells without a level are dead letters."""
    parsed = F.col("level").isNotNull()

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    counted = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_lines"),
        total(parsed).alias("parsed_lines"),
        total(~parsed).alias("malformed_lines"),
        total(is_error(F.col("level"))).alias("error_count"),
        F.min("first_seen").alias("first_timestamp"),
        F.max("last_seen").alias("last_timestamp"),
    )
    return counted.withColumn("error_rate", ratio(F.col("error_count"), F.col("parsed_lines")))


def first_rows(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows in an order, for rows spread over very many tasks.

    A plain limit sends ``limit`` rows of each task to one task. Here they first
    meet in ``LANES`` tasks, which pass on ``limit`` rows each.
    """
    lanes = rows.withColumn("_lane", F.spark_partition_id() % LANES)
    place = F.row_number().over(Window.partitionBy("_lane").orderBy(*order))
    few = lanes.withColumn("_place", place).where(F.col("_place") <= limit)
    return few.orderBy(*order).limit(limit).drop("_lane", "_place")


def top_k(counted: DataFrame, key: str, top: int | None) -> DataFrame:
    """Most frequent keys; the key that arrived first wins a tie."""
    ordered = counted.orderBy(F.desc("n"), "first_arrival")
    limited = ordered if top is None else ordered.limit(top)
    return limited.select(key, F.col("n").alias("count"))


def levels_count(cells: DataFrame) -> DataFrame:
    present = cells.where(F.col("level").isNotNull())
    return top_k(merge_cells(present, "level"), "level", None)


def errors_by_service(cells: DataFrame, top: int | None = 10) -> DataFrame:
    return top_k(merge_cells(error_cells(cells), "service"), "service", top)


def top_correlations(events: DataFrame, top: int | None = 10) -> DataFrame:
    """Most frequent correlation IDs over all events."""
    known = events.where(F.col("correlation_id") != "")
    return top_k(count_cells(known, "correlation_id"), "correlation_id", top)


def window_counts(cells: DataFrame) -> DataFrame:
    """Unsorted per-bucket counts with the position of the first event."""
    present = cells.where(F.col("level").isNotNull())
    return present.groupBy("bucket").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(is_error(F.col("level")), F.col("n"))), F.lit(0)).alias("errors"),
        F.min("first_arrival").alias("first_arrival"),
    )


def window_stats(cells: DataFrame) -> DataFrame:
    """Observed buckets, in no order: start, total, errors, error_rate."""
    return window_counts(cells).select(
        F.col("bucket").alias("start"),
        "total",
        "errors",
        ratio(F.col("errors"), F.col("total")).alias("error_rate"),
    )


def issue_counts(issues: DataFrame) -> DataFrame:
    """Dead letters per reason, without the values quoted in it."""
    kind = F.regexp_replace("reason", ": '.*", "")
    return issues.groupBy(kind.alias("reason")).agg(F.count("*").alias("count"))


def issue_samples(issues: DataFrame, limit: int = 20) -> DataFrame:
    """The first dead letters, with masked previews."""
    first = first_rows(issues, ["arrival"], limit)
    return first.withColumn("preview", mask_text(F.col("preview")))
