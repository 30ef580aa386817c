"""Events of one correlation ID, and the service chains of all of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import is_error
from ..functions.privacy import mask_text
from ..session import lookup_join, materialize
from .parse import events_of, issues_of
from .summary import first_rows

TRACE_ORDER = ["timestamp", "source", "line_number"]
MAX_TRACE_EVENTS = 100_000


@dataclass(frozen=True)
class TraceReport:
    """``summary`` has one row; ``events`` at most the requested number."""

    summary: DataFrame
    events: DataFrame


def filter_correlation(events: DataFrame, correlation_id: str) -> DataFrame:
    if not correlation_id.strip():
        raise ValueError("correlation ID must not be empty")
    return events.where(F.col("correlation_id") == correlation_id)


def trace_events(events: DataFrame, correlation_id: str, max_events: int = 1000) -> DataFrame:
    """The first events of one correlation ID in time order, masked."""
    if not 1 <= max_events <= MAX_TRACE_EVENTS:
        raise ValueError(f"max_events must be between 1 and {MAX_TRACE_EVENTS}")
    first = first_rows(filter_correlation(events, correlation_id), TRACE_ORDER, max_events)
    return first.select(
        "timestamp",
        "service",
        "level",
        mask_text(F.col("message")).alias("message"),
        "source",
        "line_number",
    )


def trace_correlation(
    records: DataFrame, correlation_id: str, max_events: int = 1000
) -> TraceReport:
    """Trace one correlation ID; ``service_chain`` covers the returned events."""
    malformed = issues_of(records).agg(F.count("*")).scalar()
    return trace_report(events_of(records), malformed, correlation_id, max_events)


def trace_report(
    events: DataFrame, malformed: Column, correlation_id: str, max_events: int = 1000
) -> TraceReport:
    """The same from events, and the number of malformed lines beside them."""
    returned = trace_events(events, correlation_id, max_events)
    hops = F.array_sort(F.collect_list(F.struct(*TRACE_ORDER, "service")))
    matched = filter_correlation(events, correlation_id).agg(F.count("*")).scalar()
    summary = (
        returned.agg(F.count("*").alias("returned_events"), hops.alias("_hops"))
        .withColumn("matched_events", matched)
        .select(
            F.lit(correlation_id).alias("correlation_id"),
            "matched_events",
            "returned_events",
            (F.col("matched_events") > F.col("returned_events")).alias("truncated"),
            F.transform(
                F.filter(
                    "_hops",
                    lambda hop, index: (index == 0)
                    | (F.get("_hops", index - 1)["service"] != hop["service"]),
                ),
                lambda hop: hop["service"],
            ).alias("service_chain"),
            malformed.alias("malformed_lines"),
        )
    )
    return TraceReport(summary, returned.orderBy(*TRACE_ORDER))


def trace_spans(events: DataFrame) -> DataFrame:
    """First and last time, events and errors of every correlation ID."""
    known = events.where(F.col("correlation_id") != "")
    return known.groupBy("correlation_id").agg(
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.count("*").alias("events"),
        F.count_if(is_error(F.col("level"))).alias("errors"),
    )


def service_chains(events: DataFrame) -> DataFrame:
    """Steps of every correlation ID: a row per change of service, numbered.

    Rows are cut into pieces by ranges of (ID, time, position), so an ID of any
    size is spread over tasks. The pieces are stored, as the ranges are sampled.
    What crosses a cut is the last service and the number of steps before it: one
    row per cut.
    """
    rows = events.where(F.col("correlation_id") != "").select(
        "correlation_id", *TRACE_ORDER, "service"
    )
    cut = rows.repartitionByRange("correlation_id", *TRACE_ORDER)
    pieces = materialize(cut.withColumn("_piece", F.spark_partition_id()), "chain-pieces")

    key = ["_piece", "correlation_id"]
    in_piece = Window.partitionBy(*key).orderBy(*TRACE_ORDER)
    over_pieces = Window.partitionBy("correlation_id").orderBy("_piece")
    earlier = over_pieces.rowsBetween(Window.unboundedPreceding, -1)

    position = F.struct(*TRACE_ORDER)
    carried = (
        pieces.groupBy(*key)
        .agg(F.max_by("service", position).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(over_pieces))
        .where(F.col("_carried").isNotNull())
        .select(*key, "_carried")
    )
    moved = lookup_join(
        pieces.withColumn("_previous", F.lag("service").over(in_piece)),
        materialize(carried, "chain-carried"),
        key,
        position,
    )
    before = F.coalesce("_previous", "_carried")
    steps = moved.where(before.isNull() | (before != F.col("service"))).withColumn(
        "_step", F.row_number().over(in_piece)
    )
    offsets = (
        steps.groupBy(*key)
        .agg(F.count("*").alias("_steps"))
        .withColumn("_offset", F.sum("_steps").over(earlier))
        .where(F.col("_offset") > 0)
        .select(*key, "_offset")
    )
    numbered = lookup_join(steps, materialize(offsets, "chain-offsets"), key, position)
    return numbered.select(
        "correlation_id",
        (F.col("_step") + F.coalesce("_offset", F.lit(0))).alias("step"),
        "service",
        *TRACE_ORDER,
    )
