"""Groups of similar errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EXAMPLES_PER_GROUP
from ..functions.normalize import fingerprint_normalized, normalize_masked
from ..functions.privacy import mask_text
from .cells import error_cells, merge_cells
from .summary import filter_errors


def _with_fingerprint(rows: DataFrame) -> DataFrame:
    """Hash after grouping: once per distinct message, not once per row."""
    return rows.withColumn("fingerprint", fingerprint_normalized(F.col("normalized_message")))


def error_groups(cells: DataFrame, top: int | None = None) -> DataFrame:
    """Groups by normalised message, largest first, then by fingerprint."""
    groups = _with_fingerprint(merge_cells(error_cells(cells), "normalized_message")).select(
        "fingerprint",
        "normalized_message",
        F.col("n").alias("count"),
        "first_seen",
        "last_seen",
    )
    ordered = groups.orderBy(F.desc("count"), "fingerprint")
    return ordered if top is None else ordered.limit(top)


def services_per_group(cells: DataFrame) -> DataFrame:
    """Errors of each group by service, one row per group and service."""
    counted = merge_cells(error_cells(cells), "normalized_message", "service")
    return _with_fingerprint(counted).select(
        "fingerprint", "normalized_message", "service", F.col("n").alias("count"), "first_arrival"
    )


def error_examples(
    events: DataFrame, groups: DataFrame | None = None, limit: int = EXAMPLES_PER_GROUP
) -> DataFrame:
    """The first distinct masked messages of each group.

    Repeats are combined before the shuffle on (group, message), which spreads a
    large group; only the first ``limit`` rows of a group and task go further.
    ``groups`` restricts the work to some groups (at most a report's top list).
    """
    masked = filter_errors(events).select("arrival", mask_text(F.col("message")).alias("example"))
    keyed = masked.withColumn("normalized_message", normalize_masked(F.col("example")))
    if groups is not None:
        wanted = groups.select("normalized_message")
        keyed = keyed.join(wanted, "normalized_message", "left_semi")
    return merge_examples(keyed.withColumnRenamed("arrival", "first_arrival"), limit)


def merge_examples(examples: DataFrame, limit: int = EXAMPLES_PER_GROUP) -> DataFrame:
    """The first distinct examples of each group, from those of any parts of the rows."""
    firsts = examples.groupBy("normalized_message", "example").agg(
        F.min("first_arrival").alias("first_arrival")
    )
    order = Window.partitionBy("normalized_message").orderBy("first_arrival")
    ranked = firsts.withColumn("example_number", F.row_number().over(order))
    return _with_fingerprint(ranked.where(F.col("example_number") <= limit)).select(
        "fingerprint", "normalized_message", "example_number", "example", "first_arrival"
    )


def with_services(groups: DataFrame, services: DataFrame) -> DataFrame:
    """Add the errors of each group by service as one map, most errors first, then by arrival."""
    order = F.array_sort(F.collect_list(F.struct(-F.col("count"), "first_arrival", "service", "count")))
    mapped = services.groupBy("fingerprint").agg(
        F.map_from_entries(F.transform(order, lambda x: F.struct(x["service"], x["count"]))).alias("services")
    )
    return groups.join(mapped, "fingerprint")


def with_examples(groups: DataFrame, examples: DataFrame) -> DataFrame:
    """Add the few examples of each group as one array, in order."""
    pairs = F.array_sort(F.collect_list(F.struct("example_number", "example")))
    listed = examples.groupBy("fingerprint").agg(
        F.transform(pairs, lambda pair: pair["example"]).alias("examples")
    )
    joined = groups.join(listed, "fingerprint")
    return joined.orderBy(F.desc("count"), "fingerprint")
