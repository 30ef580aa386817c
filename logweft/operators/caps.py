"""Cardinality caps: the first keys by arrival are kept, later ones dropped.

A key is never evicted, so it is kept exactly if its first arrival ranks within
the capacity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import merge_cells

RANGE_BITS = 20


def first_seen_keys(cells: DataFrame, key: str, capacity: int) -> DataFrame:
    """The kept keys with their counts.

    The place of a key is its place among the keys of its range of arrivals, which
    holds at most ``2 ** RANGE_BITS`` of them, plus the keys of earlier ranges.
    """
    keys = merge_cells(cells.where(F.col(key).isNotNull()), key).withColumn(
        "_range", F.shiftright("first_arrival", RANGE_BITS)
    )
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = keys.groupBy("_range").agg(F.count("*").alias("_keys"))
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_keys").over(earlier), F.lit(0)))
    needed = ranges.where(F.col("_before") < capacity).select("_range", "_before")
    place = F.row_number().over(Window.partitionBy("_range").orderBy("first_arrival"))
    placed = keys.join(needed, "_range").withColumn("_place", F.col("_before") + place)
    return placed.where(F.col("_place") <= capacity).drop("_range", "_before", "_place")


def first_seen_cap(cells: DataFrame, key: str, capacity: int | None) -> DataFrame:
    """Cells of kept keys only; all cells if there is no capacity."""
    if capacity is None:
        return cells
    return cells.join(first_seen_keys(cells, key, capacity).select(key), key, "left_semi")


def dropped_count(cells: DataFrame, key: str, capacity: int | None) -> DataFrame:
    """One row: the number of events whose key was not kept."""
    if capacity is None:
        return cells.limit(0).agg(F.count("*").alias("dropped"))
    present = cells.where(F.col(key).isNotNull())
    kept = first_seen_keys(cells, key, capacity).agg(F.sum("n").alias("n")).scalar()
    return present.agg(
        (F.coalesce(F.sum("n"), F.lit(0)) - F.coalesce(kept, F.lit(0))).alias("dropped")
    )
