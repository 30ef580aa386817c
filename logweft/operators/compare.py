"""Comparison of two periods.

Both periods go through one pass, with the period as one more key of the cells.
Everything below works on tables of the size of the error groups or services.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import is_error
from ..functions.normalize import fingerprint_normalized
from .cells import count_cells, error_cells, merge_cells, ratio, with_cube_keys

BASELINE, CURRENT = "baseline", "current"
DEFAULT_TOP = 10


def tag_periods(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of both periods with a ``period`` column."""
    return baseline.withColumn("period", F.lit(BASELINE)).unionByName(
        current.withColumn("period", F.lit(CURRENT))
    )


def period_cells(tagged: DataFrame) -> DataFrame:
    return count_cells(
        with_cube_keys(tagged), "period", "level", "service", "normalized_message"
    )


def _in(period: str, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(F.col("period") == period, value)), F.lit(0))


def compare_summary(cells: DataFrame) -> DataFrame:
    """One row: totals, errors and rates of both periods and their differences."""
    parsed = F.when(F.col("level").isNotNull(), F.col("n"))
    errors = F.when(is_error(F.col("level")), F.col("n"))
    counted = cells.agg(
        _in(BASELINE, parsed).alias("baseline_total"),
        _in(CURRENT, parsed).alias("current_total"),
        _in(BASELINE, errors).alias("baseline_errors"),
        _in(CURRENT, errors).alias("current_errors"),
    )
    rated = counted.withColumns(
        {
            f"{period}_error_rate": ratio(F.col(f"{period}_errors"), F.col(f"{period}_total"))
            for period in (BASELINE, CURRENT)
        }
    )
    return rated.withColumns(
        {
            "total_delta": F.col("current_total") - F.col("baseline_total"),
            "error_delta": F.col("current_errors") - F.col("baseline_errors"),
            "error_rate_delta": F.bround(
                F.col("current_error_rate") - F.col("baseline_error_rate"), 6
            ),
        }
    )


def _ranked(counted: DataFrame, *order: Column | str) -> DataFrame:
    by_count = Window.partitionBy("period").orderBy(F.desc("n"), *order)
    return counted.withColumn("_rank", F.row_number().over(by_count))


def period_groups(cells: DataFrame, top: int | None = DEFAULT_TOP) -> DataFrame:
    """Error groups of each period: the ``top`` largest, or all."""
    groups = merge_cells(error_cells(cells), "period", "normalized_message").withColumn(
        "fingerprint", fingerprint_normalized(F.col("normalized_message"))
    )
    if top is not None:
        groups = _ranked(groups, "fingerprint").where(F.col("_rank") <= top)
    return groups.select("period", "fingerprint", "normalized_message", "n")


def _present(period: str) -> Column:
    return F.max((F.col("period") == period).cast("int")) == 1


def _only_in(period: str, other: str, cells: DataFrame, top: int | None) -> DataFrame:
    groups = period_groups(cells, top).groupBy("fingerprint", "normalized_message")
    flagged = groups.agg(_present(period).alias("_here"), _present(other).alias("_there"))
    return (
        flagged.where(F.col("_here") & ~F.col("_there"))
        .select("fingerprint", "normalized_message")
        .orderBy("fingerprint")
    )


def new_errors(cells: DataFrame, top: int | None = DEFAULT_TOP) -> DataFrame:
    """Groups among the current top errors but not among the baseline's."""
    return _only_in(CURRENT, BASELINE, cells, top)


def resolved_errors(cells: DataFrame, top: int | None = DEFAULT_TOP) -> DataFrame:
    """Groups among the baseline's top errors but not among the current ones."""
    return _only_in(BASELINE, CURRENT, cells, top)


def service_error_deltas(cells: DataFrame, top: int | None = DEFAULT_TOP) -> DataFrame:
    """Difference in errors of the services in either period's top list."""
    counted = merge_cells(error_cells(cells), "period", "service")
    if top is not None:
        counted = _ranked(counted, "first_arrival").where(F.col("_rank") <= top)
    return (
        counted.groupBy("service")
        .agg((_in(CURRENT, F.col("n")) - _in(BASELINE, F.col("n"))).alias("error_delta"))
        .orderBy("service")
    )


def error_changes(cells: DataFrame) -> DataFrame:
    """All groups of both periods with their counts and what became of them."""
    counted = (
        period_groups(cells, None)
        .groupBy("fingerprint", "normalized_message")
        .agg(
            _in(BASELINE, F.col("n")).alias("baseline_count"),
            _in(CURRENT, F.col("n")).alias("current_count"),
        )
    )
    delta = F.col("current_count") - F.col("baseline_count")
    change = (
        F.when(F.col("baseline_count") == 0, "new")
        .when(F.col("current_count") == 0, "resolved")
        .when(delta > 0, "increasing")
        .when(delta < 0, "decreasing")
        .otherwise("unchanged")
    )
    return counted.withColumn("delta", delta).withColumn("change", change)
