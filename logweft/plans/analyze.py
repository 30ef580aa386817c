"""The reports: analysis of one set of records, and comparison of two."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.caps import dropped_count, first_seen_cap
from ..operators.cells import count_cells, error_cells, summary_cube
from ..operators.compare import (
    DEFAULT_TOP,
    compare_summary,
    error_changes,
    new_errors,
    period_cells,
    resolved_errors,
    service_error_deltas,
    tag_periods,
)
from ..operators.detection import detect_anomalies, detect_bursts
from ..operators.errors import error_examples, error_groups, services_per_group, with_examples, with_services
from ..operators.parse import events_of, issues_of
from ..operators.quality import anomaly_gate, parse_gate, regression_gate
from ..operators.summary import (
    errors_by_service,
    issue_samples,
    levels_count,
    summary_counts,
    top_k,
    window_stats,
)
from ..schema import AnalyzeOptions
from ..session import materialize
from ..sources.records import read_records


@dataclass(frozen=True)
class AnalysisReport:
    """Tables of one analysis. ``summary`` and ``dropped`` have one row each."""

    summary: DataFrame
    levels: DataFrame
    errors_by_service: DataFrame
    top_errors: DataFrame
    top_error_services: DataFrame
    top_correlations: DataFrame
    windows: DataFrame
    bursts: DataFrame
    anomalies: DataFrame
    dropped: DataFrame
    issue_samples: DataFrame
    gates: DataFrame


@dataclass(frozen=True)
class ComparisonReport:
    """Tables of one comparison. ``summary`` has one row."""

    summary: DataFrame
    new_errors: DataFrame
    resolved_errors: DataFrame
    service_error_deltas: DataFrame
    error_changes: DataFrame
    gates: DataFrame


def analyze(records: DataFrame, options: AnalyzeOptions | None = None) -> AnalysisReport:
    """All reports over ``records``.

    One pass makes the cube, which is stored; the small tables come from it. Only
    correlation IDs, examples of the top groups and issue samples go back to the
    records, each reading its own few columns.
    """
    options = options or AnalyzeOptions()
    events = events_of(records)
    return report_of(
        materialize(summary_cube(records, options.window_minutes), "cube"),
        count_cells(events.where(F.col("correlation_id") != ""), "correlation_id"),
        lambda groups: error_examples(events, groups),
        issue_samples(issues_of(records), options.issue_sample_limit),
        options,
    )


def report_of(
    cube: DataFrame,
    correlations: DataFrame,
    examples: Callable[[DataFrame], DataFrame],
    samples: DataFrame,
    options: AnalyzeOptions,
) -> AnalysisReport:
    """The report from its parts: stored cells of the cube, cells by correlation ID, the
    examples of given groups, and the first dead letters."""
    errors = error_cells(cube)
    windows = materialize(window_stats(first_seen_cap(cube, "bucket", options.max_windows)), "windows")
    groups = materialize(
        error_groups(
            first_seen_cap(errors, "normalized_message", options.max_error_groups), options.top
        ),
        "top-errors",
    )
    top_cells = errors.join(groups.select("normalized_message"), "normalized_message", "left_semi")
    services = services_per_group(top_cells)
    summary = summary_counts(cube)
    anomalies = detect_anomalies(windows, options.anomaly_zscore)
    dropped = dropped_count(errors, "normalized_message", options.max_error_groups).select(
        F.col("dropped").alias("dropped_error_groups"),
        dropped_count(cube, "bucket", options.max_windows).scalar().alias("dropped_windows"),
    )
    return AnalysisReport(
        summary=summary,
        levels=levels_count(cube),
        errors_by_service=errors_by_service(
            first_seen_cap(errors, "service", options.max_services), options.top
        ),
        top_errors=with_examples(with_services(groups, services), examples(groups)),
        top_error_services=services.orderBy("fingerprint", F.desc("count"), "first_arrival"),
        top_correlations=top_k(
            first_seen_cap(correlations, "correlation_id", options.max_correlations),
            "correlation_id",
            options.top,
        ),
        windows=windows.orderBy("start"),
        bursts=detect_bursts(windows, options.burst_threshold).orderBy("start"),
        anomalies=anomalies.orderBy("start"),
        dropped=dropped,
        issue_samples=samples,
        gates=parse_gate(summary).unionByName(anomaly_gate(anomalies)),
    )


def compare(
    baseline: DataFrame, current: DataFrame, top: int | None = DEFAULT_TOP
) -> ComparisonReport:
    """Differences between two sets of records, in one pass over both.

    New and resolved errors and services are among the ``top`` largest of each period,
    among all if it is None.
    """
    columns = ["timestamp", "level", "service", "message", "arrival"]
    tagged = tag_periods(baseline.select(columns), current.select(columns))
    cells = materialize(period_cells(tagged.where(F.col("level").isNotNull())), "periods")
    summary = compare_summary(cells)
    return ComparisonReport(
        summary=summary,
        new_errors=new_errors(cells, top),
        resolved_errors=resolved_errors(cells, top),
        service_error_deltas=service_error_deltas(cells, top),
        error_changes=error_changes(cells),
        gates=regression_gate(summary),
    )


def analyze_files(
    spark: SparkSession,
    paths: str | list[str],
    options: AnalyzeOptions | None = None,
    log_format: str | None = None,
) -> AnalysisReport:
    options = options or AnalyzeOptions()
    records = read_records(spark, paths, options.default_timezone, log_format)
    return analyze(records, options)


def compare_files(
    spark: SparkSession,
    baseline: str | list[str],
    current: str | list[str],
    default_timezone: str = "UTC",
    top: int | None = DEFAULT_TOP,
) -> ComparisonReport:
    return compare(
        read_records(spark, baseline, default_timezone),
        read_records(spark, current, default_timezone),
        top,
    )


def write_report(report, folder: str, fmt: str = "json", mode: str = "error") -> None:
    """Write every table of a report to its own sub-folder."""
    for field in fields(report):
        table = getattr(report, field.name)
        table.write.mode(mode).format(fmt).save(f"{folder}/{field.name}")
