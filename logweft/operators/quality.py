"""Data quality per file, sensitive data profile, and pass/fail gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.privacy import find_sensitive_types, mask_text
from .parse import issues_of


@dataclass(frozen=True)
class ValidationReport:
    """``files``: a row per file; ``totals``: one row; ``issue_samples``: first issues."""

    files: DataFrame
    totals: DataFrame
    issue_samples: DataFrame


def valid_counts(records: DataFrame) -> DataFrame:
    """Valid and invalid records per source."""
    return records.groupBy("source").agg(
        F.count_if(F.col("reason").isNull()).alias("valid_lines"),
        F.count_if(F.col("reason").isNotNull()).alias("invalid_lines"),
    )


def samples_per_file(issues: DataFrame, limit: int = 20) -> DataFrame:
    """First dead letters of each file; each task keeps only ``limit`` per file."""
    order = Window.partitionBy("source").orderBy("line_number")
    ranked = issues.withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_rank") <= limit).select(
        "source", "line_number", "reason", mask_text(F.col("preview")).alias("preview")
    )


def validation_totals(files: DataFrame) -> DataFrame:
    counted = files.agg(
        F.coalesce(F.sum("valid_lines"), F.lit(0)).alias("valid_lines"),
        F.coalesce(F.sum("invalid_lines"), F.lit(0)).alias("invalid_lines"),
    )
    return counted.withColumn("is_valid", F.col("invalid_lines") == 0)


def validate_records(
    records: DataFrame, formats: DataFrame, sample_limit: int = 20
) -> ValidationReport:
    """``formats`` lists all files, so that empty ones show up with zeros."""
    counted = formats.join(valid_counts(records), "source", "left").select(
        "source",
        "format",
        F.coalesce("valid_lines", F.lit(0)).alias("valid_lines"),
        F.coalesce("invalid_lines", F.lit(0)).alias("invalid_lines"),
    )
    return ValidationReport(
        files=counted,
        totals=validation_totals(counted),
        issue_samples=samples_per_file(issues_of(records), sample_limit),
    )


def validate_files(
    spark: SparkSession,
    paths: str | list[str],
    default_timezone: str = "UTC",
    sample_limit: int = 20,
) -> ValidationReport:
    from ..sources.detect import detect_format
    from ..sources.records import read_records

    records = read_records(spark, paths, default_timezone)
    return validate_records(records, detect_format(spark, paths), sample_limit)


def sensitive_type_counts(rows: DataFrame, column: str) -> DataFrame:
    """Number of rows in which each kind of sensitive data occurs."""
    kinds = rows.select(F.explode(find_sensitive_types(F.col(column))).alias("sensitive_type"))
    return kinds.groupBy("sensitive_type").agg(F.count("*").alias("count"))


def _gate(name: Column, failed: Column, detail: Column) -> list[Column]:
    return [
        name.alias("gate"),
        (~failed).alias("passed"),
        F.when(failed, detail).alias("detail"),
    ]


def _count_gate(name: str, count: Column, text: str) -> list[Column]:
    return _gate(F.lit(name), count > 0, F.concat(count.cast("string"), F.lit(text)))


def parse_gate(summary: DataFrame) -> DataFrame:
    return summary.select(
        *_count_gate("parse-quality", F.col("malformed_lines"), " malformed lines")
    )


def anomaly_gate(anomalies: DataFrame) -> DataFrame:
    counted = anomalies.agg(F.count("*").alias("n"))
    return counted.select(
        *_count_gate("statistical-anomalies", F.col("n"), " anomalous windows")
    )


def validation_gates(files: DataFrame) -> DataFrame:
    invalid = F.col("invalid_lines")
    return files.select(
        *_gate(
            F.concat(F.lit("validate:"), "source"),
            invalid > 0,
            F.concat(invalid.cast("string"), F.lit(" invalid lines")),
        )
    )


def regression_gate(comparison: DataFrame) -> DataFrame:
    delta = F.col("error_delta")
    return comparison.select(
        *_gate(
            F.lit("error-regression"),
            delta > 0,
            F.concat(F.lit("error count increased by "), delta.cast("string")),
        )
    )


def trace_gate(trace: DataFrame) -> DataFrame:
    return trace.select(
        *_gate(
            F.concat(F.lit("trace:"), "correlation_id"),
            F.col("matched_events") == 0,
            F.lit("correlation ID was not found"),
        )
    )


def require(gates: DataFrame) -> None:
    """Raise if any gate failed, with their number and the first ones by name."""
    failed = gates.where(~F.col("passed"))
    count = failed.count()
    if count:
        named = [f"{row['gate']}: {row['detail']}" for row in failed.limit(20).collect()]
        raise RuntimeError(f"{count} gates failed: {'; '.join(named)}")
