"""Bursts and statistical anomalies over window counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MIN_WINDOWS_FOR_ANOMALY


def detect_bursts(windows: DataFrame, threshold: int = 10) -> DataFrame:
    """Buckets with at least ``threshold`` errors."""
    return windows.where(F.col("errors") >= threshold).select(
        "start",
        "errors",
        F.col("errors").cast("double").alias("score"),
        F.lit(f"error count reached configured threshold ({threshold})").alias("reason"),
    )


def detect_anomalies(windows: DataFrame, zscore: float = 3.0) -> DataFrame:
    """Buckets whose errors lie ``zscore`` population deviations above the mean.

    The statistics are one row, used as a scalar subquery.
    """
    stats = windows.agg(
        F.struct(
            F.avg("errors").alias("mean"),
            F.stddev_pop("errors").alias("deviation"),
            F.count("*").alias("buckets"),
        ).alias("stats")
    ).scalar()
    scored = windows.withColumn("_stats", stats).withColumn(
        "_z",
        F.when(
            (F.col("_stats.buckets") >= MIN_WINDOWS_FOR_ANOMALY) & (F.col("_stats.deviation") > 0),
            (F.col("errors") - F.col("_stats.mean")) / F.col("_stats.deviation"),
        ),
    )
    return scored.where(F.col("_z") >= zscore).select(
        "start",
        "errors",
        F.bround("_z", 3).alias("score"),
        F.format_string("error count is %.2f standard deviations above the mean", "_z").alias(
            "reason"
        ),
    )
