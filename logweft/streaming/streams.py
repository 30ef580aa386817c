"""Structured Streaming: parsing, windowed counts and redaction of arriving logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fields import is_error
from ..functions.timestamps import instant_to_utc, utc_to_instant
from ..operators.cells import ratio
from ..operators.parse import json_records, plain_records
from ..operators.redact import redact

_PARSERS = {"plain": plain_records, "jsonl": json_records}


def stream_lines(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New files of a folder as lines."""
    text = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    return text.select(
        F.make_valid_utf8("value").alias("value"), F.col("_metadata.file_path").alias("source")
    )


def stream_records(
    spark: SparkSession, folder: str, log_format: str = "jsonl", default_timezone: str = "UTC"
) -> DataFrame:
    """Records of arriving lines; they have no line numbers."""
    return _PARSERS[log_format](stream_lines(spark, folder), default_timezone)


def _start(
    stream: DataFrame, fmt: str, target: str, checkpoint: str, every: str | None, *partitions: str
) -> StreamingQuery:
    """Without ``every``, what has arrived is handled and the query ends."""
    writer = stream.writeStream.format(fmt).outputMode("append").partitionBy(*partitions)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start(target)


def write_records(
    records: DataFrame, target: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Store records once, with events and dead letters in separate partitions.

    ``every`` is the interval of a query that goes on, such as "1 minute".
    """
    marked = records.withColumn("malformed", F.col("reason").isNotNull())
    return _start(marked, "parquet", target, checkpoint, every, "malformed")


def stored_records(spark: SparkSession, target: str) -> DataFrame:
    """What ``write_records`` stored; a filter on ``malformed`` prunes partitions."""
    stored = spark.read.parquet(target)
    return stored.withColumn("malformed", F.col("malformed").cast("boolean"))


def stream_windows(
    events: DataFrame, window_minutes: int = 5, watermark: str = "1 hour"
) -> DataFrame:
    """Counts per bucket, emitted when the watermark closes the bucket.

    ``window_minutes`` must divide 60: only then are epoch-aligned windows the
    same as buckets by minute of the hour.
    """
    if 60 % window_minutes:
        raise ValueError("window_minutes must divide 60 in a stream")
    bucket = F.window("_instant", f"{window_minutes} minutes")
    counted = (
        events.withColumn("_instant", utc_to_instant(F.col("timestamp")))
        .withWatermark("_instant", watermark)
        .groupBy(bucket)
        .agg(
            F.count("*").alias("total"),
            F.count_if(is_error(F.col("level"))).alias("errors"),
        )
    )
    return counted.select(
        instant_to_utc(F.col("window.start")).alias("start"),
        "total",
        "errors",
        ratio(F.col("errors"), F.col("total")).alias("error_rate"),
    )


def stream_bursts(windows: DataFrame, threshold: int = 10) -> DataFrame:
    return windows.where(F.col("errors") >= threshold)


def write_windows(
    windows: DataFrame, target: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    return _start(windows, "parquet", target, checkpoint, every)


def write_redacted(
    lines: DataFrame, target: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Masked copy of arriving lines as text."""
    return _start(redact(lines.select("value")), "text", target, checkpoint, every)
