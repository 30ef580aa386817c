"""Streams over the files of the application log, run until all files are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import new_path
from ..streaming import streams
from .common import (
    WINDOW_MINUTES,
    WINDOWS,
    broken_folder,
    json_folder,
    query,
    rendered,
    sql_app,
    sql_mask,
    write_lines,
)


@query(
    "stream_parse",
    sql_app(
        "SELECT malformed, level, count(*) AS records FROM (SELECT event_id % 50 < 8 AS malformed, "
        "CASE WHEN event_id % 50 >= 8 THEN level END AS level FROM app) GROUP BY 1, 2"
    ),
)
def stream_parse(spark, sf_dir):
    records = streams.stream_records(spark, broken_folder(spark, sf_dir))
    target = new_path(spark, "stream-records")
    streams.write_records(records, target, new_path(spark, "stream-state")).awaitTermination()
    stored = streams.stored_records(spark, target)
    return stored.groupBy("malformed", "level").agg(F.count("*").alias("records"))


@query(
    "stream_windows",
    sql_app(
        "SELECT * FROM windows WHERE start + INTERVAL 2 HOUR <= (SELECT max(\"timestamp\") FROM app)",
        WINDOWS,
    ),
)
def stream_windows(spark, sf_dir):
    """Buckets that the watermark has closed."""
    records = streams.stream_records(spark, json_folder(spark, sf_dir))
    counted = streams.stream_windows(records.where(F.col("reason").isNull()), WINDOW_MINUTES)
    target = new_path(spark, "stream-windows")
    streams.write_windows(counted, target, new_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(target)


@query("stream_redact", sql_app(f"SELECT {sql_mask('message')} AS value FROM app"))
def stream_redact(spark, sf_dir):
    folder = rendered(spark, sf_dir, "messages", write_lines(F.col("message")))
    target = new_path(spark, "stream-redacted")
    lines = streams.stream_lines(spark, folder)
    streams.write_redacted(lines, target, new_path(spark, "stream-state")).awaitTermination()
    return spark.read.text(target).select("value")
