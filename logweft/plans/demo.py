"""Generated demo events, and writers of log files in all formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (
    DEMO_ERROR_MESSAGES,
    DEMO_NORMAL_MESSAGES,
    DEMO_SERVICES,
    DEMO_START,
)

DEMO_COLUMNS = ["timestamp", "level", "service", "correlation_id", "message"]


def _draw(seed: int, name: str, index: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the row only."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), index.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _choose(options: list[str], draw: Column) -> Column:
    place = F.floor(draw * len(options)).cast("int") + 1
    return F.element_at(F.array(*(F.lit(option) for option in options)), place)


def demo_events(rows: DataFrame, lines: int, seed: int = 42) -> DataFrame:
    """Demo events for rows with an ``index`` from 0 to ``lines - 1``.

    Services take turns, five rows share a correlation ID, rows are two seconds
    apart, 7 % are errors (5 % of them critical), 8 % of the others warnings, and
    a burst of errors starts in the middle.
    """
    index = F.col("index")
    half = lines // 2
    burst = (index >= half) & (index < min(lines, half + max(20, lines // 50)))
    error = burst | (_draw(seed, "error", index) < 0.07)
    level = F.when(
        error, F.when(_draw(seed, "level", index) < 0.05, "CRITICAL").otherwise("ERROR")
    ).otherwise(F.when(_draw(seed, "level", index) < 0.08, "WARNING").otherwise("INFO"))
    draw = _draw(seed, "message", index)
    failure = F.replace(
        _choose(DEMO_ERROR_MESSAGES, draw), F.lit("{id}"), (index + 100_000).cast("string")
    )
    shares = len(DEMO_SERVICES)
    service = F.element_at(
        F.array(*(F.lit(name) for name in DEMO_SERVICES)), (index % shares).cast("int") + 1
    )
    request = F.lpad(F.floor(index / shares).cast("string"), 8, "0")
    start = F.lit(DEMO_START).cast("timestamp_ntz")
    return rows.select(
        "index",
        F.timestamp_add("SECOND", index * 2, start).alias("timestamp"),
        level.alias("level"),
        service.alias("service"),
        F.concat(F.lit("demo-"), request).alias("correlation_id"),
        F.when(error, failure).otherwise(_choose(DEMO_NORMAL_MESSAGES, draw)).alias("message"),
    )


def iso_text(timestamp: Column) -> Column:
    return F.concat(F.replace(timestamp.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def plain_line(events: DataFrame) -> Column:
    """One line of text per event, with its pairs after the level."""
    return F.concat_ws(
        " ",
        iso_text(F.col("timestamp")),
        "level",
        F.concat(F.lit("service="), "service"),
        F.concat(F.lit("correlation_id="), "correlation_id"),
        "message",
    )


def write_logs(
    events: DataFrame,
    destination: str,
    log_format: str = "jsonl",
    gzip_output: bool = False,
    mode: str = "error",
) -> None:
    """Write events as log files, one per partition, in row order."""
    texts = events.select(
        iso_text(F.col("timestamp")).alias("timestamp"), *DEMO_COLUMNS[1:]
    )
    compression = "gzip" if gzip_output else "none"
    if log_format == "plain":
        lines = events.select(plain_line(events).alias("value"))
        lines.write.mode(mode).text(destination, compression=compression)
    elif log_format == "jsonl":
        texts.write.mode(mode).json(destination, compression=compression)
    elif log_format == "csv":
        texts.write.mode(mode).csv(
            destination, header=True, compression=compression, escape='"'
        )
    else:
        raise ValueError("format must be plain, jsonl, or csv")


def generate_demo(
    spark: SparkSession,
    destination: str,
    lines: int = 1000,
    log_format: str = "jsonl",
    seed: int = 42,
    gzip_output: bool = False,
) -> str:
    """Write ``lines`` demo events as log files and return the folder."""
    if lines < 1:
        raise ValueError("lines must be at least 1")
    events = demo_events(spark.range(lines).withColumnRenamed("id", "index"), lines, seed)
    write_logs(events, destination, log_format, gzip_output)
    return destination
