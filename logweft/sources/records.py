"""Log files of any supported format as one table of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import RECORD_COLUMNS, json_records, plain_records
from ..session import LINES_ROW_GROUP, materialize
from .csv_lines import csv_records
from .detect import FORMATS, format_of_name, name_has_format, name_needs_look, sniff_heads, suffix_format
from .lines import (
    checked_paths,
    chunk_counts,
    chunk_offsets,
    file_path,
    files_table,
    list_files,
    number_lines,
    read_lines,
)

_PARSERS = {"plain": plain_records, "jsonl": json_records}
_POSITION = ["source", "line_number", "arrival"]


def check_timezone(spark: SparkSession, zone: str) -> None:
    """Fail early, on the driver, if a time zone is unknown."""
    if zone.upper() == "UTC":
        return
    try:
        spark.sparkContext._jvm.java.time.ZoneId.of(zone)
    except Exception as error:
        raise ValueError(f"unknown default timezone: {zone}") from error


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def route_files(
    spark: SparkSession, paths: list[str], log_format: str | None, files: list[tuple[str, str]]
) -> tuple[dict[str, list[DataFrame]], DataFrame | None]:
    """Lines per format, and the heads of the files that had to be looked into.

    Files with a telling suffix are chosen by a filter on the file name, which
    prunes the listing, so that each file is read by one format only. So are the
    others once they have been looked into: tasks then share the text of one format by
    its size. Lines of CSV files are stored, as they are read several times.
    """
    if log_format is not None:
        if log_format not in FORMATS:
            raise ValueError(f"unknown log format: {log_format}")
        if log_format != "csv":
            return {log_format: [read_lines(spark, paths)]}, None
        stored = materialize(read_lines(spark, paths), "csv-lines", LINES_ROW_GROUP)
        return {"csv": [stored]}, materialize(sniff_heads(stored, "csv"), "file-heads")

    by_suffix = {format_of_name(name) for _, name in files}
    lines = {
        name: [read_lines(spark, paths, name_has_format(name))]
        for name in ("plain", "jsonl")
        if name in by_suffix
    }
    if by_suffix <= {"plain", "jsonl"}:
        return lines, None

    heads = materialize(sniff_heads(read_lines(spark, paths, name_needs_look())), "file-heads")
    # Files that were looked into, as many as the listing has at most.
    sources: dict[str, list[str]] = {}
    for row in heads.select("format", "source").collect():
        sources.setdefault(row["format"], []).append(row["source"])
    for name in sorted(sources):
        own = file_path().isin(sources[name]) if len(sources) > 1 else F.lit(True)
        part = read_lines(spark, paths, name_needs_look() & own)
        lines.setdefault(name, []).append(
            materialize(part, "csv-lines", LINES_ROW_GROUP) if name == "csv" else part
        )
    # Files without any line.
    nothing = read_lines(spark, paths).where(F.lit(False))
    lines.setdefault("csv" if "csv" in by_suffix else "plain", [nothing])
    return lines, heads


def _empty_csv_records(files: DataFrame, heads: DataFrame, log_format: str | None) -> DataFrame:
    """A dead letter for each CSV file without any line."""
    is_csv = suffix_format(F.col("file_name")) == "csv"
    return (
        files.where(F.lit(True) if log_format == "csv" else is_csv)
        .join(heads, "source", "left_anti")
        .select(
            "source",
            F.lit(1).cast("bigint").alias("line_number"),
            F.lit(0).cast("bigint").alias("arrival"),
            F.lit("CSV header is missing").alias("reason"),
            F.lit("").alias("preview"),
        )
    )


def read_records(
    spark: SparkSession,
    paths: str | list[str],
    default_timezone: str = "UTC",
    log_format: str | None = None,
    positions: bool = True,
) -> DataFrame:
    """Parse files into records: the event columns, ``reason`` and ``preview``.

    ``paths`` are files or folders; each file's format is found by itself unless
    ``log_format`` names it. The text is parsed once and stored by column in the
    shared folder, from where line numbers and all later steps read it. Without
    ``positions`` plain and JSON lines are not stored and have no numbers.
    """
    check_timezone(spark, default_timezone)
    listed = checked_paths(paths)
    found = list_files(spark, listed)
    files = files_table(spark, found)
    lines, heads = route_files(spark, listed, log_format, found)
    parsed = [
        parser(part, default_timezone)
        for name, parser in _PARSERS.items()
        for part in lines.get(name, [])
    ]
    columns = [*_POSITION, *RECORD_COLUMNS]
    if parsed and not positions and "csv" not in lines:
        unplaced = _union(parsed).withColumns(
            dict.fromkeys(("line_number", "arrival"), F.lit(None).cast("bigint"))
        )
        return unplaced.select(columns)

    line_rows = materialize(_union(parsed), "records") if parsed else None
    csv_lines = _union(lines["csv"]) if "csv" in lines else None
    counts = _union([chunk_counts(part) for part in (line_rows, csv_lines) if part is not None])
    offsets = materialize(chunk_offsets(counts, files), "offsets")
    records = []
    if line_rows is not None:
        records.append(number_lines(line_rows, offsets).select(columns))
    if csv_lines is not None:
        numbered = number_lines(csv_lines, offsets)
        rows = csv_records(numbered, heads.where(F.col("format") == "csv"), default_timezone)
        rows = rows.select(columns).unionByName(
            _empty_csv_records(files, heads, log_format), allowMissingColumns=True
        )
        records.append(materialize(rows, "csv-records"))
    return _union(records)
