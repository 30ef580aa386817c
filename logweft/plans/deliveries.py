"""Analysis of logs that arrive in deliveries: every file is parsed once.

A store is a folder on a file system that all executors share. ``add_delivery`` reads the
files that the store does not know yet and keeps what reports need of them, in tables that
merge: cells of the cube, counts by correlation ID, the first examples of every error
group, the first dead letters, and, if asked, the events. ``analyze_store`` merges the
tables of all deliveries; its report equals that of one pass over all files in the order
of their deliveries.

The ledger says which files are in, and which part of the store holds them. A delivery
writes its part first and then one ledger file, which appears at once; only parts in the
ledger are read. A delivery that dies in between therefore has no effect: the next one
reads its files again. What it left behind, and what compaction replaced, goes with
``sweep_store``. One writer at a time: a file that two writers read at once is found in the
ledger twice, and every report refuses such a store.

Events are kept in order of correlation ID, time and position, cut by ranges of all of
them, so an ID with a third of all events lies in many files. ``trace_store`` finds an ID by
a pushed filter, the limits of the row groups and a Bloom filter.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import CUBE_KEYS, count_cells, merge_cells, summary_cube
from ..operators.errors import error_examples, merge_examples
from ..operators.parse import events_of, issues_of
from ..operators.summary import first_rows, issue_samples
from ..operators.trace import TRACE_ORDER, TraceReport, trace_report
from ..schema import EVENT_SCHEMA, AnalyzeOptions
from ..session import materialize
from ..sources.lines import files_table, list_files
from ..sources.records import read_records
from .analyze import AnalysisReport, report_of

LEDGER = (
    "delivery long, part string, replaces array<string>, source string, size long, modified timestamp, "
    "positions long, window_minutes int, issue_sample_limit int, default_timezone string, has_events boolean"
)
_SETTINGS = ["window_minutes", "issue_sample_limit", "default_timezone", "has_events"]
_CELL = "n long, first_seen timestamp_ntz, last_seen timestamp_ntz, first_arrival long"
TABLES = {
    "cells": f"bucket timestamp_ntz, level string, service string, normalized_message string, {_CELL}",
    "correlations": f"correlation_id string, {_CELL}",
    "examples": "normalized_message string, example string, first_arrival long",
    "issues": "source string, line_number long, arrival long, reason string, preview string",
    "events": EVENT_SCHEMA,
}


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def ledger(spark: SparkSession, store: str) -> DataFrame:
    """All entries: a row per file of a delivery, and a row without file per compaction."""
    path, files = _file_system(spark, f"{store}/ledger")
    if not files.exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{store}/ledger")


def _parts(entries: DataFrame) -> list[dict]:
    """The parts that hold the store, one per delivery or compaction, in order."""
    replaced = entries.select(F.explode("replaces").alias("part"))
    rows = entries.join(replaced, "part", "left_anti").groupBy("part", *_SETTINGS)
    first = rows.agg(F.min("delivery").alias("delivery"))
    return sorted((row.asDict() for row in first.collect()), key=lambda row: row["delivery"])


def _settings(parts: list[dict]) -> dict:
    """What all parts have in common; they could not be merged otherwise."""
    found = {tuple(part[name] for name in _SETTINGS) for part in parts}
    if len(found) > 1:
        raise ValueError("the deliveries of this store were made with different settings")
    return dict(zip(_SETTINGS, found.pop(), strict=True)) if found else {}


def _stored(spark: SparkSession, store: str, parts: list[dict], table: str) -> DataFrame:
    folders = [f"{store}/parts/{part['part']}/{table}" for part in parts]
    return spark.read.schema(TABLES[table]).parquet(*folders)


def _merged(spark: SparkSession, store: str, parts: list[dict]) -> dict[str, DataFrame]:
    tables = {name: _stored(spark, store, parts, name) for name in TABLES if name != "events"}
    return {
        "cells": merge_cells(tables["cells"], *CUBE_KEYS),
        "correlations": merge_cells(tables["correlations"], "correlation_id"),
        "examples": tables["examples"],
        "issues": tables["issues"],
    }


def _write_part(spark: SparkSession, store: str, tables: dict[str, DataFrame]) -> str:
    part = uuid.uuid4().hex
    for name, rows in tables.items():
        if name == "events":
            rows = rows.repartitionByRange("correlation_id", *TRACE_ORDER)
            rows = rows.sortWithinPartitions("correlation_id", *TRACE_ORDER)
        writer = rows.write.option("parquet.bloom.filter.enabled#correlation_id", str(name == "events").lower())
        writer.parquet(f"{store}/parts/{part}/{name}")
    return part


def _enter(spark: SparkSession, store: str, rows: DataFrame) -> None:
    """Add entries as one file, which is there as a whole or not at all."""
    columns = spark.createDataFrame([], LEDGER).columns
    rows.select(*columns).coalesce(1).write.mode("append").parquet(f"{store}/ledger")


def _listing(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source, ordinal, size and time of change of the input files, empty ones included."""
    found = files_table(spark, list_files(spark, paths))
    listed = [paths] if isinstance(paths, str) else list(paths)
    sizes = spark.read.format("binaryFile").load(listed).select(
        F.regexp_replace("path", "^([a-z0-9+.-]+):///", "$1:/").alias("source"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )
    return found.join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))


def add_delivery(
    spark: SparkSession,
    store: str,
    paths: str | list[str],
    options: AnalyzeOptions | None = None,
    log_format: str | None = None,
    keep_events: bool = False,
) -> int:
    """Read the files that ``store`` does not know yet; how many these are.

    The time zone, the window length, the number of dead letters and ``keep_events`` are
    the same for all deliveries of a store. A known file that has changed is an error:
    its lines are counted already.
    """
    options = options or AnalyzeOptions()
    entries = materialize(ledger(spark, store), "ledger")
    wanted = (options.window_minutes, options.issue_sample_limit, options.default_timezone, keep_events)
    parts = _parts(entries)
    if parts and tuple(_settings(parts).values()) != wanted:
        raise ValueError("the earlier deliveries of this store were made with other settings")

    known = entries.where(F.col("source").isNotNull()).select(
        "source", F.col("size").alias("known_size"), F.col("modified").alias("known_modified")
    )
    listing = materialize(_listing(spark, paths).join(known, "source", "left"), "listing")
    is_known = F.col("known_size").isNotNull()
    same = (F.col("size") == F.col("known_size")) & F.col("modified").eqNullSafe(F.col("known_modified"))
    changed = listing.where(is_known & ~same).select("source").first()
    if changed is not None:
        raise ValueError(f"a file changed after it was read: {changed['source']}")
    new = listing.where(~is_known)
    # As many paths as Spark itself lists on the driver to read them.
    sources = [row["source"] for row in new.orderBy("ordinal").select("source").collect()]
    if not sources:
        return 0

    last = entries.agg(F.max("delivery"), F.sum("positions")).first()
    number, before = (last[0] or 0) + 1, last[1] or 0
    escaped = [re.sub(r"([\[\]{}*?\\])", r"\\\1", source) for source in sources]
    records = read_records(spark, escaped, options.default_timezone, log_format)
    end = records.agg(F.max("arrival")).first()[0] or 0
    records = records.withColumn("arrival", F.col("arrival") + before)
    events = events_of(records)
    tables = {
        "cells": summary_cube(records, options.window_minutes),
        "correlations": count_cells(events.where(F.col("correlation_id") != ""), "correlation_id"),
        "examples": error_examples(events).select("normalized_message", "example", "first_arrival"),
        "issues": issue_samples(issues_of(records), options.issue_sample_limit),
    }
    if keep_events:
        tables["events"] = events.select(*EVENT_SCHEMA.fieldNames())
    part = _write_part(spark, store, tables)
    entry = {
        "delivery": F.lit(number).cast("long"),
        "part": F.lit(part),
        "replaces": F.array().cast("array<string>"),
        # Counted once, whatever the number of files.
        "positions": F.when(F.col("source") == sources[0], F.lit(end)).otherwise(0).cast("long"),
    }
    entry |= dict(zip(_SETTINGS, map(F.lit, wanted), strict=True))
    _enter(spark, store, new.withColumns(entry))
    return len(sources)


def _checked_parts(spark: SparkSession, store: str) -> list[dict]:
    entries = ledger(spark, store)
    parts = _parts(entries)
    if not parts:
        raise ValueError(f"no delivery in {store}")
    files = entries.where(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("n"))
    twice = files.where(F.col("n") > 1).first()
    if twice is not None:
        raise ValueError(f"a file was read by two deliveries: {twice['source']}")
    return parts


def analyze_store(
    spark: SparkSession, store: str, options: AnalyzeOptions | None = None
) -> AnalysisReport:
    """The report over all deliveries. No text is read; the caps apply to all of it."""
    options = options or AnalyzeOptions()
    parts = _checked_parts(spark, store)
    settings = _settings(parts)
    if options.window_minutes != settings["window_minutes"]:
        raise ValueError(f"this store has windows of {settings['window_minutes']} minutes")
    if options.issue_sample_limit > settings["issue_sample_limit"]:
        raise ValueError(f"this store keeps {settings['issue_sample_limit']} dead letters of a delivery")
    tables = _merged(spark, store, parts)

    def examples(groups: DataFrame) -> DataFrame:
        wanted = groups.select("normalized_message")
        return merge_examples(tables["examples"].join(wanted, "normalized_message", "left_semi"))

    return report_of(
        materialize(tables["cells"], "cube"),
        tables["correlations"],
        examples,
        first_rows(tables["issues"], ["arrival"], options.issue_sample_limit),
        options,
    )


def trace_store(
    spark: SparkSession, store: str, correlation_id: str, max_events: int = 1000
) -> TraceReport:
    """Trace an ID in a store that keeps events, reading only what can hold the ID."""
    parts = _checked_parts(spark, store)
    if not _settings(parts)["has_events"]:
        raise ValueError("this store does not keep events")
    cells = _stored(spark, store, parts, "cells")
    malformed = cells.where(F.col("level").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return trace_report(_stored(spark, store, parts, "events"), malformed, correlation_id, max_events)


def compact_store(spark: SparkSession, store: str) -> None:
    """Replace the parts of all deliveries by one. The report stays the same.

    Readers that have begun still find the old parts, until ``sweep_store``.
    """
    parts = _checked_parts(spark, store)
    if len(parts) == 1:
        return
    settings = _settings(parts)
    tables = _merged(spark, store, parts)
    tables["examples"] = merge_examples(tables["examples"]).select("normalized_message", "example", "first_arrival")
    tables["issues"] = first_rows(tables["issues"], ["arrival"], settings["issue_sample_limit"])
    if settings["has_events"]:
        tables["events"] = _stored(spark, store, parts, "events")
    part = _write_part(spark, store, tables)
    entry = [(parts[-1]["delivery"], part, [p["part"] for p in parts], None, None, None, 0, *settings.values())]
    _enter(spark, store, spark.createDataFrame(entry, LEDGER))


def sweep_store(spark: SparkSession, store: str) -> int:
    """Delete parts that no report will read; how many. No delivery may be under way."""
    active = {part["part"] for part in _parts(ledger(spark, store))}
    path, files = _file_system(spark, f"{store}/parts")
    gone = 0
    for status in files.listStatus(path) if files.exists(path) else []:
        if status.getPath().getName() not in active:
            files.delete(status.getPath(), True)
            gone += 1
    return gone
