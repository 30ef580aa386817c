"""Text lines and their positions.

A line knows its file, the split it was read from and its running row key. Line
numbers need the number of lines before each chunk of rows; that is a small table
(one row per ``CHUNK_ROWS`` lines of a split), so that no line has to be shuffled.
"""

from __future__ import annotations

import itertools
import posixpath
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import lookup_join, materialize

CHUNK_BITS = 20
_CHUNK = ["source", "block_start", "chunk"]


def file_path() -> Column:
    """Readable path of the file a row comes from."""
    path = F.col("_metadata.file_path")
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(path.contains("%"), decoded).otherwise(path)


def checked_paths(paths: str | list[str]) -> list[str]:
    listed = [paths] if isinstance(paths, str) else [str(path) for path in paths]
    if not listed:
        raise ValueError("at least one input file is required")
    if len(set(listed)) < len(listed):
        raise ValueError("an input path is listed twice")
    return listed


def normal_path(path: str) -> str:
    """One spelling of a qualified path."""
    scheme, colon, rest = path.rpartition(":/")
    return scheme + colon + posixpath.normpath("/" + rest.lstrip("/"))[1:] if colon else posixpath.normpath(path)


def covers(folder: str, path: str) -> bool:
    """Whether ``path`` is ``folder`` itself or lies in it."""
    return path == folder or path.startswith(folder.rstrip("/") + "/")


def concrete_paths(spark: SparkSession, path: str) -> list[str]:
    """Qualified paths that an argument stands for; a pattern may stand for several."""
    parsed = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = parsed.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(system.makeQualified(parsed)) or []
    return [normal_path(status.getPath().toString()) for status in found]


def refuse_overlap(spark: SparkSession, paths: list[str]) -> None:
    """Raise if one file would be read by two arguments, in whatever spelling."""
    found = sorted(path.rstrip("/") + "/" for argument in paths for path in concrete_paths(spark, argument))
    for before, path in itertools.pairwise(found):
        if path.startswith(before):
            raise ValueError(f"an input path is listed twice: {path.rstrip('/')}")


def read_lines(
    spark: SparkSession, paths: str | list[str], files: Column | None = None
) -> DataFrame:
    """All lines of text files, plain or gzip, in UTF-8 with bad bytes replaced.

    ``files`` may choose files by a condition on ``_metadata``.
    """
    text = spark.read.text(checked_paths(paths))
    if files is not None:
        text = text.where(files)
    return text.select(
        F.make_valid_utf8("value").alias("value"),
        file_path().alias("source"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_key"),
    )


def list_files(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, str]]:
    """Path and name of each input file, empty ones included, in order: by the
    argument that names it, then by path.

    This is the listing that Spark itself keeps on the driver.
    """
    listed = checked_paths(paths)
    refuse_overlap(spark, listed)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    hadoop_conf = spark.sparkContext._jsc.hadoopConfiguration()

    def qualified(path: str) -> str:
        parsed = jvm_path(path)
        return parsed.getFileSystem(hadoop_conf).makeQualified(parsed).toString()

    arguments = {qualified(path): index for index, path in enumerate(listed)}

    def argument(source: str) -> int:
        parents = [source]
        while "/" in parents[-1]:
            parents.append(parents[-1].rsplit("/", 1)[0])
        return min((arguments[path] for path in parents if path in arguments), default=len(listed))

    uris = spark.read.text(listed).inputFiles()
    sources = [unquote(re.sub(r"^([a-z0-9+.-]+):///", r"\1:/", uri)) for uri in uris]
    ordered = sorted(sources, key=lambda source: (argument(source), source))
    return [(source, source.rsplit("/", 1)[-1]) for source in ordered]


def files_table(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """The listing as a table: source, file_name, ordinal."""
    rows = [(source, name, index) for index, (source, name) in enumerate(files, start=1)]
    return spark.createDataFrame(rows, "source string, file_name string, ordinal bigint")


def with_chunk(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chunk", F.shiftright("row_key", CHUNK_BITS))


def present(name: str) -> Column:
    """The column, or an error: a line that finds no partner must not be lost."""
    lost = F.raise_error(F.concat(F.lit(f"no {name} known for a line of "), "source"))
    return F.when(F.col(name).isNull(), lost).otherwise(F.col(name))


def chunk_counts(rows: DataFrame) -> DataFrame:
    """Lines per chunk of the whole input; ``rows`` must not be filtered."""
    return (
        with_chunk(rows)
        .groupBy(*_CHUNK)
        .agg(F.min("row_key").alias("first_key"), F.count("*").alias("lines"))
    )


def chunk_offsets(counts: DataFrame, files: DataFrame) -> DataFrame:
    """Lines before each chunk, in its file and over all files in order."""
    within = (
        Window.partitionBy("source")
        .orderBy("block_start", "chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("source").agg(F.sum("lines").alias("file_lines"))
    starts = (
        totals.join(files.select("source", "ordinal"), "source", "left")
        .withColumn("ordinal", present("ordinal"))
        .withColumn("file_offset", F.coalesce(F.sum("file_lines").over(before), F.lit(0)))
        .select("source", "file_offset")
    )
    return (
        counts.withColumn("offset", F.coalesce(F.sum("lines").over(within), F.lit(0)))
        .join(starts, "source")
        .select(*_CHUNK, "first_key", "offset", "file_offset")
    )


def number_lines(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Add ``line_number`` (in the file) and ``arrival`` (over all files), from 1."""
    placed = lookup_join(with_chunk(rows), offsets, _CHUNK, F.col("row_key"))
    line = F.col("row_key") - present("first_key") + F.col("offset") + 1
    return placed.withColumns(
        {"line_number": line, "arrival": line + F.col("file_offset")}
    ).drop("chunk", "block_start", "row_key", "first_key", "offset", "file_offset")


def read_numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with their numbers.

    The lines are stored first: numbers come from two passes, which must see the
    same splits.
    """
    stored = materialize(read_lines(spark, paths), "lines")
    files = files_table(spark, list_files(spark, paths))
    offsets = materialize(chunk_offsets(chunk_counts(stored), files), "offsets")
    return number_lines(stored, offsets)
