"""Masked copies of raw text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.privacy import mask_text
from ..sources.lines import concrete_paths, covers, normal_path


def redact(rows: DataFrame, column: str = "value") -> DataFrame:
    return rows.withColumn(column, mask_text(F.col(column)))


def redact_file(
    spark: SparkSession, source: str, destination: str, overwrite: bool = False
) -> int:
    """Write the masked lines of ``source`` as text and return their number.

    A destination ending in ``.gz`` is written with gzip. An existing one is an
    error unless ``overwrite`` is set. Neither may lie in the other. The copy is
    written next to its destination and takes its place when it is complete.
    """
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    hadoop_conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm_path(destination)
    system = target.getFileSystem(hadoop_conf)
    target = system.makeQualified(target)
    inputs, output = concrete_paths(spark, source), normal_path(target.toString())
    if any(covers(path, output) or covers(output, path) for path in inputs):
        raise ValueError("source and destination must be different")
    if system.exists(target) and not overwrite:
        raise ValueError(f"[PATH_ALREADY_EXISTS] {destination}")
    seen = Observation()
    lines = spark.read.text(source).select(F.make_valid_utf8("value").alias("value"))
    masked = redact(lines).observe(seen, F.count("*").alias("lines"))
    draft = jvm_path(f"{output}.{uuid.uuid4().hex[:12]}")
    writer = masked.write
    if destination.lower().endswith(".gz"):
        writer = writer.option("compression", "gzip")
    writer.text(draft.toString())
    if overwrite:
        system.delete(target, True)
    if not system.rename(draft, target):
        raise OSError(f"cannot rename {draft} to {destination}")
    return seen.get["lines"]
